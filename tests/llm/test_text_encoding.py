"""BPE, length histogram and packing against the tokenizers library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.llm import bpe, packing, token_counts
from skylag.llm.queries import QUERIES, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "ß", "1", "²", "中", "😀", "\x1c", "\x85", "<|endoftext|>", ".", "--", "'S", "qz", "x", "aaaa", "٣", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_vocabulary(vocabulary_path()))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    odd = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    return [*odd, "", None, "a" * 3000, " " * 2000, "'s's's", "''s", " 's", "<|endoftext|>", "x  <|endoftext|>  y", "The word. " * 2000, "a", "a"]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_the_library(library, coder, texts):
    got = dict(coder.encode_texts(texts))
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = ids_of(library, text)
        assert got[i].tolist() == want, text
        assert coder.decode(got[i]) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_as_in_the_library(library, coder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{x}b 1{x} {x}'s" for x in map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    want = library.encode_batch(texts, add_special_tokens=False)
    differ = [hex(points[64 * i]) for i, ids in coder.encode_texts(texts) if ids.tolist() != want[i].ids]
    assert not differ


def test_long_texts_are_encoded_in_pieces(library, coder, texts, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    got = dict(coder.encode_texts(texts))
    assert all(got[i].tolist() == ids_of(library, text) for i, text in enumerate(texts))


def test_a_full_memory_of_fragments_changes_nothing(library, coder, texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_FRAGMENTS", 3)
    coder.known.clear()
    got = dict(coder.encode_texts(texts[:300]))
    assert all(got[i].tolist() == ids_of(library, text) for i, text in enumerate(texts[:300]))


def test_forced_places_are_inside_no_token(coder):
    for token in coder.token_bytes:
        if token in (b"", b"<|endoftext|>"):
            continue
        for pair in zip(token[:-1], token[1:]):
            assert not coder.forced[pair[0] << 8 | pair[1]]


def test_encode_keeps_columns_and_replaces_those_of_its_name(spark, library):
    df = spark.createDataFrame([(1, "one two", "x", 5), (None, None, None, None)], "doc_id long, text string, ids string, extra int")
    rows = {r.doc_id: r for r in bpe.encode(df, vocabulary_path(), decoded="decoded").collect()}
    assert np.frombuffer(rows[1].ids, "<u4").tolist() == ids_of(library, "one two")
    assert (rows[1].decoded, rows[1].extra, rows[None].ids, rows[None].decoded) == ("one two", 5, b"", "")
    assert bpe.encode(df.limit(0), vocabulary_path()).count() == 0
    again = bpe.decode(bpe.encode(df, vocabulary_path()), vocabulary_path())
    assert {r.decoded for r in again.collect()} == {"one two", ""}


def test_bpe_query_on_all_documents(spark, sf_dir, library):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest())


def check_packing(pieces, texts, library, length):
    """Every document whole, every sequence gapless, only the last one short."""
    whole = {}
    for p in pieces:
        whole.setdefault(p.doc_id, []).append(p)
    want = Counter((key, tuple([*ids_of(library, text), 1])) for key, text in texts)
    got = Counter()
    for key, own in whole.items():
        own = sorted(own, key=lambda p: (p.sequence_id, p.offset))
        while own:
            ids = b""
            while own and len(ids) // 4 == own[0].start:
                ids += own[0].ids
                done = own[0].doc_tokens == len(ids) // 4
                assert own[0].length == len(own[0].ids) // 4
                own.pop(0)
                if done:
                    break
            got[key, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
    assert got == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for number, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or number == max(sequences) and at <= length
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_cuts_and_covers(spark, library, parts):
    texts = [(i, t) for i, t in enumerate(["one", None, "", "word " * 500, "x y z", "tie", "tie"])] + [(3, "again"), (None, "no key"), (9, "same"), (9, "same")]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts], "doc_id long, text string, offset int").repartition(parts)
    for length in (1, 7, 64):
        check_packing(packing.pack(df, vocabulary_path(), length=length).collect(), texts, library, length)
    assert packing.pack(df.limit(0), vocabulary_path()).count() == 0


def test_packing_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()).collect()
    check_packing(pieces, list(texts.items()), library, 2048)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op5_packing"](spark, sf_dir).collect()}
    assert digests == {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}


def test_length_histogram_answers_every_limit(spark, library):
    texts = ["", None, "a", "a b", "a b", "word " * 50, "word " * 3000]
    lengths = sorted(len(ids_of(library, t)) for t in texts)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hist = token_counts.histogram(token_counts.lengths(df, vocabulary_path())).persist()
    assert {r.n_tokens: r.documents for r in hist.collect()} == Counter(lengths)
    for r in hist.collect():
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert r.documents_longer == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.n_tokens)
    for limit in (0, 1, 2, 40, 5000):
        row = token_counts.at_limit(hist, limit).first()
        assert (row.total_tokens, row.truncated_tokens, row.documents_cut) == (sum(lengths), sum(min(n, limit) for n in lengths), sum(n > limit for n in lengths))
    for q in (0.0, 0.3, 0.5, 1.0):
        want = next(n for i, n in enumerate(lengths, 1) if i >= q * len(lengths))
        assert token_counts.quantile(hist, q).first().n_tokens == want
    none = token_counts.histogram(token_counts.lengths(df.limit(0), vocabulary_path()))
    assert none.count() == 0 and token_counts.at_limit(none, 5).first().total_tokens is None


def test_running_totals_over_several_blocks(spark):
    from skylag.llm.prefix import running_before

    df = spark.range(0, 5000, 7).withColumn("v", F.col("id") % 11)
    got = {r.id: r.s for r in running_before(df, "id", {"s": F.col("v")}).collect()}
    total = 0
    for i in range(0, 5000, 7):
        assert got[i] == total
        total += i % 11


def test_empty_tables_and_columns_called_like_results(spark, library):
    docs = spark.createDataFrame([(1, "some text", 5, "b", 7), (None, None, 6, "c", 8)], "doc_id long, text string, start int, ids string, part int")
    check_packing(packing.pack(docs, vocabulary_path()).collect(), [(1, "some text"), (None, None)], library, 2048)
    none = docs.limit(0)
    assert packing.pack(none, vocabulary_path()).count() == 0
    assert bpe.encode(none, vocabulary_path()).count() == 0
    assert token_counts.histogram(token_counts.lengths(none, vocabulary_path())).count() == 0
