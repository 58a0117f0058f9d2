"""The stages one by one, each against what it got."""

import numpy as np
import pyarrow as pa
import pytest
from test_language_and_pii import plain_spans
from test_near_duplicates import plain_fingerprint, union_find
from test_text_encoding import check_packing

import corpus_pipeline
from skylag.llm import bpe, language, packing, shingle_copies, simhash
from skylag.llm.queries import vocabulary_path
from skylag.session import materialized

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    """The documents and the result of each stage."""
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialized(stage(spark, frames[-1], sf_dir), f"test_{name}"))
    return [{} if i == len(frames) - 1 else {r.doc_id: r for r in f.collect()} for i, f in enumerate(frames)] + [frames]


def test_columns_and_rows(outputs):
    frames = outputs[-1]
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    sizes = [f.count() for f in frames[:-1]]
    assert sizes[0] >= sizes[1] >= 0.95 * sizes[0]
    assert sizes[1] == sizes[2] > sizes[3] == sizes[4] > 0.3 * sizes[0]


def test_language_only_filters(outputs):
    before, after = outputs[0], outputs[1]
    assert all(after[k] == before[k] for k in after)
    assert all(not any(map(str.isalpha, before[k].text)) or len(before[k].text) < 100 for k in set(before) - set(after))


def test_lines_only_disappear(outputs):
    before, after = outputs[1], outputs[2]
    changed = 0
    for k in before:
        kept = iter(before[k].text.split("\n"))
        assert all(line in kept for line in after[k].text.split("\n")) or not after[k].text
        changed += before[k].text != after[k].text
    assert changed


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs[2], outputs[3]
    sets = {k: five_words(r.text) for k, r in before.items()}
    group = union_find(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert set(after) == {k for k in group if group[k] == k}
    assert all(after[k] == before[k] for k in after)


def test_no_base_span_is_left(outputs):
    before, after = outputs[3], outputs[4]
    assert set(before) == set(after)
    for k in before:
        assert not plain_spans(after[k].text)
        if before[k].text == after[k].text:
            assert not plain_spans(before[k].text)


def test_all_that_is_left_is_packed(outputs):
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    check_packing(outputs[-1][-1].collect(), [(k, r.text) for k, r in outputs[4].items()], library, 2048)


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, "the same words in the same order", "en", "s", 1), (1, "the same words in the same order", "en", "s", 1), (2, "the same words in the same order", None, None, None), (3, None, None, None, None), (None, "the mail of a@b.example", "en", None, None), (4, "", "en", "s", 0), (5, "x " * 50_000 + "1.2.3.4", "en", "s", 9)]
    odd = spark.createDataFrame([(*r, 0, "b", 0.5, 1, "v", "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int, base string, score double, _version int, _maybe string, _key string")
    for docs in (odd, odd.limit(0), spark.createDataFrame([(None,) * 11], odd.schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = docs
            docs = materialized(stage(spark, docs, sf_dir), f"odd_{name}")
            assert docs.columns == odd.columns and docs.count() <= kept.count()
        stage = corpus_pipeline.STAGES[-1][1]
        assert stage(spark, docs, sf_dir).count() >= docs.count()
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"odd_{name}")
    assert sorted((r.doc_id is not None, r.doc_id) for r in docs.collect()) == [(False, None), (True, 1), (True, 5)]


def test_near_duplicates_keep_rows_without_an_id(spark, sf_dir):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (4, "a b c d e"), (6, np.str_("quite other words are here"))], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "6", "None", "None"]


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(draw, words, share):
    return " ".join(f"new{draw.integers(1 << 30)}" if draw.random() < share else w for w in words)


@pytest.mark.parametrize("nodes_per_share", [7, 2048])
def test_near_copies_share_four_fifths_of_five_word_shingles(spark, sf_dir, nodes_per_share):
    draw = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        words = [f"w{i}" for i in draw.integers(0, 10_000, int(draw.integers(30, 400)))]
        texts += [" ".join(words)] + [edited(draw, words, share) for share in (0.01, 0.02, 0.02, 0.03, 0.05)]
    sets = [five_words(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    prints = [plain_fingerprint(t) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in pairs) > len(pairs) / 2  # loose copies are among them
    group = union_find(range(len(texts)), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    first = shingle_copies.first_of_groups(docs, nodes_per_share=nodes_per_share)
    assert {r.key for r in first.collect()} == set(group.values())
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()} == set(group.values())


def test_near_copies_by_fingerprint_are_linked(spark, sf_dir):
    """Passages said over and over count once in a set of shingles, but as often as they stand there in a fingerprint."""
    said = "the one passage that is said over and over again here " * 60
    rows = [(7, said + "with an end of its own that nobody else has"), (3, said + "then comes some other end which is quite unlike it"), (3, "and a text of other words under the same number"), (9, "yet another text without any copy")]
    prints = [plain_fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < min((prints[0] ^ prints[2]).bit_count(), (prints[2] ^ prints[3]).bit_count())
    a, b = five_words(rows[0][1]), five_words(rows[1][1])
    assert 5 * len(a & b) < 4 * len(a | b)
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[1:])


def test_of_repeated_rows_the_same_one_stays(spark, sf_dir):
    rows = [(1, "the same text again", f"l{i}", "s") for i in range(20)]
    kept = [corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows[::step], "doc_id long, text string, lang string, source string").repartition(4), sf_dir).collect() for step in (1, -1)]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_unlike_texts_under_one_id_both_stay(spark, sf_dir):
    rows = [(1, "first words of the one text"), (1, "and another text has these instead"), (1, "first words of the one text"), (2, "first words of the one text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(set(rows[:2]))


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def own_limit(spark):
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)


def batch_sizes(docs):
    """Rows and bytes of the batches in which a Python worker now gets the rows."""

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    return docs.mapInArrow(told, "rows long, bytes long").collect()


TEXT_OPERATORS = {
    "document_frequencies": lambda docs: language.document_frequencies(docs.select("text")),
    "predict": lambda docs: language.predict(docs, language.Model(["en"], np.ones(language.BUCKETS), np.zeros((language.BUCKETS + 1, 1)), 1.0)),
    "encoded_parts": lambda docs: packing.encoded_parts(docs, vocabulary_path(), "doc_id", "text", 1),
    "encode": lambda docs: bpe.encode(docs, vocabulary_path()),
    "sketches": lambda docs: shingle_copies.sketches(docs, "doc_id", "text"),
    "fingerprints": simhash.fingerprints,
}


@pytest.mark.parametrize("operator", TEXT_OPERATORS)
def test_workers_get_whole_texts_in_small_batches(spark, own_limit, operator):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")
    assert max(row["bytes"] for row in batch_sizes(docs)) > 12e6
    assert TEXT_OPERATORS[operator](docs).count() > 0
    sizes = batch_sizes(docs)
    assert sum(row["rows"] for row in sizes) == 3000
    assert max(row["bytes"] for row in sizes) < 1.1e6


def test_long_texts_are_read_whole_and_an_own_limit_stays(spark, own_limit):
    spark.conf.set(LIMIT, "100000")
    docs = spark.range(0, 3, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 1000000) AS text", "repeat('cd ', 100) AS more")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded")
    assert spark.conf.get(LIMIT) == "100000"
    assert coded.filter("decoded = text AND length(more) = 300").count() == 3
