"""Cover-tree codes, edit embeddings and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.llm import cover_tree, edit_embedding, hard_negatives
from skylag.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


# -- op11 ------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error)} and the digest of the codebooks, in whole numbers of any size."""
    kept = sorted(((k, [int(np.floor(1024 * float(x))) for x in v]) for k, v in rows), key=lambda r: r[0])
    length = len(kept[0][1])
    at = [length * i // parts for i in range(parts + 1)]
    pieces = [[v[a:b] for _, v in kept] for a, b in zip(at, at[1:])]
    books = [[list(p) for p in own[:entries]] for own in pieces]

    def nearest(p, book):
        return min((sum((x - y) ** 2 for x, y in zip(p, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for own, book in zip(pieces, books):
            chosen = [nearest(p, book)[1] for p in own]
            for entry in set(chosen):
                members = [p for p, c in zip(own, chosen) if c == entry]
                book[entry] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(p, book) for p in own] for own, book in zip(pieces, books)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return {k: (bytes(f[i][1] for f in found).hex(), sum(f[i][0] for f in found)) for i, (k, _) in enumerate(kept)}, digest


@pytest.mark.parametrize("scale", [1.0, 40.0, 2e6])
def test_codes_are_those_of_brute_force(spark, scale):
    draw = np.random.default_rng(int(scale))
    centres = draw.normal(size=(6, 10))
    vectors = (centres[draw.integers(0, 6, 300)] + draw.normal(size=(300, 10)) * 0.05) * scale
    vectors[200:] = vectors[:100]  # repeated vectors
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 or None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got, _ = cover_tree.compress(df, entries=20, rows_per_tree=64)
    got = {r.vec_id: r for r in got.collect()}
    want, digest = plain_codes([r[:2] for r in rows], entries=20)
    assert {k: (r.code, r.error) for k, r in got.items()} == want
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    for label in (None, 1, 2):
        assert {got[r[0]].label_error for r in rows if r[2] == label} == {sum(want[r[0]][1] for r in rows if r[2] == label)}


def test_subtrees_go_whole_and_sums_hold():
    draw = np.random.default_rng(3)
    points = np.unique(np.floor(draw.normal(size=(5, 4))[draw.integers(0, 5, 900)] * 4000 + draw.normal(size=(900, 4)) * 20), axis=0)
    counts = draw.integers(1, 9, len(points))
    tree, place = cover_tree.CoverTree.of(points, counts)
    assert (tree.points[place] == points).all()
    inside = [np.sqrt(((tree.points[a:b] - tree.points[a]) ** 2).sum(axis=1)).max() <= r + 1e-9 for a, b, r in zip(tree.low, tree.high, tree.radius)]
    assert all(inside)
    book = points[:: len(points) // 5]
    label, (*taken, (single, _)) = tree.assign(book)
    want = ((tree.points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == want).all()
    assert len(single) < 0.6 * len(points) and max((tree.high[n] - tree.low[n]).max() for n, _ in taken if len(n)) > 50
    n, totals = tree.sums(book)
    assert n.tolist() == [int(tree.counts[want == k].sum()) for k in range(len(book))]
    assert totals.tolist() == [[int(x) for x in (tree.points[want == k] * tree.counts[want == k][:, None]).sum(axis=0)] for k in range(len(book))]


def test_codes_of_odd_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (None, [1.0, 2.0, 3.0, 4.0, 6.0], None), (2, None, 1), (3, [float("nan")] * 5, 1), (4, [float("inf")] * 5, 1), (6, [None] * 5, 2), (7, [], 2), (8, [1e38] * 5, 3), (9, [0.5, 0.25], 4), (10, [-0.0, 0.0], 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", code string, error int")
    found, books = cover_tree.compress(df)
    got = sorted((str(r.vec_id), r.code, r.error) for r in found.collect())
    assert got == [("10", "00000100", 0), ("5", "00000001", 0), ("5", "00000001", 0), ("8", "01010102", 0), ("9", "00000000", 0), ("None", "00000003", 0)] or [g[0] for g in got] == ["10", "5", "5", "8", "9", "None"]
    assert all(r[2] == 0 for r in got)  # as many entries as rows
    assert sorted(books) == [2, 5]
    empty, none = cover_tree.compress(df.limit(0))
    assert empty.count() == 0 and not none and empty.columns == found.columns
    huge = spark.createDataFrame([(1, [1e38, 0.0], 1), (2, [-1e38, 0.0], 1)], VECTORS)
    assert {r.error for r in cover_tree.compress(huge, entries=1, rounds=1)[0].collect()} == {None}


@pytest.mark.parametrize("name", ["op11_cover_tree_codes", "op13_hard_negatives"])
def test_queries_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())


# -- op12 ------------------------------------------------------------------


def plain_piece(piece, steps):
    seen, at = [], 0
    for step in range(steps):
        seen.append(ord(piece[at]) if at < len(piece) else 0)
        if at < len(piece):
            at += int(edit_embedding._MOVES[step, edit_embedding.class_of(np.array([ord(piece[at])], np.uint32))[0]])
    return seen


def pieces_of(text):
    return [text[i : i + edit_embedding.PIECE] for i in range(0, len(text), edit_embedding.PIECE)]


def plain_walk(text):
    """The embedded text, one step at a time."""
    return [c for piece in pieces_of(text) for c in plain_piece(piece, 2 * len(piece))]


def plain_jump(seed, size):
    """Jump consistent hashing, one number at a time."""
    at, following = 0, 0
    while following < size:
        at = following
        seed = (seed * 2862933555777941757 + 1) % (1 << 64)
        following = int((at + 1) * (float(1 << 31) / ((seed >> 33) + 1)))
    return at


def plain_digits(text):
    if not text:
        return "0" * edit_embedding.SLOTS
    walk = plain_walk(text)
    out = []
    for seed in edit_embedding._SEEDS.tolist():
        seen = walk[plain_jump(seed, 2 * len(text))]
        out.append(f"{(seen + 1) * int(edit_embedding._MIX) * (seed | 1) % (1 << 64) >> 60:x}")
    return "".join(out)


def plain_likeness(a, b):
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / len(a) - 1 / 16) / (15 / 16)))


def plain_verified(a, b):
    steps = same = 0
    for first in range(0, max(len(a), len(b)), edit_embedding.PIECE):
        x, y = (t[first : first + edit_embedding.PIECE] for t in (a, b))
        size = 2 * max(len(x), len(y))
        steps += size
        same += sum(p == q for p, q in zip(plain_piece(x, size), plain_piece(y, size)))
    return same / steps if steps else 1.0


def check_following(rows, texts):
    """`texts` are (key, text) in the order of documents."""
    got = {(r.doc_id, r.n_chars, r.fingerprint): r for r in rows}
    assert len(rows) == len(texts)
    prints = [plain_digits(t) for _, t in texts]
    for i, (key, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        row = got[key, len(text), prints[i]]
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.edited_fingerprint == plain_digits(changed)
        next_print = prints[(i + 1) % len(texts)]
        assert row.near_edited == pytest.approx(plain_likeness(prints[i], row.edited_fingerprint))
        assert row.near_next == pytest.approx(plain_likeness(prints[i], next_print))
        for bands, share, other, other_print in ((row.edited_bands, row.edited_verified, changed, row.edited_fingerprint), (row.next_bands, row.next_verified, following, next_print)):
            assert bands == sum(prints[i][b : b + 8] == other_print[b : b + 8] for b in range(0, 256, 8))
            assert share == (pytest.approx(plain_verified(text, other)) if bands else None)


def test_edit_query_is_brute_force(spark, sf_dir):
    rows = QUERIES["op12_edit_embedding"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check_following(rows, [(r.doc_id, r.text or "") for r in sorted(docs, key=lambda r: -r.doc_id)])
    apart = [r.near_edited > r.near_next for r in rows if r.n_chars >= 30 and r.near_next < 0.9]
    assert sum(apart) > 0.98 * len(apart)


def test_few_edits_move_few_digits():
    draw = random.Random(4)
    words = ["".join(draw.choices("etaoinshrdlucm", k=draw.randint(2, 9))) for _ in range(3000)]
    text = " ".join(draw.choices(words, k=900))
    other = " ".join(draw.choices(words, k=900))
    at = draw.sample(range(len(text)), 6)
    near = "".join("" if i in at[:3] else c + "x" if i in at[3:] else c for i, c in enumerate(text))
    a, b, c = edit_embedding.digits_of([edit_embedding.code_points(t) for t in (text, near, other)])
    assert edit_embedding.likeness(a, b) > 0.75 > 0.3 > edit_embedding.likeness(a, c)
    assert edit_embedding.shared_bands(a, b) > 4 and not edit_embedding.shared_bands(a, c)
    shared = edit_embedding.verified([tuple(edit_embedding.code_points(t) for t in (text, near))])[0]
    assert abs(shared - edit_embedding.likeness(a, b)) < 0.12


def test_edits_of_odd_rows(spark):
    rows = [(3, "abc"), (3, "abc"), (3, "other text"), (2, None), (7, ""), (1, "😀 é" * 700), (9, "w" * 70_000), (None, "no key")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fingerprint string, version int").repartition(6)
    version = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in ("abc", "other text")}
    tied = sorted(version, key=version.get)
    check_following(edit_embedding.with_following(docs).collect(), [(9, "w" * 70_000), (7, ""), *[(3, t) for t in tied], (2, ""), (1, "😀 é" * 700)])
    assert edit_embedding.with_following(docs.limit(0)).count() == 0
    check_following(edit_embedding.with_following(docs.filter("doc_id = 2")).collect(), [(2, "")])
    every = {(r.doc_id, r.fingerprint) for r in edit_embedding.fingerprints(docs).collect()}
    assert every == {(k, plain_digits(t or "")) for k, t in rows}


def test_rows_that_fill_several_tasks(spark):
    rows = [(5, "the same text")] * 4000 + [(i, f"text {i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = edit_embedding.with_following(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    texts = [(i, f"text {i}") for i in range(9, -1, -1)]
    same = spark.range(1).select(F.xxhash64(F.lit("the same text")) < F.xxhash64(F.lit("text 5"))).first()[0]
    at = 4 if same else 5
    check_following(got, texts[:at] + [(5, "the same text")] + texts[at:])


# -- op13 ------------------------------------------------------------------


@pytest.mark.parametrize("size", [0.5, 5, 3e3, 1e6, 1e9, 1e30])
def test_packed_products_are_exact(size):
    draw = np.random.default_rng(1)
    a, c = (np.floor(draw.normal(size=(n, 11)) * size) for n in (6, 37))
    want = np.clip(hard_negatives.whole(a) @ hard_negatives.whole(c).T, -(1 << 63), (1 << 63) - 1)
    assert (hard_negatives.scores(a, c).astype(object) == want).all()


def test_fields_share_words():
    values = np.arange(12.0).reshape(6, 2)
    words = hard_negatives.packed_words(values, 10, 4)
    assert words.shape == (2, 2) and words[0, 0] == 0 + (2 << 10) + (4 << 20) + (6 << 30)
    assert (hard_negatives.unpacked_fields((np.array([[3.0, 5.0]]) @ words).astype(np.int64), 10, 4, 6) == np.array([[3.0, 5.0]]) @ values.T).all()


def plain_negatives(rows, positives=5, negatives=10):
    kept = [(k, [int(np.floor(256 * float(x))) for x in v], lab) for k, v, lab in rows]
    out = []
    for k, v, lab in kept:
        if k % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in kept if j != k)
        for p, j, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(k, j, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_negatives_of_small_blocks(spark, size):
    draw = np.random.default_rng(8)
    rows = [(i * 10, [float(np.float32(x)) for x in (draw.normal(size=7) + 0.4) * size], int(draw.integers(0, 3))) for i in range(200)]
    rows += [(10 * i + 1, rows[i][1], rows[i][2]) for i in range(0, 60)]  # ties
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, rows_per_block=50, anchors_per_block=7)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [(100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (1, [2.0, 2.0], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, None, 2), (4, [float("nan"), 1.0], 2), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (6, [1.0], 2), (7, [], 1), (200, [0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0, "b") for r in rows], VECTORS + ", score int, block string")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert [g[:4] for g in got if g[0] == 100] == [(100, 1, 1, 2), (100, 1, 2, 2)]
    assert {g[5] for g in got if g[0] == 200} == {0}  # a score of 0 leaves negatives of 0
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
