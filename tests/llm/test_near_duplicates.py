"""SimHash, components and the flat graph against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skylag.llm import flat_graph, simhash
from skylag.llm.components import components
from skylag.llm.queries import QUERIES


def union_find(vertices, edges):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "A", "A b C", "a b c d", "É A\x1c b\x85c \xa0 d e f a b c d e", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [5, 16, 24, 31])
def test_anchors_cover(bits):
    draw = np.random.default_rng(bits)
    words = draw.integers(0, 1 << bits, 500, dtype=np.uint64)
    rows, anchors, home = simhash.anchors_of(words, bits, 1)
    assert sorted(rows[home]) == list(range(500))
    assert np.bitwise_count(anchors[home] ^ words[rows[home]]).max() <= 1
    assert np.bitwise_count(anchors ^ words[rows]).max() <= 2
    assert not simhash.syndromes(anchors, simhash.covering_length(bits)).any()  # all anchors are code words
    others = words ^ (np.uint64(1) << draw.integers(0, bits, 500).astype(np.uint64))
    more_rows, more, _ = simhash.anchors_of(others, bits, 1)
    reached = set(zip(more_rows.tolist(), more.tolist()))
    assert all((i, a) in reached for i, a in zip(rows[home].tolist(), anchors[home].tolist()))


def near_prints(seed, count):
    draw = random.Random(seed)
    prints = [draw.getrandbits(64) for _ in range(count)]
    for _ in range(3 * count):
        p = draw.choice(prints)
        for bit in draw.sample(range(64), draw.randint(1, 6)):
            p ^= 1 << bit
        prints.append(p)
    return list(dict.fromkeys(prints))


@pytest.mark.parametrize("homes_per_task", [2, 4096])
def test_links_are_all_found(spark, homes_per_task):
    prints = near_prints(1, 60)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fingerprint long, rep long")
    links = simhash.compare(simhash.replicated(df), homes_per_task=homes_per_task)
    got = {r.vertex: r.component for r in components(links, "a", "b").collect()}
    want = union_find(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert {v: got.get(v, v) for v in want} == want
    assert len(set(want.values())) > 5


def test_simhash_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(5, "a b c d e"), (3, "A B C D E"), (7, None), (8, ""), (9, " \n"), (1, long), (2, long + " end"), (2, long + " end"), (None, "a b c d e"), (None, "alone here now")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, fingerprint int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (7, 7), (8, 7), (9, 7), (1, 1), (2, 1), (2, 1), (None, 3), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, distance=5)


def test_simhash_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = union_find(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    rows = QUERIES["op8_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{p:016x}", want[k]) for k, p in prints.items()}


def test_components_of_chains_hubs_and_loops(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (3, 2), (3, 2)]
    found = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = union_find({v for e in edges for v in e}, edges)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {v: found.get(v, v) for v in want} == want
    assert set(found) <= linked
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def vectors(seed, singles, clusters, size):
    draw = np.random.default_rng(seed)
    rows = [draw.normal(size=16) for _ in range(singles)]
    for _ in range(clusters):
        centre = draw.normal(size=16)
        rows += [centre + draw.normal(size=16) * 0.05 for _ in range(size)]
    return rows


def plain_links(rows, threshold=0.98):
    """Per position, linked positions, for rows (key, vector, label)."""
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and label is not None for _, v, label in rows]
    found = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and good[i] and good[j] and label == other and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                found[i].append(j)
    return found


@pytest.mark.parametrize("rows_per_cell", [40, 4096])
def test_flat_graph_finds_the_links(spark, monkeypatch, rows_per_cell):
    monkeypatch.setattr(flat_graph, "ROWS_PER_CELL", rows_per_cell)
    found = [v.tolist() for v in vectors(3, 120, 12, 9)]
    rows = [(i, v, i % 2 if i < 120 else 0) for i, v in enumerate(found)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [1.0, None], 0), (905, found[3], None), (906, found[130], 0), (906, found[130], 0), (907, [2 * x for x in found[131]], 0), (908, [1.0, 0.0], 0), (909, [1.0, 0.01], 0), (910, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = flat_graph.near_duplicates(df).collect()
    assert len(got) == len(rows)
    links = plain_links(rows)
    want = union_find({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, own in enumerate(links) for j in own])
    assert {r.vec_id: r.component_id for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    true, counted = sum(map(len, links)), sum(r.n_links for r in got)
    assert 0.95 * true <= counted <= true
    if rows_per_cell == 4096:
        assert sorted((r.vec_id, r.n_links) for r in got) == sorted((r[0], len(own)) for r, own in zip(rows, links))


def test_crowded_shards_are_split_and_clumps_cut_into_shares(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "ROWS_PER_SHARD", 120)
    draw = np.random.default_rng(8)
    centre = draw.normal(size=16)
    # A third of the rows in one clump, and a cell of far more rows than a shard may have.
    found = [centre + draw.normal(size=16) * 0.02 for _ in range(400)] + vectors(9, 500, 60, 5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(found)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = flat_graph.nodes_of(df, "vec_id", "embedding", "label").withColumn("node", F.col("rep"))
    shards = flat_graph.sharded(nodes, flat_graph.centroids(nodes), 3, 0.98)
    parted = flat_graph.split(shards, 3, 0.98)
    homes = parted.filter("home").groupBy("node").count()
    assert homes.count() == len(rows) and homes.filter("count > 1").isEmpty()
    assert parted.agg(F.max("shares")).first()[0] > 1 and parted.select("cell").distinct().count() > 3
    assert parted.filter("shares = 1").groupBy(*flat_graph.SHARD).count().filter("count > 120").isEmpty()
    # Shares are dealt by hash, so that pairs of them vary around the limit.
    assert flat_graph.dealt_to_parts(parted).groupBy(*flat_graph.PART).count().agg(F.max("count")).first()[0] <= 180
    got = flat_graph.near_duplicates(df).collect()
    links = plain_links(rows)
    assert {r.vec_id: r.component_id for r in got} == union_find(range(len(rows)), [(i, j) for i, own in enumerate(links) for j in own])
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)
    assert sum(r.n_links for r in got) >= 0.95 * sum(map(len, links))


def test_flat_graph_reaches_every_node():
    units = np.array(vectors(4, 30, 3, 100))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    lists = flat_graph.build_graph(units)
    starts = flat_graph.entries(lists, flat_graph.medoid(units))
    seen, frontier = set(starts.tolist()), starts.tolist()
    while frontier:
        frontier = [j for i in frontier for j in lists[i].tolist() if j >= 0 and j not in seen]
        seen.update(frontier)
    assert seen == set(range(len(units)))
    beams = flat_graph.greedy(units, lists, np.arange(len(units)), starts)
    assert np.mean([(i in beam) for i, beam in enumerate(beams.tolist())]) > 0.95


def test_flat_graph_without_rows_or_ids(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert flat_graph.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in flat_graph.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 1, 4, True), (None, 0, None, False), (None, 1, 4, False)], key=str)


def test_flat_graph_query_is_brute_force(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in QUERIES["op9_embedding_duplicates"](spark, sf_dir).collect()}
    links = plain_links(rows)
    want = union_find([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, own in enumerate(links) for j in own])
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[r[0]].n_links <= len(own) for r, own in zip(rows, links))
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, links))


def test_audit_sees_missed_pairs_beside_copies(spark):
    near = [[1.0, 0.01 * i, 0.0] for i in range(4)]
    nodes = spark.createDataFrame([(i, 0, v, 1000 if i == 0 else 1) for i, v in enumerate(near)] + [(9, 0, [0.0, 0.0, 1.0], 5000)], "node long, label int, vector array<double>, copies long")
    all_found = spark.createDataFrame([(i, 999 if i == 0 else 0, 3) for i in range(4)] + [(9, 4999, 0)], "node long, links long, found long")
    assert flat_graph.recall(nodes, all_found, 0.98) == 1.0
    assert flat_graph.recall(nodes, all_found.withColumn("found", F.lit(0)), 0.98) == 0.0
    assert flat_graph.recall(nodes, all_found.withColumn("found", F.when(F.col("node") < 2, 3).otherwise(0)), 0.98) == 0.5
    assert flat_graph.recall(nodes.filter("node = 9"), all_found, 0.98) == 1.0
