"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set are one node. Every node gets BANDS keys of ROWS min-hashes each;
nodes that share a key are candidates, and a pair at the similarity looked for shares none
with a probability of (1 - 0.8^ROWS)^BANDS, 5 in a million. Components of the candidates
are packed, or split if they are large, into shares of bounded size; a large one is
compared share by share. Within a share every pair is judged exactly: two sets that similar
have a shingle in common among the rarest of each (prefix filter), and what shares one is
counted. Pairs that are linked already are not counted again, and only a spanning forest
goes on to the components.

Defined results: texts of fewer words are one shingle; texts without a word are all alike;
rows without a key take no part; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import find_package, in_small_batches, map_batches
from skylag.llm.bitmap import bitmap, maybe_member
from skylag.llm.components import components
from skylag.session import materialized

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
# A share of a candidate component that one task compares with another share.
NODES_PER_SHARE = 2048
BYTES_PER_SHARE = 8 << 20

_DRAW = np.random.default_rng(7)
_FLIPS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64).reshape(BANDS, ROWS) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; words as for the fingerprints of simhash.py."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b]) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; sets without a shingle have none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 1024):
        part = (hashes[first : first + 1024, None] ^ _FLIPS) * _FACTORS
        part ^= part >> np.uint64(32)
        np.minimum(least, (part * _FACTORS).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, version, node, bands): `version` names the text, `node` the set of its shingles."""
    source = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("version"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("key", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands = [], []
            for x in batch.column("text"):
                hashes = shingles(x.as_py() or b"")
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                bands.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("version"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return map_batches(in_small_batches(source), run, schema)


def similar(sets: list[np.ndarray], side: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of similar sets, all of them or those of different sides if there are two."""
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    kinds, members, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(kinds))
    members = rank[members]
    both = len(np.unique(side)) > 1
    # 1e-9: a similarity of exactly 0.8 must not be lost to rounding.
    least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    posted: dict[int, list[int]] = {}
    marked = np.zeros(len(kinds), bool)
    found = []
    for i in np.argsort(sizes, kind="stable").tolist():
        own = np.sort(members[starts[i] : starts[i + 1]])
        prefix = own[: sizes[i] - least[i] + 1].tolist()
        near = {j for p in prefix for j in posted.get(p, ())}
        for p in prefix:
            posted.setdefault(p, []).append(i)
        mine = find(i)
        near = np.array([j for j in near if sizes[j] >= least[i] and (not both or side[j] != side[i]) and find(j) != mine], np.int64)
        if not len(near):
            continue
        marked[own] = True
        shared = np.array([np.count_nonzero(marked[members[starts[j] : starts[j + 1]]]) for j in near.tolist()])
        marked[own] = False
        for j in near[shared >= similarity * (sizes[i] + sizes[near] - shared) - 1e-9].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def links(docs: DataFrame, rows: DataFrame, key: str, text: str, nodes_per_share: int = NODES_PER_SHARE, bytes_per_share: int = BYTES_PER_SHARE) -> DataFrame:
    """Rows (a, b) of nodes: a spanning forest of the similar pairs of each comparison."""
    nodes = rows.groupBy("node").agg(F.min(F.struct("key", "version")).alias("rep"), F.first("bands").alias("bands"))
    nodes = materialized(nodes.select("node", "rep.key", "rep.version", "bands"), "shingle_nodes")
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = materialized(shared.select("band", "low"), "shared_bands")
    candidates = components(keyed.join(shared, "band").select("node", "low"), "node", "low")
    # The smallest vertex of a component has no row there.
    candidates = candidates.unionByName(candidates.select(F.col("component").alias("vertex"), "component").distinct())

    placed = materialized(nodes.join(candidates.withColumnRenamed("vertex", "node"), "node").select("node", F.col("key").alias("_key"), F.col("version").alias("_version"), "component"), "candidates")
    alike = (F.col("_id").cast("long") == F.col("_key")) & (F.xxhash64("_text") == F.col("_version"))
    # Only texts that may be candidates are moved.
    members = bitmap(placed.select(F.xxhash64("_key", "_version").alias("document")), "document")
    told = maybe_member(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), F.xxhash64(F.col("_id").cast("long"), F.xxhash64("_text")), members).filter("maybe")
    texts = told.join(placed, alike).select("node", "component", F.col("_text").cast("binary").alias("text")).dropDuplicates(["node"])
    texts = materialized(texts.withColumn("bytes", F.octet_length("text").cast("long")), "candidate_texts")
    size = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    shares = F.ceil(F.greatest(F.col("n") / nodes_per_share, F.col("bytes") / bytes_per_share)).cast("int")
    total = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    packs = -(-total // bytes_per_share) or 1
    # Components of one share are packed together; the shares of others meet in pairs.
    large = materialized(size.select("component", shares.alias("shares")).filter("shares > 1"), "large_components")
    dealt = texts.join(large, "component", "left")
    small = dealt.filter("shares IS NULL").select(F.pmod(F.xxhash64("component"), F.lit(packs)).alias("part"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("side"), "node", "text")
    split = dealt.filter("shares IS NOT NULL").withColumn("side", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    split = split.select(F.col("component").alias("part"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "text")

    def compare(table: pa.Table) -> pa.Table:
        names = table.column("node").to_numpy()
        sets = [shingles(x.as_py()) for x in table.column("text")]
        pairs = similar(sets, table.column("side").to_numpy())
        return pa.table({"a": pa.array([names[i] for i, _ in pairs], pa.int64()), "b": pa.array([names[j] for _, j in pairs], pa.int64())})

    find_package(docs)
    return small.unionByName(split).groupBy("part", "i", "j").applyInArrow(compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def links_of(alike: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (a, b) of nodes: each node of a group of `alike`, rows (version, group), and the smallest one there."""
    grouped = materialized(rows.select("version", "node").distinct().join(alike.select("version", "group").distinct(), "version").select("node", "group").distinct(), "alike_nodes")
    several = grouped.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return grouped.join(several, "group").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", nodes_per_share: int = NODES_PER_SHARE, bytes_per_share: int = BYTES_PER_SHARE, alike: DataFrame | None = None) -> DataFrame:
    """Rows (key, version), one for each group of near copies: its smallest key, and of that key's texts the one with the smallest hash.

    `alike`, rows (version, group), names texts found alike by other means; they are linked as well.
    """
    rows = materialized(sketches(docs, key, text), "shingle_sketches")
    linked = links(docs, rows, key, text, nodes_per_share, bytes_per_share)
    if alike is not None:
        linked = linked.unionByName(links_of(alike, rows))
    found = components(linked, "a", "b")
    named = rows.select("key", "version", "node").join(found.withColumnRenamed("vertex", "node"), "node", "left")
    first = named.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min(F.struct("key", "version")).alias("first"))
    return materialized(first.select("first.key", "first.version"), "first_of_group")
