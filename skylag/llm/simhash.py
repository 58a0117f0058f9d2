"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are dealt to blocks, each with a threshold; the thresholds
plus one add up to more than the distance looked for, so two fingerprints within that
distance are within the threshold of at least one block (pigeonhole). In every block the
words of a Hamming code are the anchors: its covering radius is 1, so each fingerprint has
a home anchor within 1 and is replicated to every anchor within 1 + threshold. A partner
within the threshold is then always found at the home anchor. A block of threshold 0 has
all words as anchors (covering radius 0).

Per anchor, homes are compared with everything that came there, and only a spanning forest
of the links goes on to the components: no group ever writes out its pairs. Fingerprints
are compared once each, whatever the number of documents that have them. Anchors with many
homes are dealt to several tasks.

Defined results: null and empty texts and texts without a word have fingerprint zero and are linked like any
other; repeated rows count once each; very long texts are read whole; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import in_small_batches, map_batches
from skylag.llm.components import components
from skylag.session import materialized

DISTANCE = 4
SHINGLE = 4
SEED = 42
# (first bit, bits, threshold): thresholds plus one add up to 5, one more than the distance.
BLOCKS = ((0, 24, 1), (24, 24, 1), (48, 16, 0))
HOMES_PER_TASK = 4096
PAIRS_AT_ONCE = 1 << 22


# -- fingerprints ----------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # on bytes both know ASCII only: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    count = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, count, 4096):
        last = min(first + 4096, count)
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[first:last].tolist(), ends[first + width - 1 : last + width - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (key, fingerprint): the fingerprint as a signed 64-bit number."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values.view(np.int64))], names=schema.names)

    return map_batches(in_small_batches(source), run, schema)


# -- anchors ---------------------------------------------------------------


def syndromes(words: np.ndarray, bits: int) -> np.ndarray:
    """Of the shortened Hamming code whose columns are 1, 2, 3, ...: zero for code words."""
    found = np.zeros(len(words), np.uint64)
    for i in range(bits):
        found ^= np.where((words >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return found


def covering_length(bits: int) -> int:
    """The length 2^r - 1 of the perfect code that a block is shortened from."""
    return (1 << bits.bit_length()) - 1


def anchors_of(words: np.ndarray, bits: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within covering radius plus threshold.

    Blocks of threshold 0 use every word as an anchor; others the perfect Hamming code of
    the next length 2^r - 1, a word being filled up with zero bits.
    """
    rows = np.arange(len(words))
    if threshold == 0:
        return rows, words, np.ones(len(words), bool)
    if threshold != 1:
        raise ValueError("blocks of threshold 0 and 1 are covered")
    length = covering_length(bits)
    wrong = syndromes(words, bits)
    one = np.uint64(1)
    flips = one << np.arange(length, dtype=np.uint64)
    # Distance 0 or 1: the code word itself, or the flip of the bit that the syndrome names.
    nearest = np.where(wrong == 0, words, words ^ (one << np.maximum(wrong, one) - one))
    all_rows, all_anchors, all_home = [rows], [nearest], [np.ones(len(words), bool)]
    # Distance 2: flips i < j with (i + 1) ^ (j + 1) equal to the syndrome.
    for i in range(length):
        other = wrong ^ np.uint64(i + 1)
        fits = (other > i + 1) & (wrong != 0)
        at = np.flatnonzero(fits)
        all_rows.append(at)
        all_anchors.append(words[at] ^ flips[i] ^ (one << (other[at] - one)))
        all_home.append(np.zeros(len(at), bool))
    return np.concatenate(all_rows), np.concatenate(all_anchors), np.concatenate(all_home)


def replicated(distinct: DataFrame, blocks: tuple = BLOCKS) -> DataFrame:
    """Rows (block, anchor, home, fingerprint, rep) of distinct fingerprints."""
    schema = T.StructType([
        T.StructField("block", T.IntegerType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("home", T.BooleanType()),
        T.StructField("fingerprint", T.LongType()),
        T.StructField("rep", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy()
            reps = batch.column("rep").to_numpy()
            for number, (first, bits, threshold) in enumerate(blocks):
                words = (prints.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                rows, anchors, home = anchors_of(words, bits, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), number, np.int32)), pa.array(anchors.view(np.int64)), pa.array(home), pa.array(prints[rows]), pa.array(reps[rows])],
                    names=schema.names,
                )

    return map_batches(distinct.select("fingerprint", "rep"), run, schema)


# -- comparison ------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex linked to it) for the links a-b of one batch."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(vertices))
    while True:
        low = np.minimum(root[left], root[right])
        hooked = root.copy()
        np.minimum.at(hooked, root[left], low)
        np.minimum.at(hooked, root[right], low)
        while not np.array_equal(hooked[hooked], hooked):
            hooked = hooked[hooked]
        if np.array_equal(hooked, root):
            break
        root = hooked
    moved = root != np.arange(len(vertices))
    return vertices[moved], vertices[root[moved]]


def linked_pairs(prints: np.ndarray, reps: np.ndarray, cell_start: np.ndarray, homes: np.ndarray, sizes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the first `homes` rows of each cell and all rows of the cell."""
    work = homes * sizes
    order = np.flatnonzero((homes > 0) & (sizes > 1))
    taken = 0
    while taken < len(order):
        total = np.cumsum(work[order[taken:]])
        upto = max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, "right")))
        cells = order[taken : taken + upto]
        taken += upto
        if len(cells) == 1:  # a large one: its homes a few at a time
            start, h, m = int(cell_start[cells[0]]), int(homes[cells[0]]), int(sizes[cells[0]])
            step = max(1, PAIRS_AT_ONCE // m)
            for first in range(0, h, step):
                mine = prints[start + first : start + min(first + step, h)]
                i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ prints[None, start : start + m]) <= distance)
                i, j = i + start + first, j + start
                yield reps[i], reps[j]
            continue
        h, m = homes[cells], sizes[cells]
        counts = h * m
        cell = np.repeat(np.arange(len(cells)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        i = cell_start[cells][cell] + inner // m[cell]
        j = cell_start[cells][cell] + inner % m[cell]
        close = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        yield reps[i[close]], reps[j[close]]


def compare(cells: DataFrame, distance: int = DISTANCE, homes_per_task: int = HOMES_PER_TASK) -> DataFrame:
    """Rows (a, b): a spanning forest of the links found at each task's anchors."""
    # How many homes an anchor has is known before they are dealt out; the few anchors with
    # more than a task's worth get several shares, and what comes there goes to each share.
    crowded = cells.filter("home").groupBy("block", "anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > homes_per_task)
    crowded = materialized(crowded.select("block", "anchor", F.ceil(F.col("n") / homes_per_task).cast("int").alias("shares")), "crowded")
    shares = F.coalesce(F.col("shares"), F.lit(1))
    own = F.pmod(F.xxhash64("fingerprint"), shares).cast("int")
    dealt = cells.join(crowded, ["block", "anchor"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = dealt.withColumn("home", F.col("home") & (F.col("share") == own)).select("block", "anchor", "share", "home", "fingerprint", "rep")
    grouped = dealt.repartition("block", "anchor", "share").sortWithinPartitions("block", "anchor", "share", F.col("home").desc())
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # homes of the anchor that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor", "share", "home", "fingerprint", "rep")]
            if carried is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(carried, columns)]
            block, anchor, share, home, prints, reps = columns
            new = np.r_[True, (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])]
            start = np.flatnonzero(new)
            sizes = np.diff(np.r_[start, len(block)])
            homes = np.add.reduceat(home.astype(np.int64), start)
            for a, b in linked_pairs(prints.view(np.uint64), reps, start, homes, sizes, distance):
                a, b = forest(a, b)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=schema.names)
            upto = start[-1] + homes[-1]
            carried = [x[start[-1] : upto] for x in columns] if homes[-1] else None

    return map_batches(grouped, run, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, blocks: tuple = BLOCKS, homes_per_task: int = HOMES_PER_TASK) -> DataFrame:
    """Rows (key, fingerprint, component_id), one per document; the key is a whole number.

    `fingerprint` is signed 64 bits; the component is the smallest key reachable by links.
    """
    if sum(t + 1 for _, _, t in blocks) <= distance or sorted(b for f, n, _ in blocks for b in range(f, f + n)) != list(range(64)):
        raise ValueError("the blocks must split the 64 bits and cover the distance")
    prints = materialized(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialized(prints.groupBy("fingerprint").agg(F.min(F.col(key).cast("long")).alias("rep")), "distinct_fingerprints")
    usable = distinct.filter("rep IS NOT NULL")
    links = compare(replicated(usable, blocks), distance, homes_per_task)
    found = components(links, "a", "b")
    named = distinct.join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
    named = materialized(named.select("fingerprint", F.coalesce("component", "rep").alias("component_id")), "named_fingerprints")
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")
