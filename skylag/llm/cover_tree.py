"""Vector codes by Lloyd's rounds over partition-local cover trees.

Vectors are cut into equal consecutive parts, and every part position has a codebook. Tasks
cut their rows into blocks, and each block keeps a cover tree of its different points for
every part: a node holds the points within its radius of its centre, its children cover it
at half that scale, and sums accumulated along the order of the leaves give the sum of any
subtree. In a round a node whose nearest entry is nearer than the second by more than twice
the radius goes to that entry whole, by the triangle inequality; only ambiguous nodes are
opened, and only the points of ambiguous leaves are compared one by one. The trees are
written once and read by every round. A round sends one row per used entry and component
from each task; the codebooks (entries times components, whatever the corpus) pass through
the driver.

All arithmetic that decides is exact: distances of whole numbers in doubles, as long as
their sums of squares stay below 2^53, and in unbounded integers beyond.

Defined results: components become floor(scale * x); vectors that are null or empty or hold a
null or non-finite component (or one too large to be scaled) drop out. Each vector length
has its own codebooks; where a length cannot be cut evenly the first parts are shorter, possibly
empty (code 00, no error). Fewer rows than entries give as many entries as rows; rows without
an id come after all others, equal ids by their vectors. Repeated rows are other rows. Errors beyond
a long are null and left out of the sums. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import map_batches, rows_per_batch
from skylag.llm.bit_sliced import usable
from skylag.session import materialized

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS_PER_TREE = 4096
LEAF = 16  # points of a node that is not split further
TOGETHER = 64  # possible centres looked at together while a node is split
EXACT = 1 << 53  # whole numbers below this are exact in a double
LIMB = 30  # sums travel as digits of so many bits
LONGEST = (1 << 63) - 1


def cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries."""
    return (points * points).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * points @ book.T


def is_exact(points: np.ndarray, book: np.ndarray) -> bool:
    """Whether doubles hold every number that `squared` meets."""
    largest = max(float(np.abs(points).max(initial=0)), float(np.abs(book).max(initial=0)))
    return points.shape[1] * (2 * largest) ** 2 < EXACT


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as unbounded integers."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


# -- one tree --------------------------------------------------------------


class CoverTree:
    """Different points with their numbers of rows, in the order of the leaves of a cover tree."""

    FIELDS = ("points", "counts", "low", "high", "radius", "child", "children")

    def __init__(self, points: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, radius: np.ndarray, child: np.ndarray, children: np.ndarray):
        self.points, self.counts = points, counts  # a node's centre is the first point of its range
        self.low, self.high, self.radius, self.child, self.children = low, high, radius, child, children

    @classmethod
    def of(cls, points: np.ndarray, counts: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree, and the place of each given point in its order."""
        order = np.arange(len(points))
        nearest = int(squared(points, points.mean(axis=0, keepdims=True)).argmin())
        order[[0, nearest]] = order[[nearest, 0]]
        whole_radius = float(np.sqrt(max(0.0, squared(points[order], points[order[:1]]).max())))
        low, high, radius, child, children = [0], [len(points)], [whole_radius], [0], [0]
        node = 0
        while node < len(low):
            a, b = low[node], high[node]
            if b - a > LEAF and radius[node] > 0:
                groups, reach = cls._split(points, order[a:b], radius[node] / 2)
                if len(groups) > 1:
                    order[a:b] = np.concatenate(groups)
                    child[node], children[node] = len(low), len(groups)
                    ends = a + np.cumsum([len(g) for g in groups])
                    low += [a, *ends[:-1].tolist()]
                    high += ends.tolist()
                    radius += reach
                    child += [0] * len(groups)
                    children += [0] * len(groups)
            node += 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        arrays = [np.array(low), np.array(high), np.array(radius), np.array(child), np.array(children)]
        return cls(points[order], counts[order], *arrays), place

    @staticmethod
    def _split(points: np.ndarray, members: np.ndarray, scale: float) -> tuple[list[np.ndarray], list[float]]:
        """Groups of the members around centres more than `scale` apart, each centre first, and their radii."""
        groups, reach = [], []
        left = members
        while len(left):
            tried = min(TOGETHER, len(left))
            distance = np.sqrt(np.maximum(squared(points[left[:tried]], points[left]), 0))
            distance[np.arange(tried), np.arange(tried)] = 0
            chosen: list[int] = []
            for i in range(tried):
                if not chosen or distance[chosen, i].min() > scale:
                    chosen.append(i)
            near = distance[chosen] <= scale
            own = np.where(near.any(axis=0), near.argmax(axis=0), -1)
            own[chosen] = np.arange(len(chosen))
            for group, centre in enumerate(chosen):
                held = np.flatnonzero(own == group)
                held = np.r_[centre, held[held != centre]]
                groups.append(left[held])
                reach.append(float(distance[centre, held].max()))
            left = left[own < 0]
        return groups, reach

    def _places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places below some nodes, and which of the nodes each lies below."""
        sizes = self.high[nodes] - self.low[nodes]
        of = np.repeat(np.arange(len(nodes)), sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.low[nodes][of], of

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The nearest entry of each point (ties to the lower one), and the nodes that went to one entry whole."""
        label = np.full(len(self.points), -1)
        taken = []
        # Beyond the exact range radii mean nothing: every point is compared.
        nodes = np.zeros(1 if is_exact(self.points, book) else 0, np.int64)
        while len(nodes):
            distance = np.sqrt(squared(self.points[self.low[nodes]], book))
            best = distance.argmin(axis=1)
            nearest = distance[np.arange(len(nodes)), best]
            distance[np.arange(len(nodes)), best] = np.inf
            second = distance.min(axis=1)
            # The margin covers the rounding of roots.
            sure = second - nearest > 2 * self.radius[nodes] + 1e-9 * (1 + nearest + second.clip(max=1e300))
            places, of = self._places(nodes[sure])
            label[places] = best[sure][of]
            taken.append((nodes[sure], best[sure]))
            wide = nodes[~sure & (self.children[nodes] > 0)]
            starts = np.repeat(self.child[wide], self.children[wide])
            steps = np.arange(len(starts)) - np.repeat(np.cumsum(self.children[wide]) - self.children[wide], self.children[wide])
            nodes = starts + steps
        unsure = np.flatnonzero(label < 0)
        label[unsure] = nearest_entries(self.points[unsure], book)
        return label, taken + [(unsure, label[unsure])]

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the number of rows assigned to it and the sums of their components, as whole numbers."""
        label, (*taken, (single, to)) = self.assign(book)
        counts = np.zeros(len(book), np.int64)
        exact = float(np.abs(self.points).max(initial=0)) * float(self.counts.sum()) < EXACT
        points = self.points.astype(np.int64) if exact else whole(self.points)
        weighed = points * (self.counts if exact else self.counts.astype(object))[:, None]
        totals = np.zeros((len(book), points.shape[1]), weighed.dtype)
        running = np.concatenate([np.zeros((1, points.shape[1]), weighed.dtype), np.cumsum(weighed, axis=0)])
        running_counts = np.r_[0, np.cumsum(self.counts)]
        for nodes, entry in taken:
            np.add.at(totals, entry, running[self.high[nodes]] - running[self.low[nodes]])
            np.add.at(counts, entry, running_counts[self.high[nodes]] - running_counts[self.low[nodes]])
        np.add.at(totals, to, weighed[single])
        np.add.at(counts, to, self.counts[single])
        return counts, totals


def nearest_entries(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    if is_exact(points, book):
        return squared(points, book).argmin(axis=1) if len(points) else np.zeros(0, np.int64)
    entries = whole(book)
    return np.array([((entries - p) ** 2).sum(axis=1).argmin() for p in whole(points)], np.int64)


def errors(points: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared distances of points to their own entries, as whole numbers."""
    if is_exact(points, chosen):
        return ((points - chosen) ** 2).sum(axis=1).astype(np.int64)
    return ((whole(points) - whole(chosen)) ** 2).sum(axis=1)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def grown(values: np.ndarray, parts: int) -> bytes:
    """The trees of a block of vectors, one for each part, and each row's place in them."""
    arrays = {}
    at = cuts(values.shape[1], parts)
    for part, (a, b) in enumerate(zip(at, at[1:])):
        points, inverse, counts = np.unique(values[:, a:b], axis=0, return_inverse=True, return_counts=True)
        tree, place = CoverTree.of(points, counts)
        narrow = tree.points.astype(np.int32) if np.abs(tree.points).max(initial=0) < 1 << 31 else tree.points
        own = {f: getattr(tree, f) for f in CoverTree.FIELDS} | {"points": narrow, "rows": place[inverse.ravel()]}
        arrays |= {f"{f}{part}": x.astype(np.int32) if x.dtype == np.int64 else x for f, x in own.items()}
    return packed(arrays)


def unpacked(blob: bytes, parts: int) -> Iterator[tuple[CoverTree, np.ndarray]]:
    arrays = np.load(io.BytesIO(blob), allow_pickle=False)
    for part in range(parts):
        points, *rest = (arrays[f"{f}{part}"] for f in CoverTree.FIELDS)
        yield CoverTree(points.astype(np.float64), *[x.astype(np.int64) if x.dtype == np.int32 else x for x in rest]), arrays[f"rows{part}"]


# -- tables ----------------------------------------------------------------


def trees_of(rows: DataFrame, parts: int, scale: int, rows_per_tree: int) -> DataFrame:
    """The written trees: rows (length, keys, labels, tree) of up to `rows_per_tree` vectors of one length."""
    schema = T.StructType([
        T.StructField("length", T.IntegerType()),
        T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)),
        T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
        T.StructField("tree", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}

        def ready(length: int) -> pa.RecordBatch:
            held = waiting.pop(length)
            keys, labels = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            tree = grown(np.floor(scale * np.concatenate([h[2] for h in held])) + 0.0, parts)
            ends = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, labels), pa.array([tree], pa.binary())], names=schema.names)

        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                matrix = vectors.take(pa.array(own)).flatten().to_numpy().reshape(-1, length)
                at = 0
                while at < len(own):
                    held = waiting.setdefault(length, [])
                    free = rows_per_tree - sum(len(h[0]) for h in held)
                    chosen = pa.array(own[at : at + free])
                    held.append((batch.column("key").take(chosen), batch.column("label").take(chosen), matrix[at : at + free]))
                    at += free
                    if sum(len(h[0]) for h in held) == rows_per_tree:
                        yield ready(length)
        for length in list(waiting):
            yield ready(length)

    return materialized(map_batches(rows, run, schema), "cover_trees")


def first_books(rows: DataFrame, scale: int, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """Per vector length the parts of the `entries` vectors with the smallest keys."""
    order = [F.col("key").asc_nulls_last(), "vector"]
    dealt = rows.select("key", "vector", F.size("vector").alias("length")).withColumn("share", F.pmod(F.xxhash64("key", "vector"), F.lit(64)))
    # Few of each share reach the task that ranks a length.
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(*order))).filter(F.col("rank") <= entries)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("length").orderBy(*order))).filter(F.col("rank") <= entries)
    vectors: dict[int, list] = {}
    for row in first.sort("length", "rank").collect():  # at most `entries` rows per length
        vectors.setdefault(row["length"], []).append(row["vector"])
    books = {}
    for length, found in vectors.items():
        values, at = np.floor(scale * np.array(found, np.float64)) + 0.0, cuts(length, parts)
        books[length] = [values[:, a:b].copy() for a, b in zip(at, at[1:])]
    return books


def digits_needed(kind: T.DataType) -> int:
    """How many digits hold the sum of a task's components: floats end at 2^128, doubles at 2^1024."""
    return 8 if kind == T.FloatType() else 37


def _digits(totals: np.ndarray, limbs: int) -> list[np.ndarray]:
    """Whole numbers as digits of 30 bits, the last one signed; their sums stay far from a long's ends."""
    found, rest = [], totals
    for _ in range(limbs - 1):
        found.append((rest & ((1 << LIMB) - 1)).astype(np.int64))
        rest = rest >> LIMB
    return [*found, rest.astype(np.int64)]


def better_books(trees: DataFrame, books: dict[int, list[np.ndarray]], limbs: int) -> dict[int, list[np.ndarray]]:
    """The codebooks after one round; entries without rows stay."""
    spread = trees.sparkSession.sparkContext.broadcast(books)
    parts = len(next(iter(books.values())))
    names = ["length", "part", "entry", "place", "n", *[f"s{i}" for i in range(limbs)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            for length, blob in zip(batch.column("length").to_pylist(), batch.column("tree")):
                for part, (tree, _) in enumerate(unpacked(blob.as_py(), parts)):
                    counts, totals = tree.sums(spread.value[length][part])
                    digits = _digits(totals, limbs)
                    if (length, part) in known:
                        counts_before, before = known[length, part]
                        counts, digits = counts + counts_before, [a + b for a, b in zip(before, digits)]
                    known[length, part] = counts, digits
        for (length, part), (counts, digits) in known.items():
            entry, place = np.nonzero(np.repeat(counts[:, None] > 0, digits[0].shape[1], axis=1))
            columns = [np.full(len(entry), length), np.full(len(entry), part), entry, place, counts[entry], *[d[entry, place] for d in digits]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    with rows_per_batch(trees.sparkSession, 1):
        sums = materialized(map_batches(trees.select("length", "tree"), run, schema), "entry_sums")
    better = {length: [b.copy() for b in own] for length, own in books.items()}
    whole_sums = sums.groupBy(*names[:4]).agg(*[F.sum(n).alias(n) for n in names[4:]])
    for row in whole_sums.collect():  # one row per component of a codebook
        total = sum(row[f"s{i}"] << (LIMB * i) for i in range(limbs))
        better[row["length"]][row["part"]][row["entry"], row["place"]] = float(total // row["n"])
    return better


def codebooks_digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in own for x in book.ravel()).encode()).hexdigest()


def coded(trees: DataFrame, books: dict[int, list[np.ndarray]], key: T.DataType, label: T.DataType) -> DataFrame:
    """Rows (key, label, code, error) of all vectors for these codebooks."""
    spread = trees.sparkSession.sparkContext.broadcast(books)
    parts = len(next(iter(books.values())))
    schema = T.StructType([T.StructField("key", key), T.StructField("label", label), T.StructField("length", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, length in enumerate(batch.column("length").to_pylist()):
                keys, labels = batch.column("keys")[i].values, batch.column("labels")[i].values
                codes, error = np.zeros((len(keys), parts), np.uint8), np.zeros(len(keys), np.int64)
                for part, (tree, rows) in enumerate(unpacked(batch.column("tree")[i].as_py(), parts)):
                    book = spread.value[length][part]
                    chosen = tree.assign(book)[0]
                    codes[:, part] = chosen[rows]
                    own = errors(tree.points, book[chosen])[rows]
                    error = error + own if own.dtype != object and (own < LONGEST // parts).all() else error.astype(object) + own
                told = pa.array(error) if error.dtype != object else pa.array([int(e) if e <= LONGEST else None for e in error], pa.int64())
                names = [bytes(c).hex() for c in codes]
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(np.full(len(keys), length, np.int32)), pa.array(names, pa.string()), told], names=schema.names)

    with rows_per_batch(trees.sparkSession, 1):
        return materialized(map_batches(trees, run, schema), "vector_codes")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, rows_per_tree: int = ROWS_PER_TREE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Rows (key, label, code, error, label_error, codebooks_sha256), one per usable vector, and the codebooks by vector length."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * float(scale)) < float("inf"))
    good = rows.filter(usable(F.col(vector))).filter(fits)
    named = good.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    trees = trees_of(named, parts, scale, rows_per_tree)
    books = first_books(named, scale, parts, entries)
    if not books:
        empty = named.select(F.col("key").alias(key), F.col("label").alias(label)).limit(0)
        return empty.withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}), books
    limbs = digits_needed(rows.schema[vector].dataType.elementType)
    for _ in range(rounds):
        books = better_books(trees, books, limbs)
    codes = coded(trees, books, named.schema["key"].dataType, named.schema["label"].dataType)
    by_label = materialized(codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "label_errors")
    digests = F.create_map(*[F.lit(x) for length, own in books.items() for x in (length, codebooks_digest(own))])
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", digests[F.col("length")].alias("codebooks_sha256")), books
