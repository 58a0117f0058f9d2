"""Exact top-k by inner product over a bit-sliced index.

Vectors of whole numbers are kept in blocks of rows. For every attribute a block has one
bitmap (a bit per row) for each binary digit, so all of a block's rows are added up at
once: the upper slices, shifted by the digits of a query's weights, go through carry-save
adders made of AND, OR and XOR, which leaves the slices of a lower bound of every score.
The k-th largest bound is selected from the most significant slice downward; rows whose
bound is within the largest possible rest of it are the boundary rows, and their scores
are computed exactly from all slices.

Each block of queries meets each block of rows once; k rows per query and block go on to
the final ranking. Nothing is approximate: results equal those of brute force.

Vectors that are null, empty or hold a null or non-finite component take no part; a vector
is compared with those of its own length. Rows that share an id are candidates one by one,
never for a query of that id; queries that share id and vector are one. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import map_batches, rows_per_batch
from skylag.llm.prefix import running_before
from skylag.session import materialized

ROWS_PER_BLOCK = 1 << 15
QUERIES_PER_BLOCK = 512
SUMMED_SLICES = 6  # upper slices that are added up; the rest only matters for boundary rows


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


# -- one block -------------------------------------------------------------


class Block:
    """The slices of some rows: shape (attributes, digits, words of 64 rows)."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, slices: np.ndarray):
        self.ids, self.least, self.slices = ids, least, slices
        valid = np.zeros(slices.shape[2] * 64, np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        least = values.min(axis=0)
        rest = (values - least).T
        digits = max(1, int(rest.max()).bit_length())
        words = -(-len(ids) // 64)
        slices = np.zeros((values.shape[1], digits, words * 8), np.uint8)
        for digit in range(digits):
            packed = np.packbits((rest >> digit).astype(np.uint8) & 1, axis=1, bitorder="little")
            slices[:, digit, : packed.shape[1]] = packed
        return cls(ids, least, slices.view(np.uint64))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The exact vectors of some rows, put together from all slices."""
        bits = (self.slices[:, :, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        weights = (1 << np.arange(self.slices.shape[1])).astype(np.int64)
        return np.einsum("dbr,b->rd", bits.astype(np.int64), weights) + self.least

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, the query's own id left out; ties to the smaller id."""
        open_rows = self.valid & ~self._mask(self.ids == query_id)
        total = int(np.bitwise_count(open_rows).sum())
        if total > k:
            open_rows = self._boundary(query, open_rows, k)
        at = np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))
        scores = self.rows(at) @ query
        ids = self.ids[at]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def _mask(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros(len(self.valid) * 64, np.uint8)
        full[: len(flags)] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def _boundary(self, query: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Bitmap of the rows that may be among the k best."""
        size = np.abs(query)
        skipped = max(0, self.slices.shape[1] - SUMMED_SLICES)
        sums = added(self.slices[:, skipped:], query)
        if not sums:
            return rows
        # The k-th largest bound, from the most significant slice downward.
        left, wanted, limit = rows, k, 0
        for digit in range(len(sums) - 1, -1, -1):
            with_digit = left & sums[digit]
            count = int(np.bitwise_count(with_digit).sum())
            if count >= wanted:
                left, limit = with_digit, limit | (1 << digit)
            else:
                wanted -= count
                left = left & ~sums[digit]
        # The skipped digits add less than 2^skipped to each attribute.
        rest = ((1 << skipped) - 1) * int(size.sum())
        least = max(0, limit - -(-rest >> skipped) - 1) if skipped else limit
        above, equal = np.zeros_like(rows), rows
        for digit in range(len(sums) - 1, -1, -1):
            if least >> digit & 1:
                equal = equal & sums[digit]
            else:
                above = above | (equal & sums[digit])
                equal = equal & ~sums[digit]
        return above | equal


def added(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum over attributes of |weight| times value, least significant first.

    For a negative weight the value's complement is added: the same order of rows.
    """
    turned = slices ^ np.where(query < 0, ~np.uint64(0), np.uint64(0))[:, None, None]
    size = np.abs(query)
    digits = slices.shape[1]
    columns: list[list[np.ndarray]] = []
    for shift in range(int(size.max()).bit_length()):
        chosen = turned[(size >> shift) & 1 == 1]
        while len(columns) < shift + digits:
            columns.append([])
        for digit in range(digits):
            columns[shift + digit].append(chosen[:, digit])
    found = []
    place = 0
    while place < len(columns):
        stack = np.concatenate(columns[place]) if columns[place] else np.zeros((1, slices.shape[2]), np.uint64)
        while len(stack) > 1:
            thirds = len(stack) // 3
            if thirds:
                a, b, c = stack[:thirds], stack[thirds : 2 * thirds], stack[2 * thirds : 3 * thirds]
                either = a ^ b
                carry = (a & b) | (c & either)
                stack = np.concatenate([either ^ c, stack[3 * thirds :]])
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            if place + 1 == len(columns):
                columns.append([])
            columns[place + 1].append(carry)
        found.append(stack[0] if len(stack) else np.zeros(slices.shape[2], np.uint64))
        place += 1
    return found


# -- tables ----------------------------------------------------------------


def in_blocks(vectors: DataFrame, size: int, make, fields: list[T.StructField]) -> DataFrame:
    """Rows (part, place, length, *fields): up to `size` rows (id, values) of one length each."""
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("place", T.LongType()), T.StructField("length", T.IntegerType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def ready(length: int) -> pa.RecordBatch:
            nonlocal place
            ids, values = (np.concatenate(x) for x in zip(*waiting.pop(length)))
            arrays = [pa.array([part]), pa.array([place]), pa.array([length], pa.int32()), *[pa.array([x], pa.binary()) for x in make(ids, values)]]
            place += 1
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ids = batch.column("id").to_numpy()
            values = batch.column("values")
            lengths = values.value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                matrix = values.take(pa.array(own)).flatten().to_numpy().reshape(-1, length)
                for first in range(0, len(own), size):
                    held = waiting.setdefault(length, [])
                    held.append((ids[own[first : first + size]], matrix[first : first + size]))
                    if sum(len(i) for i, _ in held) >= size:
                        yield ready(length)
        for length in list(waiting):
            yield ready(length)

    return map_batches(vectors, run, schema)


def build_index(vectors: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The written index of rows (id, values): block, length, digits, ids, least and slices."""

    def make(ids: np.ndarray, values: np.ndarray) -> list[bytes]:
        block = Block.of(ids, values)
        return [ids.tobytes(), block.least.tobytes(), block.slices.tobytes()]

    fields = [T.StructField(n, T.BinaryType()) for n in ("ids", "least", "slices")]
    index = materialized(in_blocks(vectors, rows_per_block, make, fields), "bit_slices")
    counts = index.groupBy("part").agg(F.count(F.lit(1)).alias("blocks"))
    first = running_before(counts, "part", {"first": F.col("blocks")}).select("part", "first")
    # One row per task that built the index.
    return index.join(F.broadcast(first), "part").withColumn("block", F.col("first") + F.col("place")).drop("part", "place", "first")


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): the k best rows for every row that `is_query`."""
    good = rows.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    vectors = good.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("values"))
    asked = good.filter(is_query).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("values")).distinct()
    index = build_index(vectors, rows_per_block)
    fields = [T.StructField("query_ids", T.BinaryType()), T.StructField("queries", T.BinaryType())]
    queries = materialized(in_blocks(asked, queries_per_block, lambda ids, values: [ids.tobytes(), values.tobytes()], fields).drop("part", "place"), "query_blocks")
    blocks = index.count()
    # The query set is replicated to the blocks, each of which is read once.
    everywhere = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))) if blocks else queries.withColumn("block", F.lit(0).cast("long"))
    pairs = everywhere.join(index, ["block", "length"]).select("ids", "least", "slices", "query_ids", "queries", "length")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "version", "id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, least, slices, query_ids, queries, length in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                row_ids = np.frombuffer(ids, np.int64)
                block = Block(row_ids, np.frombuffer(least, np.int64), np.frombuffer(slices, np.uint64).reshape(length, -1, -(-len(row_ids) // 64)))
                found: list[np.ndarray] = []
                for query_id, query in zip(np.frombuffer(query_ids, np.int64).tolist(), np.frombuffer(queries, np.int64).reshape(-1, length)):
                    near, scores = block.top(query_id, query, k)
                    version = int.from_bytes(hashlib.blake2b(query.tobytes(), digest_size=8).digest(), "little", signed=True)
                    found.append(np.array([np.full(len(near), query_id), np.full(len(near), version), near, scores]))
                together = np.concatenate(found, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in together], names=schema.names)

    with rows_per_batch(rows.sparkSession, 8):
        best = materialized(map_batches(pairs, run, schema), "block_tops")
    order = Window.partitionBy("query_id", "version").orderBy(F.col("score").desc(), F.col("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
