"""Hard negatives by inner products of Kronecker-packed vectors.

Candidates are biased to be non-negative, and the same component of several candidates is
put into separated fields of one wide integer. One multiplication by a component of the
anchor, biased too, multiplies all of them; the sum over the components is unpacked field by
field, and the biases are taken off again, which gives the exact scores. A field is as wide
as the largest possible sum. Wide integers are whole numbers below 2^53 in doubles, so that
the products run as matrix products; where not even one field fits, they are unbounded
integers of any number of fields.

Candidates and anchors are kept in blocks, and each block of anchors meets each block of
candidates once, first for the positives, then for the negatives, whose windows of scores
follow from the positives. A few rows per anchor and block go on to the final ranking.

Defined results: rows without id or label, and vectors that are null or empty or hold a null
or non-finite component take no part; a vector is compared with those of its own length.
Scores beyond a long count as its end. Rows that share an id are candidates one by one, never
for an anchor of that id; anchors that share id, label and vector are one. A positive without
a negative in its window gives no row. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import map_batches, rows_per_batch
from skylag.llm.bit_sliced import usable
from skylag.llm.prefix import running_before
from skylag.session import materialized

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90  # a negative's score, in percent of the positive's
ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 256
EXACT_BITS = 53  # whole numbers that a double holds
WIDE_FIELDS = 64  # fields of an unbounded integer
LONGEST = (1 << 63) - 1


# -- products --------------------------------------------------------------


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as unbounded integers."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def packed_words(biased: np.ndarray, width: int, fields: int) -> np.ndarray:
    """Component by component, `fields` candidates side by side in one integer of `width` bits each: (components, words)."""
    count, length = biased.shape
    words = -(-count // fields)
    filled = np.zeros((words * fields, length), biased.dtype)
    filled[:count] = biased
    fielded = filled.reshape(words, fields, length)
    word = fielded[:, fields - 1]
    for field in range(fields - 2, -1, -1):
        word = word * (1 << width) + fielded[:, field]
    return word.T


def unpacked_fields(sums: np.ndarray, width: int, fields: int, count: int) -> np.ndarray:
    """(anchors, candidates): the fields of the sums (anchors, words)."""
    mask = (1 << width) - 1
    split = [(sums >> (width * field)) & mask for field in range(fields)]
    return np.stack(split, axis=2).reshape(len(sums), -1)[:, :count]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, candidates) of whole numbers given as doubles; those beyond a long count as its end."""
    count, length = candidates.shape
    least_a, least_c = int(anchors.min()), int(candidates.min())
    reach_a, reach_c = int(anchors.max()) - least_a, int(candidates.max()) - least_c
    width = max(1, (length * reach_a * reach_c).bit_length())
    largest = length * max(abs(least_a), abs(least_a + reach_a), 1) * max(abs(least_c), abs(least_c + reach_c), 1)
    if 4 * largest < 1 << EXACT_BITS and width <= EXACT_BITS:
        fields = EXACT_BITS // width
        sums = ((anchors - least_a) @ packed_words(candidates - least_c, width, fields)).astype(np.int64)
        products = unpacked_fields(sums, width, fields, count)
    else:
        anchors, candidates, fields = whole(anchors), whole(candidates), WIDE_FIELDS
        products = unpacked_fields((anchors - least_a) @ packed_words(candidates - least_c, width, fields), width, fields, count)
    # (a - p)(c - q) summed over the components, with p and q the biases, back to ac.
    offsets = least_c * anchors.sum(axis=1)[:, None] + least_a * candidates.sum(axis=1)[None, :] - length * least_a * least_c
    if products.dtype != object:
        return products + offsets.astype(np.int64)
    return np.clip(products + offsets, -LONGEST - 1, LONGEST).astype(np.int64)


# -- one block of anchors and one of candidates -----------------------------


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best of some candidates, higher scores first, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some].astype(object) if score[some].min(initial=0) == -LONGEST - 1 else -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def positives_in(anchor: dict, block: dict, k: int) -> Iterator[tuple]:
    """(anchor row, id, score): the k best rows of the anchor's label."""
    table = scores(anchor["values"], block["values"])
    for i in range(len(table)):
        own = np.flatnonzero((block["labels"] == anchor["labels"][i]) & (block["ids"] != anchor["ids"][i]))
        for at in own[best(table[i, own], block["ids"][own], k)].tolist():
            yield i, int(block["ids"][at]), int(table[i, at])


def negatives_in(anchor: dict, block: dict, k: int, least: int, most: int) -> Iterator[tuple]:
    """(anchor row, positive's score, id, score): the k best rows of other labels in the window of each positive's score."""
    table = scores(anchor["values"], block["values"])
    for i in range(len(table)):
        windows = [(p, -(-least * p // 100), most * p // 100) for p in dict.fromkeys(anchor["positives"][i])]
        low, high = min(w[1] for w in windows), max(w[2] for w in windows)
        score = table[i]
        inside = np.flatnonzero((score >= min(low, LONGEST)) & (score <= max(high, -LONGEST)) & (block["labels"] != anchor["labels"][i]) & (block["ids"] != anchor["ids"][i]))
        for positive, low, high in windows:
            if low > high:
                continue
            own = inside[(score[inside] >= low) & (score[inside] <= high)]
            for at in own[best(score[own], block["ids"][own], k)].tolist():
                yield i, positive, int(block["ids"][at]), int(score[at])


# -- tables ----------------------------------------------------------------


def in_blocks(rows: DataFrame, size: int, extra: dict[str, T.DataType]) -> DataFrame:
    """The written blocks: up to `size` rows (id, label, values, ...) of one length as lists, numbered from 0."""
    names = ["id", "label", *extra]
    kinds = {"id": T.LongType(), "label": T.StringType(), **extra}
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("length", T.IntegerType()), *[T.StructField(n, T.ArrayType(kinds[n])) for n in names], T.StructField("values", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[list[pa.Array], np.ndarray]]] = {}

        def ready(length: int) -> pa.RecordBatch:
            nonlocal at
            held = waiting.pop(length)
            columns = [pa.concat_arrays([h[0][i] for h in held]) for i in range(len(names))]
            values = np.concatenate([h[1] for h in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at - 1]), pa.array([length], pa.int32()), *lists, pa.array([values.tobytes()], pa.binary())], names=schema.names)

        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                matrix = vectors.take(pa.array(own)).flatten().to_numpy().reshape(-1, length)
                first = 0
                while first < len(own):
                    held = waiting.setdefault(length, [])
                    last = first + size - sum(len(h[1]) for h in held)
                    chosen = pa.array(own[first:last])
                    held.append(([batch.column(n).take(chosen) for n in names], matrix[first:last]))
                    first = last
                    if sum(len(h[1]) for h in held) == size:
                        yield ready(length)
        for length in list(waiting):
            yield ready(length)

    blocks = materialized(map_batches(rows.select(*names, "vector"), run, schema), "vector_blocks")
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("blocks"))
    first = running_before(counts, "part", {"first": F.col("blocks")}).select("part", "first")
    return blocks.join(first, "part").withColumn("block", F.col("first") + F.col("at")).drop("part", "at", "first")


def meet(anchors: DataFrame, blocks: DataFrame, names: list[str], found, schema: T.StructType, name: str) -> DataFrame:
    """What `found` says of every block of anchors with every block of candidates of its length, written.

    The anchors are the replicated side: every block of candidates is moved once.
    """
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    numbers = F.sequence(F.lit(0), F.lit(last)) if last >= 0 else F.array().cast("array<int>")
    side = {n: f"anchor_{n}" for n in (*names, "values")}
    dealt = anchors.select("length", *[F.col(n).alias(s) for n, s in side.items()], F.explode(numbers.cast("array<bigint>")).alias("block"))
    pairs = dealt.join(blocks.select("block", "length", "id", "label", "values"), ["block", "length"]).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = row["length"]
                block = {"ids": np.array(row["id"], np.int64), "labels": np.array(row["label"], object), "values": np.frombuffer(row["values"], np.float64).reshape(-1, length)}
                anchor = {"ids": row["anchor_id"], "labels": row["anchor_label"], "values": np.frombuffer(row["anchor_values"], np.float64).reshape(-1, length), "positives": row.get("anchor_positives")}
                told = [(row["anchor_anchor"][i], row["anchor_id"][i], *rest) for i, *rest in found(anchor, block)]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], names=schema.names)

    with rows_per_batch(anchors.sparkSession, 4):
        return materialized(map_batches(pairs, run, schema), name)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST_PERCENT,
    most: int = MOST_PERCENT,
    scale: int = SCALE,
    rows_per_block: int = ROWS_PER_BLOCK,
    anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A positive is one of the best rows of the anchor's label; its negatives are the best rows of
    other labels whose score is between `least` and `most` percent of the positive's.
    """
    named = F.col(label) if isinstance(label, str) else label
    floors = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    good = rows.filter(usable(F.col(vector)) & F.col(key).isNotNull() & named.isNotNull()).filter(F.forall(floors, lambda x: F.abs(x) < float("inf")))
    # Whole numbers stay doubles: a long would end too early for the largest.
    columns = [F.col(key).cast("long").alias("id"), named.cast("string").alias("label"), F.transform(floors, _floor).alias("vector")]
    candidates = in_blocks(good.select(*columns), rows_per_block, {})
    asked = good.filter(is_anchor).select(*columns).distinct()
    asked = materialized(asked.withColumn("anchor", F.xxhash64("id", "label", "vector")), "anchors")

    def schema(*names: str) -> T.StructType:
        return T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "anchor_id", *names)])

    def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    blocks = in_blocks(asked, anchors_per_block, {"anchor": T.LongType()})
    near = meet(blocks, candidates, ["anchor", "id", "label"], lambda a, b: positives_in(a, b, positives), schema("id", "score"), "positives_by_block")
    near = materialized(ranked(near, ["anchor"], positives), "positives")

    # At most `positives` scores an anchor; equal ones share their window.
    wanted = near.groupBy("anchor").agg(F.collect_set("score").alias("positives"))
    asking = in_blocks(asked.join(wanted, "anchor"), anchors_per_block, {"anchor": T.LongType(), "positives": T.ArrayType(T.LongType())})
    far = meet(asking, candidates, ["anchor", "id", "label", "positives"], lambda a, b: negatives_in(a, b, negatives, least, most), schema("positive_score", "id", "score"), "negatives_by_block")
    far = ranked(far, ["anchor", "positive_score"], negatives).select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(far, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(x: Column) -> Column:
    """The floor as a double: beyond 2^53 a double has no fraction."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
