"""Packing by concatenating and cutting.

All documents are thought of as one long row of token ids; it is cut every `length` ids.
First pass: every task encodes its documents, writes the ids and each document's start
within the task to the shared folder. The totals of the tasks are summed up to the start
of every task. Second pass: a document's global start gives the windows it lies in, and
every window it touches gets one boundary record (a piece). Only the last sequence has
padding.

Null and empty texts are a lone end id. Rows that repeat are packed as often as they occur. A very long text fills
as many windows as it takes. An empty table gives no rows. Columns other than key and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm import bpe
from skylag.llm.arrow import in_small_batches, map_batches
from skylag.llm.prefix import running_before
from skylag.session import materialized

END_ID = 1
PIECES_PER_BATCH = 2048


def encoded_parts(docs: DataFrame, vocabulary: str, key: str, text: str, end_id: int) -> DataFrame:
    """Rows (key, part, local_start, doc_tokens, ids): part is the task that encoded the document."""
    content = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("key", source.schema["key"].dataType),
        T.StructField("part", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(content.value)
        narrow = np.dtype("<u2" if max(len(coder.token_bytes), end_id + 1) <= 1 << 16 else "<u4")
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            done, rows, size = 0, [], 0
            for position, ids in coder.encode_texts(batch.column("text").to_pylist()):
                count = len(ids) + 1
                rows.append((start, count, np.append(ids, np.uint32(end_id)).astype(narrow).tobytes()))
                start += count
                size += count
                if size >= bpe.PIECE_CHARS or position == batch.num_rows - 1:
                    starts, counts, coded = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(done, len(rows)), pa.array([part] * len(rows), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.binary())],
                        names=schema.names,
                    )
                    done, rows, size = done + len(rows), [], 0

    return map_batches(in_small_batches(source), run, schema)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Rows (key, start, length, doc_tokens, sequence_id, offset, ids), one per piece.

    `ids` are the piece's ids as unsigned 32-bit little-endian binary, `start` the number
    of ids of its document before it, `offset` its place in the sequence.
    """
    parts = materialized(encoded_parts(docs, vocabulary, key, text, end_id), "packing")
    totals = parts.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    bases = running_before(totals, "part", {"base": F.col("tokens")}).select("part", "base")
    # One row per task of the first pass: as many as the scheduler itself keeps on the driver.
    placed = parts.join(F.broadcast(bases), "part").select("key", (F.col("base") + F.col("local_start")).alias("at"), "doc_tokens", "ids")
    schema = T.StructType([
        T.StructField(key, parts.schema["key"].dataType),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field("key").type
            rows: list[tuple] = []

            def ready() -> pa.RecordBatch:
                keys, *columns = zip(*rows)
                arrays = [pa.array(keys, key_type), *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())]
                rows.clear()
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for name, at, count, coded in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "doc_tokens", "ids"))):
                width = len(coded) // count
                ids = np.frombuffer(coded, f"<u{width}").astype("<u4")
                done = 0
                while done < count:
                    sequence, offset = divmod(at + done, length)
                    size = min(count - done, length - offset)
                    rows.append((name, done, size, count, sequence, offset, ids[done : done + size].tobytes()))
                    done += size
                    if len(rows) >= PIECES_PER_BATCH:
                        yield ready()
            if rows:
                yield ready()

    return map_batches(in_small_batches(placed), run, schema)
