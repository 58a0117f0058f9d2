"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training texts. Weights are
fitted with follow-the-regularised-leader (one learning rate per weight, elastic-net
penalties) on a sample of training texts of bounded size (`sample_docs`, dealt evenly to
the languages), and a temperature is calibrated on texts that the fit has not seen. Every
text is read whole.

Training rows have a language and are not held out. Predictions look at the text only. A
null text, and one without a letter, is `und` with score 0. Without training rows every
text is `und`. Of equal scores the first language in order wins. Repeated rows are predicted one by one, count
one by one in the frequencies, and enter the sample once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import in_small_batches, map_batches
from skylag.llm.bpe import LETTER, character_classes
from skylag.session import materialized

UNKNOWN = "und"
BUCKETS = 1 << 15
HASH_SHIFT = np.uint32(32 - 15)  # the upper bits of a hash name its bucket
GRAMS = 3  # n-grams of one to three characters
SAMPLE_DOCS = 4000
CALIBRATED = 5  # every fifth sampled text calibrates
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-3
CHUNK = 1 << 20


# -- features --------------------------------------------------------------


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return character_classes() == LETTER


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text; a run of anything but letters is one blank."""
    counts = np.zeros(BUCKETS, np.int64)
    for first in range(0, max(1, len(text)), CHUNK):
        # A chunk also holds the beginnings of the n-grams that end in the next one.
        codes = np.frombuffer(text[first : first + CHUNK + GRAMS - 1].lower().encode("utf-32-le"), np.uint32)
        letter = letters()[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        codes = np.where(letter, codes, np.uint32(0x20))[kept]
        own = len(codes) - (GRAMS - 1 if first + CHUNK < len(text) else 0)
        codes = codes * np.uint32(0x85EBCA6B)
        hashes, gram = [], np.full(len(codes), 1, np.uint32)
        for n in range(min(GRAMS, len(codes))):
            gram = (gram[: len(codes) - n] * np.uint32(0x9E3779B1)) ^ codes[n:]
            hashes.append((gram * np.uint32(0xC2B2AE35))[: max(own, 0)] >> HASH_SHIFT)
        if hashes:
            counts += np.bincount(np.concatenate(hashes), minlength=BUCKETS)
    return counts


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of unit length."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    values = counts[at] * idf[at]
    norm = np.sqrt((values * values).sum())
    return at.astype(np.int32), (values / norm if norm else values).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


# -- learning --------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 (bias) x languages
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        at, values = weighted(text, self.idf)
        return softmax((values @ self.weights[at] + self.weights[-1]) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the regularised leader after some passes over (buckets, values, class)."""
    gathered = np.zeros((BUCKETS + 1, classes), np.float64)
    squares = np.zeros((BUCKETS + 1, classes), np.float64)

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, values, label in rows:
            at = np.append(at, BUCKETS)
            values = np.append(values, 1.0)
            z, n = gathered[at], squares[at]
            w = leader(z, n)
            wrong = softmax(values @ w)
            wrong[label] -= 1.0
            slope = values[:, None] * wrong[None, :]
            more = n + slope * slope
            gathered[at] = z + slope - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
            squares[at] = more
    return leader(gathered, squares)


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes the labels likeliest (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """Rows (bucket, documents) over a frame of one text column."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("documents", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found += gram_counts(text.as_py()) > 0
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=schema.names)

    return map_batches(in_small_batches(texts), run, schema).groupBy("bucket").agg(F.sum("documents").alias("documents"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the rows that are not held out; None if no row has a language and a letter."""
    spark = docs.sparkSession
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).alias("language"))
    known = known.filter(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("key").isNotNull() & ~held_out(F.col("key")))
    per_language = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_language:
        return None
    languages = sorted(per_language)
    idf = np.ones(BUCKETS)
    total = sum(per_language.values())
    frequencies = np.zeros(BUCKETS)
    for row in document_frequencies(known.select("text")).collect():  # at most one row per bucket
        frequencies[row["bucket"]] = row["documents"]
    idf = np.log((1 + total) / (1 + frequencies)) + 1

    share = max(1, sample_docs // len(languages))
    # By key and text: neither many texts under one key nor one row many times over comes whole into the sample.
    order = F.pmod(F.xxhash64("key", "text", F.lit("sample")), F.lit(1 << 30))
    rates = F.create_map(*[x for name, n in per_language.items() for x in (F.lit(name), F.lit(int(min(1.0, share / n) * (1 << 30))))])
    sampled = known.withColumn("order", order).filter(F.col("order") < rates[F.col("language")]).dropDuplicates(["key", "order", "language"])
    spread = spark.sparkContext.broadcast(idf)
    row_schema = T.StructType([
        T.StructField("order", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("buckets", T.BinaryType()),
        T.StructField("values", T.BinaryType()),
    ])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [weighted(x.as_py(), spread.value) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("language"), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                    names=row_schema.names,
                )

    rows = materialized(map_batches(in_small_batches(sampled.select("order", "language", "text")), described, row_schema), "language_sample")
    model_schema = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("temperature", T.DoubleType())])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, unseen = [], []
        for batch in batches:
            for order, name, at, values in zip(*(batch.column(c).to_pylist() for c in row_schema.names)):
                row = (np.frombuffer(at, np.int32), np.frombuffer(values, np.float32), languages.index(name))
                (unseen if order % CALIBRATED == 0 else seen).append(row)
        weights = follow_the_leader(seen, len(languages))
        scores = np.array([v @ weights[a] + weights[-1] for a, v, _ in unseen]).reshape(-1, len(languages))
        temperature = calibrated(scores, np.array([k for _, _, k in unseen], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([temperature])], names=model_schema.names)

    # The sample is bounded, so one task can hold it.
    learned = map_batches(rows.repartition(1).sortWithinPartitions("order", "language", "buckets", "values"), train, model_schema).first()
    weights = np.frombuffer(learned["weights"], np.float32).reshape(BUCKETS + 1, len(languages))
    return Model(languages, idf, weights, learned["temperature"])


# -- predictions -----------------------------------------------------------


def predict(docs: DataFrame, model: Model | None, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """The frame with the predicted language and its probability; columns so called are replaced."""
    docs = docs.drop(*[c for c in (language, score) if c != text])
    if model is None:
        return docs.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0)})
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(text):
                content = value.as_py()
                if not has_letter(content):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = known.probabilities(content)
                best = int(p.argmax())
                names.append(known.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_batches(in_small_batches(docs), run, schema)
