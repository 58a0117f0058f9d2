"""Document fingerprints by a randomised edit embedding.

A text is read by a walk that all texts share: at step t, on character c, a random bit of
(t, c) says whether the walk goes on to the next character. What it stands on, step by step,
is the embedded text; where two texts differ by an insertion or a deletion the walks fall in
step again after some steps, so that a small edit distance becomes a small Hamming distance.
A text of n characters takes 2n steps (a few at the end stay on padding).

A fingerprint samples the embedded text at SLOTS steps and keeps four bits of each character
there, as hexadecimal digits. The steps are drawn by jump consistent hashing of the number of steps:
texts of one length share all of them, and of nearly one length nearly all. The share of
equal digits, less what chance gives, estimates how much of the walks is equal. Bands of
sampled bits select candidates, and a candidate is verified by the Hamming distance of the
whole embedded texts.

Long texts are walked in pieces of PIECE characters, so that all pieces of a batch step
together. Every character is walked over, whatever the length of the text.

Defined results: a null text counts as empty; an empty text's fingerprint is all zeros, and two
empty texts are wholly alike. Rows without a key take no part in the order of documents. Rows that share key and text are
one document; unlike texts under one key follow each other by the hash of their text. Empty tables give no rows;
columns other than key and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import map_batches, rows_per_batch
from skylag.session import materialized

SLOTS = 256
BITS = 4  # of a sampled character
PIECE = 1024  # characters that one walk goes over
STEPS = 2 * PIECE
BANDS, DIGITS = 32, 8  # a band is eight sampled digits
ROWS_AT_ONCE = 256  # rows of an Arrow batch: whole texts
CHARS_AT_ONCE = 1 << 20  # characters walked together

_DRAW = np.random.default_rng(20)
#: Whether the walk goes on, by step and class of the character (class 0 is padding: it stays).
_MOVES = _DRAW.integers(0, 2, (STEPS, 256), dtype=np.uint8)
_MOVES[:, 0] = 0
_SEEDS = _DRAW.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def class_of(points: np.ndarray) -> np.ndarray:
    """One of 255 classes of a character; 0 is kept for padding."""
    return (points.astype(np.uint64) * _MIX >> np.uint64(40)).astype(np.uint32) % 255 + 1


def jump(seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sizes, seeds): a number below each size, the same for most sizes near each other (consistent hashing by jumps)."""
    state = np.broadcast_to(seeds, (len(sizes), len(seeds))).copy()
    at = np.zeros(state.shape, np.int64)
    following = np.zeros(state.shape, np.int64)
    limit = np.broadcast_to(sizes[:, None], state.shape)
    while (going := following < limit).any():
        at[going] = following[going]
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        share = ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[going] = ((at[going] + 1) * (float(1 << 31) / share)).astype(np.int64)
    return at


_STEPS_OF: dict[int, np.ndarray] = {}


def sampled_steps(sizes: np.ndarray) -> np.ndarray:
    """(sizes, SLOTS): the sampled steps of texts of so many characters; results of up to 4,096 sizes are kept."""
    new = np.array([n for n in np.unique(sizes).tolist() if n not in _STEPS_OF], np.int64)
    if len(_STEPS_OF) + len(new) > 4096:
        _STEPS_OF.clear()
        new = np.unique(sizes)
    for first in range(0, len(new), 64):
        part = new[first : first + 64]
        _STEPS_OF.update(zip(part.tolist(), jump(_SEEDS, 2 * part)))
    return np.array([_STEPS_OF[n] for n in sizes.tolist()])


# -- walks -----------------------------------------------------------------


def walked(pieces: list[np.ndarray]) -> np.ndarray:
    """(steps, pieces): the character that each walk stands on at each step, 0 after its end."""
    longest = max(map(len, pieces))
    characters = np.zeros((len(pieces), longest + 1), np.uint32)
    for i, piece in enumerate(pieces):
        characters[i, : len(piece)] = piece
    classes = class_of(characters).astype(np.uint8)
    for i, piece in enumerate(pieces):
        classes[i, len(piece) :] = 0
    flat, kinds = characters.ravel(), classes.ravel()
    path = np.empty((2 * longest, len(pieces)), np.int32)
    path[0] = np.arange(len(pieces)) * (longest + 1)
    kind, move = np.empty(len(pieces), np.uint8), np.empty(len(pieces), np.uint8)
    for step in range(2 * longest - 1):
        np.take(kinds, path[step], out=kind, mode="clip")
        np.take(_MOVES[step], kind, out=move, mode="clip")
        np.add(path[step], move, out=path[step + 1])
    return np.take(flat, path, mode="clip")


def _in_turn(texts: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """The pieces of all texts, (text, number), with their walks; pieces of like length walk together."""
    pieces = [(i, p, x[p * PIECE : (p + 1) * PIECE]) for i, x in enumerate(texts) for p in range(-(-len(x) // PIECE))]
    pieces.sort(key=lambda piece: -len(piece[2]))
    first = 0
    while first < len(pieces):
        last = first + max(1, CHARS_AT_ONCE // len(pieces[first][2]))
        chosen = pieces[first:last]
        yield [(i, p) for i, p, _ in chosen], walked([x for _, _, x in chosen])
        first = last


def digits_of(texts: list[np.ndarray]) -> np.ndarray:
    """(texts, SLOTS): the sampled digits of each text."""
    digits = np.zeros((len(texts), SLOTS), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    steps = sampled_steps(sizes)
    piece_of = steps // STEPS
    for names, path in _in_turn(texts):
        owner, number = np.array(names).T
        for column, (i, p) in enumerate(names):
            slots = np.flatnonzero(piece_of[i] == p)
            seen = path[steps[i, slots] - p * STEPS, column]
            digits[i, slots] = (seen.astype(np.uint64) + np.uint64(1)) * _MIX * (_SEEDS[slots] | np.uint64(1)) >> np.uint64(64 - BITS)
    digits[sizes == 0] = 0
    return digits


def digits_text(digits: np.ndarray) -> list[str]:
    """Fingerprints as text, one hexadecimal digit a slot."""
    return [bytes(x).decode() for x in np.frombuffer(b"0123456789abcdef", np.uint8)[digits]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal digits beyond what chance gives, 0 to 1."""
    equal = (a == b).mean(axis=-1)
    chance = 1 / (1 << BITS)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bands two fingerprints have in common."""
    return (a == b).reshape(*a.shape[:-1], BANDS, DIGITS).all(axis=-1).sum(axis=-1)


def verified(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair of texts the share of steps at which their whole walks stand on the same character.

    Steps are counted for the longer text; two empty texts share all.
    """
    steps = np.array([2 * max(len(a), len(b)) for a, b in pairs], np.int64)
    equal = np.zeros(len(pairs), np.int64)
    number = [max(1, -(-max(len(a), len(b)) // PIECE)) for a, b in pairs]
    both = [(i, a[p * PIECE : (p + 1) * PIECE], b[p * PIECE : (p + 1) * PIECE]) for i, (a, b) in enumerate(pairs) for p in range(number[i])]
    both.sort(key=lambda x: -max(len(x[1]), len(x[2])))
    first = 0
    while first < len(both) and max(len(both[first][1]), len(both[first][2])):
        last = first + max(1, CHARS_AT_ONCE // (2 * max(len(both[first][1]), len(both[first][2]))))
        chosen = both[first:last]
        path = walked([x for _, a, b in chosen for x in (a, b)])
        lengths = np.array([2 * max(len(a), len(b)) for _, a, b in chosen])
        same = (path[:, 0::2] == path[:, 1::2]) & (np.arange(len(path))[:, None] < lengths)
        np.add.at(equal, [i for i, _, _ in chosen], same.sum(axis=0))
        first = last
    return np.where(steps > 0, equal / np.maximum(steps, 1), 1.0)


# -- tables ----------------------------------------------------------------


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, fingerprint), one per row; rows without a key have one too."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [code_points(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in texts], pa.int64()), pa.array(digits_text(digits_of(texts)), pa.string())], names=schema.names)

    with rows_per_batch(docs.sparkSession, ROWS_AT_ONCE):
        return map_batches(rows, run, schema).withColumnRenamed("key", key)


TOLD = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
    T.StructField("edited_bands", T.LongType()),
    T.StructField("next_bands", T.LongType()),
    T.StructField("edited_verified", T.DoubleType()),
    T.StructField("next_verified", T.DoubleType()),
])
# The text of a task's first and last document; `alone` if it is both.
EDGE = T.StructType([*TOLD, T.StructField("side", T.StringType()), T.StructField("alone", T.BooleanType()), T.StructField("text", T.StringType())])


def edited(text: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last third replaced by as much of the following one's beginning."""
    third = len(text) // 3
    return np.concatenate([text[: len(text) - third], following[:third]])


def told_of(names: list[tuple[int, int]], texts: list[np.ndarray], following: list[np.ndarray], digits: np.ndarray, following_digits: np.ndarray) -> list[list]:
    """The columns TOLD of some documents and those that follow them; pairs without a band in common are not verified."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    changed_digits = digits_of(changed)
    found = [
        [n[0] for n in names], [n[1] for n in names], [len(x) for x in texts],
        [hashlib.sha256(x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
        digits_text(digits), digits_text(changed_digits),
        likeness(digits, changed_digits).tolist(), likeness(digits, following_digits).tolist(),
    ]
    bands = [shared_bands(digits, changed_digits), shared_bands(digits, following_digits)]
    checks = []
    for shared, others in zip(bands, (changed, following)):
        pairs = np.flatnonzero(shared)
        share = np.full(len(texts), np.nan)
        share[pairs] = verified([(texts[i], others[i]) for i in pairs.tolist()])
        checks.append([None if np.isnan(x) else x for x in share.tolist()])
    return found + [b.tolist() for b in bands] + checks


def _batch(columns: list[list], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.names)


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, ...) of TOLD: each document, its edited text and the document of the next smaller key.

    The document of the smallest key is followed by that of the largest. Texts are moved once,
    by ranges of (key, hash of the text); the last document of a task meets the first one of
    the next task afterwards, in a table of two rows a task.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(64))  # rows that are all the same fill several tasks too
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("version"), salt.alias("salt"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").desc(), F.col("version"), F.col("salt")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "version", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # (name, text, digits)
        count = 0
        for batch in batches:
            names, texts = [], []
            for k, v, t in zip(batch.column("key").to_pylist(), batch.column("version").to_pylist(), batch.column("text")):
                if (k, v) != (names[-1] if names else last and last[0]):
                    names.append((k, v))
                    texts.append(code_points(t.as_py()))
            if not names:
                continue
            digits = digits_of(texts)
            count += len(names)
            if first is None:
                first = (names[0], texts[0])
            if last is not None:
                names, texts, digits = [last[0], *names], [last[1], *texts], np.concatenate([last[2], digits])
            last = (names[-1], texts[-1], digits[-1:])
            if len(names) > 1:
                columns = told_of(names[:-1], texts[:-1], texts[1:], digits[:-1], digits[1:])
                yield _batch(columns + [[None] * (len(names) - 1)] * 3, EDGE)
        if first is not None:
            sides = [("first", *first), ("last", *last[:2])]
            none = [[None] * 2] * (len(TOLD) - 2)
            yield _batch([[n[0] for _, n, _ in sides], [n[1] for _, n, _ in sides], *none, [s for s, _, _ in sides], [count == 1] * 2, [t.tobytes().decode("utf-32-le", "surrogatepass") for _, _, t in sides]], EDGE)

    with rows_per_batch(docs.sparkSession, ROWS_AT_ONCE):
        found = materialized(map_batches(ordered, run, EDGE), "edit_fingerprints")
        inner = found.filter("side IS NULL").select(*TOLD.names)
        edges = found.filter("side IS NOT NULL")
        # A document whose rows fill several tasks has several edges; it was told of where it was first, but not last.
        by_name = edges.groupBy("key", "version").agg(F.bool_or((F.col("side") == "first") & ~F.col("alone")).alias("told"), F.min("text").alias("text"))
        by_name = materialized(by_name, "edge_documents")
        # Two rows a task at most.
        names = by_name.select("key", "version", "told").withColumn("one", F.lit(0))
        window = Window.partitionBy("one").orderBy(F.col("key").desc(), "version")
        start = F.first(F.struct("key", "version")).over(window)
        paired = names.withColumn("next", F.coalesce(F.lead(F.struct("key", "version")).over(window), start))
        last_rows = edges.filter("side = 'last'").select("key", "version").distinct()
        paired = paired.filter("NOT told").join(last_rows, ["key", "version"], "left_semi").select("key", "version", F.col("next.key").alias("k"), F.col("next.version").alias("v"))
        following = by_name.select(F.col("key").alias("k"), F.col("version").alias("v"), F.col("text").alias("following"))
        pairs = paired.join(following, ["k", "v"]).join(by_name.select("key", "version", "text"), ["key", "version"]).select("key", "version", "text", "following")

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, after = ([code_points(x.as_py()) for x in batch.column(c)] for c in ("text", "following"))
                names = list(zip(batch.column("key").to_pylist(), batch.column("version").to_pylist()))
                yield _batch(told_of(names, texts, after, digits_of(texts), digits_of(after)), TOLD)

        outer = map_batches(pairs, tell, TOLD)
    return inner.unionByName(outer).drop("version").withColumnRenamed("key", key)
