"""Byte-level BPE encoding and decoding by forced boundaries.

A text is cut where the tokenizer's own word pattern cuts it and, inside a word, between
two bytes that stand side by side in no token of the vocabulary: no merge can ever cross
such a place. The fragments between cuts are encoded independently, every distinct
fragment once, and their ids are concatenated. Results equal those of the `tokenizers`
library on the same file.

Null and empty texts give no ids, an empty table no rows; repeated rows are encoded one by one; very long texts whole, piece by piece. The vocabulary file is read on the driver; its bytes
(a few MB, whatever the corpus) are broadcast.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skylag.llm.arrow import in_small_batches, map_batches

PIECE_CHARS = 1 << 21  # characters worked on at a time; longer texts are cut between a word and a blank
CACHED_FRAGMENTS = 250_000  # distinct fragments a Python worker remembers
NO_RANK = np.iinfo(np.int32).max

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The White_Space code points, and the endings that the word pattern splits off.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that are younger than the character tables of some Python versions, as first and last code points.
YOUNG_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
YOUNG_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def character_classes() -> np.ndarray:
    classes = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            classes[code] = LETTER
        elif kind == "N":
            classes[code] = NUMBER
    for kind, ranges in ((LETTER, YOUNG_LETTERS), (NUMBER, YOUNG_NUMBERS)):
        for first, last in ranges:
            classes[first : last + 1] = kind
    classes[WHITE_SPACE] = SPACE
    return classes


class ByteBPE:
    """Tables of one vocabulary file and a bounded memory of encoded fragments."""

    def __init__(self, vocabulary_json: bytes):
        spec = json.loads(vocabulary_json)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model["vocab"]
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        inside = np.zeros((256, 256), bool)
        for token, number in vocabulary.items():
            raw = bytes(byte_of[c] for c in token)
            self.token_bytes[number] = raw
            part = np.frombuffer(raw, np.uint8)
            inside[part[:-1], part[1:]] = True
        self.forced = ~inside.ravel()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in self.specials.items():
            self.token_bytes[number] = content.encode()
        self.of_byte = np.array([vocabulary[c] for c in byte_characters()], np.int64)
        keys, merged = [], []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            keys.append((vocabulary[left] << 32) | vocabulary[right])
            merged.append(vocabulary[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = order.astype(np.int32)
        self.merged = np.array(merged, np.int64)
        self.classes = character_classes()
        self.known: dict[bytes, bytes] = {}

    # -- cutting -----------------------------------------------------------

    def cuts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Byte offsets at which the joined parts may be cut, the places in that list
        where a part begins (and the last one ends), and the joined bytes."""
        text = "".join(parts)
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(codes)
        bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        is_bound = np.zeros(n + 1, bool)
        is_bound[bounds] = True
        kind = self.classes[codes]
        cut = is_bound.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        starts = np.flatnonzero(cut)
        first, after = starts[:-1], starts[1:]
        # The last blank of a run before a word is apart from the others; a plain blank joins the word.
        lone = after[(kind[first] == SPACE) & ~is_bound[after]] - 1
        cut[lone] = True
        joins = lone[codes[lone] == 0x20]
        cut[joins + 1] = False
        # An apostrophe at the start of a token takes one of the fixed endings with it.
        mark = first[(codes[first] == 0x27) & cut[first] & (after - first == 1)]
        for ending in ENDINGS:
            hit = mark[mark + len(ending) < n]
            for i, c in enumerate(ending, 1):
                hit = hit[(codes[hit + i] == ord(c)) & ~is_bound[hit + i]]
            cut[hit + 1] = False
            cut[hit + 1 + len(ending)] = True
        at = np.flatnonzero(cut)
        if len(data) != n:
            # A character begins at every byte that does not continue one.
            begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            at, bounds = begins[at], begins[bounds]
        sure = np.zeros(len(data) + 1, bool)
        sure[at] = True
        sure[1:-1] |= self.forced[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        at = np.flatnonzero(sure).astype(np.int32)
        return at, np.searchsorted(at, bounds), raw

    # -- merging -----------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """Ids (unsigned 32-bit, little-endian) of distinct fragments, all merged side by side."""
        sizes = np.array([len(f) for f in fragments], np.int64)
        tokens = self.of_byte[np.frombuffer(b"".join(fragments), np.uint8)]
        owner = np.repeat(np.arange(len(fragments)), sizes)
        ends = np.cumsum(sizes) - 1
        rank = np.full(len(tokens), NO_RANK, np.int32)  # of the pair that begins here
        rank[:-1] = self.ranks(tokens[:-1], tokens[1:])
        rank[ends] = NO_RANK
        done_tokens, done_owner = [], []
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best < NO_RANK
            counts = np.diff(np.r_[starts, len(tokens)])
            keep = np.repeat(live, counts)
            done_tokens.append(tokens[~keep])
            done_owner.append(owner[~keep])
            tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
            if not len(tokens):
                break
            hit = rank == np.repeat(best[live], counts[live])
            at = np.flatnonzero(hit)
            # Equal pairs may overlap ("aaa"); of those side by side, every second one is merged.
            if len(at) > 1:
                new_run = np.r_[True, np.diff(at) > 1]
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            tokens[at] = self.merged[rank[at]]
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            tokens, owner, rank = tokens[stay], owner[stay], rank[stay]
            at = moved[at]
            touched = np.zeros(len(tokens), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            following = np.minimum(fresh + 1, len(tokens) - 1)
            same = (owner[following] == owner[fresh]) & (following > fresh)
            rank[fresh] = np.where(same, self.ranks(tokens[fresh], tokens[following]), NO_RANK)
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate(done_tokens)[order].astype("<u4")
        bound = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(fragments)))] * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]

    def encode_distinct(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the fragments in one array, and the offsets of each."""
        known = self.known
        found = [known.get(f) for f in fragments]
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            fresh = [fragments[i] for i in new]
            encoded = self.merge(fresh)
            for i, ids in zip(new, encoded):
                found[i] = ids
            if len(known) + len(fresh) > CACHED_FRAGMENTS:
                known.clear()
            known.update((f, ids) for f, ids in zip(fresh[:CACHED_FRAGMENTS], encoded) if len(f) <= 64)
        sizes = np.array([len(x) for x in found], np.int64) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.r_[0, np.cumsum(sizes)]

    # -- whole texts -------------------------------------------------------

    def segments(self, text: str) -> Iterator[str | int]:
        """Ids of added tokens, and the text between them in pieces that can be encoded apart."""
        pending = [text]
        for content, number in self.specials.items():
            split: list[str | int] = []
            for part in pending:
                if isinstance(part, str) and content in part:
                    for i, between in enumerate(part.split(content)):
                        split += [between] if i == 0 else [number, between]
                else:
                    split.append(part)
            pending = split
        for part in pending:
            if isinstance(part, int):
                yield part
                continue
            start = 0
            while len(part) - start > PIECE_CHARS:
                end = start + PIECE_CHARS
                while end < len(part) and not (part[end] in " \n\t" and not part[end - 1].isspace() and self.classes[ord(part[end - 1])] != SPACE):
                    end += 1
                yield part[start:end]
                start = end
            if part[start:]:
                yield part[start:]

    def encode_piece(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each of the parts, none of them empty."""
        offsets, places, raw = self.cuts(parts)
        tiles = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = tiles.dictionary_encode()
        flat, bounds = self.encode_distinct(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        sizes = np.diff(bounds)[index]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(bounds[:-1][index] - (ends - sizes), sizes) + np.arange(ends[-1])]
        last = ends[places[1:] - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *last], last)]

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of every text, in order."""
        parts: list[str | int] = []
        owners: list[int] = []
        size = 0
        done = 0  # texts before this one are given out
        collected: dict[int, list[np.ndarray]] = {}

        def flush() -> None:
            strings = [i for i, part in enumerate(parts) if isinstance(part, str)]
            encoded = dict(zip(strings, self.encode_piece([parts[i] for i in strings]))) if strings else {}
            for i, owner in enumerate(owners):
                collected.setdefault(owner, []).append(encoded[i] if i in encoded else np.array([parts[i]], "<u4"))
            parts.clear()
            owners.clear()

        for position, text in enumerate(texts):
            for part in self.segments(text or ""):
                parts.append(part)
                owners.append(position)
                size += len(part) if isinstance(part, str) else 1
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
            if size == 0:
                while done <= position:
                    yield done, _joined(collected.pop(done, []))
                    done += 1
        flush()
        while done < len(texts):
            yield done, _joined(collected.pop(done, []))
            done += 1

    def decode(self, ids: np.ndarray) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    if len(arrays) == 1:
        return arrays[0]
    return np.concatenate(arrays) if arrays else np.empty(0, "<u4")


_LOADED: dict[int, ByteBPE] = {}


def loaded(vocabulary_json: bytes) -> ByteBPE:
    """The tables of a vocabulary, built once in a Python worker."""
    key = hash(vocabulary_json)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(vocabulary_json)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The frame with the ids of its text as binary (unsigned 32-bit, little-endian).

    With `decoded`, a column of that name holds the text decoded from the ids. Columns
    that are already called so are replaced. Other columns pass through unchanged.
    """
    df = df.drop(*[c for c in (ids, decoded) if c and c != text and c in df.columns])
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    added = [T.StructField(ids, T.BinaryType(), False)]
    if decoded:
        added.append(T.StructField(decoded, T.StringType(), False))
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(content.value)
        for batch in batches:
            start, ready, size = 0, [], 0
            for position, found in coder.encode_texts(batch.column(text).to_pylist()):
                ready.append(found)
                size += len(found)
                if size >= PIECE_CHARS or position == batch.num_rows - 1:
                    columns = [*batch.slice(start, len(ready)).columns, pa.array([x.tobytes() for x in ready], pa.binary())]
                    if decoded:
                        columns.append(pa.array([coder.decode(x) for x in ready], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in added)])
                    start, ready, size = start + len(ready), [], 0

    return map_batches(in_small_batches(df), run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the text of its binary ids; null ids give null."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    df = df.drop(decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(content.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return map_batches(in_small_batches(df), run, schema)
