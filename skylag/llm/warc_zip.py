"""WARC records in ZIP packages, written and read by byte ranges.

A package holds stored (uncompressed) members: one archive of WARC records, each its own
gzip member, and an index with one line per record. The reader finds the end record, the
ZIP64 records if there are any, and the central directory; it locates the stored members,
reads the index, and then reads only the byte ranges of records. Nothing is extracted.

Of records with equal payloads that with the smallest key is a response, the others are
revisits of it; payloads below `least_bytes` are always responses.

Defined results: null payloads are empty. Rows without a key are responses, with a null
key when read back; rows that repeat are records of their own. An empty table gives no packages and no rows. A payload of any
length is one record. Columns other than key, address and payload are left out, whatever their names. Packages are written under names of
their task attempt; only those of finished tasks are in the list that the reader gets. The
folder can be any that pyarrow's file systems reach from every executor.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import map_batches
from skylag.session import materialized

PACKAGE_BYTES = 32 << 20  # payload after which a task begins another package
RANGE_BYTES = 4 << 20  # records that begin within one such range are read together
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# The names that the WARC and ZIP formats prescribe.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END_64, LOCATOR_64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
KEY_PREFIX = "<urn:page:"


# -- records ---------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def key_uri(key: int | None) -> str:
    return f"{KEY_PREFIX}{'' if key is None else key}>"


def key_of(uri: str) -> int | None:
    number = uri[len(KEY_PREFIX) : -1]
    return int(number) if number else None


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; with `refers_to` a revisit, whose block has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", key_uri(key)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", key_uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """Key, type, payload (None for a revisit), its length and digest, and what it refers to."""
    raw = zlib.decompress(member, wbits=31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    declared = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    found = {"key": key_of(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "bytes": declared, "digest": stated, "refers_to": None, "payload": None}
    if found["type"] == "revisit":
        return found | {"refers_to": key_of(fields["WARC-Refers-To"])}
    if len(payload) != declared or digest(payload) != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return found | {"payload": payload}


# -- packages --------------------------------------------------------------


def write_package(out, records: Iterator[tuple[dict, bytes]]) -> int:
    """Write records (index entry, gzip member) as one package; returns how many."""
    entries: list[str] = []
    at = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
            for entry, member in records:
                archive.write(member)
                entries.append(json.dumps(entry | {"offset": at, "length": len(member)}))
                at += len(member)
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for entry in entries:
                index.write(entry.encode() + b"\n")
        with package.open(zipfile.ZipInfo("datapackage.json"), "w") as about:
            about.write(json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": at}, {"path": INDEX, "records": len(entries)}]}).encode())
    return len(entries)


def central_directory(read, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, stored size, offset of the local header) of all members; read(start, length)."""
    tail_size = min(size, (1 << 16) + 22)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end_at = size - tail_size + at
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(end_at - 20, 20)
        if locator[:4] != LOCATOR_64:
            raise ValueError("ZIP64 locator is missing")
        end_64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end_64[:4] != END_64:
            raise ValueError("ZIP64 end record is missing")
        count, length, start = struct.unpack("<QQQ", end_64[32:56])
    directory = read(start, length)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain = struct.unpack("<II", directory[at + 20 : at + 28])
        name_size, extra_size, comment_size = struct.unpack("<HHH", directory[at + 28 : at + 34])
        (offset,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            tag, part = struct.unpack("<HH", extra[:4])
            if tag == 1:  # the 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack(f"<{part // 8}Q", extra[4 : 4 + part // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + part :]
        found.append((name, method, packed, offset))
        at += 46 + name_size + extra_size + comment_size
    return found


def data_start(read, local: int) -> int:
    head = read(local, 30)
    if head[:4] != LOCAL:
        raise ValueError("damaged local header")
    name_size, extra_size = struct.unpack("<HH", head[26:30])
    return local + 30 + name_size + extra_size


def index_lines(read, start: int, size: int, step: int = 1 << 20) -> Iterator[dict]:
    """Entries of a stored index, read a piece at a time."""
    rest = b""
    for first in range(0, size, step):
        *lines, rest = (rest + read(start + first, min(step, size - first))).split(b"\n")
        for line in lines:
            if line:
                yield json.loads(line)
    if rest:
        yield json.loads(rest)


# -- tables ----------------------------------------------------------------


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row as a record below the folder; rows (path, records), one per package."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "size": F.length("payload")})
    # Only payloads that occur more than once need to be looked up; their table has no payloads.
    repeated = rows.filter(F.col("key").isNotNull() & (F.col("size") >= least_bytes)).groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    repeated = materialized(repeated.select("sha", "first"), "repeated_payloads")
    told = rows.join(repeated, "sha", "left").withColumn("refers_to", F.when(F.col("key") > F.col("first"), F.col("first")))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c) for c in ("key", "url", "payload", "refers_to")))

        source = each()
        ahead = next(source, None)
        number = 0

        def of_package(first: tuple) -> Iterator[tuple[dict, bytes]]:
            nonlocal ahead
            ahead, size = first, 0
            while ahead is not None and size < package_bytes:
                name, address, content, earlier = (x.as_py() for x in ahead)
                yield {"key": name, "digest": digest(content), "filename": ARCHIVE}, record(name, address, content, earlier)
                size += len(content) + 512
                ahead = next(source, None)

        while ahead is not None:
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.wacz"
            with store.open_output_stream(f"{root}/{name}") as out:
                count = write_package(out, of_package(ahead))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count])], names=schema.names)
            number += 1

    return materialized(map_batches(told.select("key", "url", "payload", "refers_to"), run, schema), "packages")


class _Files:
    """Random access to the package that is being read."""

    def __init__(self):
        self.path, self.file = None, None

    def reader(self, path: str):
        if path != self.path:
            if self.file is not None:
                self.file.close()
            store, inner = fs.FileSystem.from_uri(path)
            self.path, self.file = path, store.open_input_file(inner)
        return lambda start, length: self.file.read_at(length, start)


def read(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (key, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records of the packages (path)."""
    places_schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()

        def told(path: str, found: list[tuple[int, int]]) -> pa.RecordBatch:
            starts, lengths = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=places_schema.names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                at = files.reader(path)
                members = {name: (method, size, offset) for name, method, size, offset in central_directory(at, files.file.size())}
                starts = {}
                for name in [n for n in members if n.startswith(("archive/", "indexes/"))]:
                    if members[name][0] != 0:
                        raise ValueError(f"{path}: {name} is compressed and cannot be read by range")
                    starts[name] = data_start(at, members[name][2])
                found: list[tuple[int, int]] = []
                for name in [n for n in starts if n.startswith("indexes/")]:
                    for entry in index_lines(at, starts[name], members[name][1]):
                        found.append((starts[entry["filename"]] + entry["offset"], entry["length"]))
                        if len(found) >= 4096:
                            yield told(path, found)
                            found = []
                if found:
                    yield told(path, found)

    schema = T.StructType([
        T.StructField("key", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                rows.append(parsed(files.reader(path)(start, length)))
                size += rows[-1]["bytes"]
                if size >= range_bytes:
                    yield ready(rows)
                    rows, size = [], 0
            if rows:
                yield ready(rows)

    def ready(rows: list[dict]) -> pa.RecordBatch:
        names = ("key", "url", "type", "bytes", "digest", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=schema.names)

    # Rows are only places, but each stands for a record: tasks are counted by packages, not
    # by the few bytes that are shuffled.
    tasks = max(packages.count(), packages.sparkSession.sparkContext.defaultParallelism)
    found = map_batches(packages.select("path").repartition(tasks, "path"), places, places_schema)
    dealt = found.repartition(tasks, "path", F.floor(F.col("start") / range_bytes)).sortWithinPartitions("path", "start")
    return map_batches(dealt, records, schema)
