"""Media columns: samples kept in archives, read by a custom Spark data source.

`write_archives` stores one member for each document, a PNG of 8-bit samples, one after the other in
archive files under the shared folder; a directory at the end of each archive has the members' offsets,
lengths and checksums. `ArchiveSource` plans a partition for each byte range of each archive. A task reads
the directory, then the members that begin in its range, in Arrow batches of bounded bytes. A member that
can't be read or fails its checksum is tried again alone, by its offset, on a newly opened file; if it
still fails, its row carries the error and the others go on.

Only archives of committed tasks are listed, so a lost executor or a second attempt leaves no doubles.

Cases: a null or empty text is stored as 192 blanks; a null id stays null; equal texts give equal stored
bytes; an empty table gives no archive and no row; members of any length form a batch of their own.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import release, shared_dir, ship

#: Samples of a row: 64 pixels of three 8-bit channels.
ROW = 192
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
#: Fixed values of the formats.
MAGIC = b"PLUMARC1"
PNG = b"\x89PNG\r\n\x1a\n"
ENTRY = struct.Struct("<qBqQQI")  # id, is it null, unpadded bytes, offset, length, crc32
FOOTER = struct.Struct("<QQI8s")  # offset of the directory, members, crc32 of the directory, magic


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A lossless PNG of 64 pixels a row, 8 bits a sample, RGB; equal payloads give equal bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a PNG that `encode` made; raises ValueError for anything else."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, height = 8, [], 0
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", data)[1]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and a histogram in 8 bins of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"rows={len(x) // ROW};mean={x.mean():.3f};std={x.std():.3f};hist={','.join(map(str, bins.tolist()))}"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    out, entries, name, at = None, [], "", 0

    def close() -> pa.RecordBatch:
        directory = b"".join(entries)
        out.write(directory + FOOTER.pack(at, len(entries), zlib.crc32(directory), MAGIC))
        out.close()
        size = at + len(directory) + FOOTER.size
        return pa.RecordBatch.from_pydict({"archive": [name], "members": [len(entries)], "bytes": [size]})

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            if out is None:
                name, entries = f"{uuid.uuid4().hex}.arc", []
                out = fs.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
                at = len(MAGIC)
            data = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            media, i = encode(pad(data)), ids[k].as_py()
            out.write(media)
            entries.append(ENTRY.pack(i or 0, i is None, len(data), at, len(media), zlib.crc32(media)))
            at += len(media)
            if at >= ARCHIVE_BYTES:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_archives(docs: DataFrame) -> str:
    """Store the texts of docs (doc_id, text); returns the folder, whose list names the committed archives."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "media")
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: release(_write(it, f"{folder}/archives")), "archive string, members long, bytes long")
    made.write.parquet(f"{folder}/committed")
    fs, root = open_fs(folder)
    # one short line for each archive of 128 MB: the file list that any file source plans from
    with fs.open_output_stream(f"{root}/list") as out:
        for r in spark.read.schema(made.schema).parquet(f"{folder}/committed").toLocalIterator():
            out.write(f"{r['archive']} {r['bytes']}\n".encode())
    return folder


class Range(InputPartition):
    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


def read_at(open_file: Callable[[], object], offset: int, length: int, crc: int, attempts: int = ATTEMPTS, wait: float = 0.2) -> tuple[bytes | None, str | None]:
    """(bytes, None), or (None, error) after `attempts` tries, each on a newly opened file."""
    error = ""
    for k in range(attempts):
        try:
            with open_file() as f:
                f.seek(offset)
                data = f.read(length)
            if len(data) == length and zlib.crc32(data) == crc:
                return data, None
            error = f"{len(data)} of {length} bytes at {offset}, or a wrong checksum"
        except OSError as e:
            error = f"{type(e).__name__} at {offset}: {e}"
        if k + 1 < attempts:
            time.sleep(wait * 2**k)
    return None, error


def directory(open_file: Callable[[], object], size: int, attempts: int = ATTEMPTS) -> list[tuple]:
    """The entries of an archive."""
    error: Exception | None = None
    for k in range(attempts):
        try:
            with open_file() as f:
                f.seek(size - FOOTER.size)
                at, n, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
                f.seek(at)
                data = f.read(size - FOOTER.size - at)
            if magic == MAGIC and zlib.crc32(data) == crc and len(data) == n * ENTRY.size:
                return list(ENTRY.iter_unpack(data))
            error = ValueError("damaged directory")
        except (OSError, struct.error) as e:
            error = e
        if k + 1 < attempts:
            time.sleep(0.2 * 2**k)
    raise error


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        fs, root = open_fs(self.folder)
        with fs.open_input_stream(f"{root}/list") as f:
            lines = f.read().decode().split("\n")[:-1]
        found = []
        for line in lines:
            name, size = line.split(" ")
            found += [Range(f"{name} {size}", low, low + self.range_bytes) for low in range(0, int(size), self.range_bytes)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = open_fs(self.folder)
        name, size = partition.archive.split(" ")

        def open_file():
            return fs.open_input_file(f"{root}/archives/{name}")

        rows, held = [], 0
        shared = open_file()
        for i, null, n, at, length, crc in directory(open_file, int(size)):
            if not partition.low <= at < partition.high:
                continue
            try:
                shared.seek(at)
                media, error = shared.read(length), None
                good = zlib.crc32(media) == crc
            except OSError:
                good = False
            if not good:
                media, error = read_at(open_file, at, length, crc)
            rows.append((None if null else i, n, at, media, error))
            held += length
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["member_id", "n_bytes", "at", "media", "error"])


class ArchiveSource(DataSource):
    """format("archive_members"), option path: a folder that write_archives made."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "member_id long, n_bytes long, at long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def members(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each stored member: member_id, n_bytes, at, media, error."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("path", folder).option("range_bytes", str(range_bytes)).load()


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64() if c.split(" ")[1] == "long" else pa.string() for c in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for i, n, media, error in zip(*(batch.column(c).to_pylist() for c in ("member_id", "n_bytes", "media", "error")), strict=True):
            if error is not None:
                raise OSError(f"member {i}: {error}")
            payload = decode(media)
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digests(found: DataFrame) -> DataFrame:
    """Digests and features of what was read back. An unreadable member ends the query with its error."""
    return found.mapInArrow(lambda it: release(_digest(it)), DIGEST)
