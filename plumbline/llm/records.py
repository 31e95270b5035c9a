"""Token ids as length-delimited binary records, with a separate index of offsets.

A record is: its length (8 bytes), the masked CRC-32C of those bytes, the ids, the masked CRC-32C of the
ids; little-endian throughout, the framing that TFRecord readers expect. Ids take 2 bytes while the
vocabulary has at most 65,536 entries, else 4. An index file beside each record file has the header
(magic, bytes an id, records) and then, as whole columns, the ids of documents, a null mask, the offsets
and the token counts; `read_records` reads any records, in any order, by it.

Documents are dealt by ranges of doc_id, as many as their bytes need, each range sorted in its task and written as
one file; the start of a file in the stream of all ids is a sum over the files before it, not over documents.

Cases: a null or empty text is a record with the end id alone; null ids come first; rows with the same id (or none)
are ordered by a hash of the text and then by their place in the table, so that any number of them is spread over
files; a text of any length is one record; other columns aren't read, whatever their names; an empty table writes
no file and gives no row; a damaged record raises.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_file, release, shared_dir, ship
from .media import open_fs

#: Words, and pre-tokens, whose ids a worker keeps, some 40 MB; then it forgets all and begins anew.
MEMO_WORDS = 120_000
#: Bytes of text of a file, about.
FILE_BYTES = 24 << 20
#: Longer words aren't kept.
MEMO_CHARS = 64
#: Records that one task reads back.
READ_RECORDS = 20_000
CHUNK = 256
#: Fixed values of the formats.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
INDEX_MAGIC = b"PLUMIDX1"
INDEX_HEAD = struct.Struct("<8sQQ")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[int], list[list[int]]]:
    """CRC-32C steps of two bytes and of one, and the step over CHUNK ids of zeros in four tables of a byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    x = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        x = one[x & 0xFF] ^ (x >> 8)
    shift = []
    for k in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(2 * CHUNK):
            v = one[v & 0xFF] ^ (v >> 8)
        shift.append(v.tolist())
    return x, one.tolist(), shift


def crc32c(data: bytes) -> int:
    one, c = _tables()[1], 0xFFFFFFFF
    for b in data:
        c = one[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """CRC-32C of consecutive runs of 16-bit units: all chunks of CHUNK units go forward together, then
    each run joins its few chunks. Zeros before a run leave a state of 0 as it is, so runs are padded in front."""
    two, _, (s0, s1, s2, s3) = _tables()
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sizes = ends - starts
    out: list[int] = [0] * len(ends)
    long = np.flatnonzero(sizes >= 2)
    for k in np.flatnonzero(sizes < 2):
        out[k] = crc32c(ids[starts[k] : ends[k]].tobytes())
    if not len(long):
        return out
    chunks = -(-sizes[long] // CHUNK)
    last = np.cumsum(chunks) * CHUNK
    flat = np.zeros(int(last[-1]), np.uint16)
    target = np.repeat(last - sizes[long], sizes[long]) + (np.arange(int(sizes[long].sum())) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long]))
    keep = np.repeat(sizes >= 2, sizes)
    flat[target] = ids[keep] if not keep.all() else ids
    flat[last - sizes[long]] ^= 0xFFFF
    flat[last - sizes[long] + 1] ^= 0xFFFF
    columns = np.ascontiguousarray(flat.reshape(-1, CHUNK).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for c in columns:
        state = two[(state ^ c) & 0xFFFF] ^ (state >> 16)
    parts, at = state.tolist(), 0
    for k, n in zip(long.tolist(), chunks.tolist(), strict=True):
        c = parts[at]
        for p in parts[at + 1 : at + n]:
            c = s0[c & 255] ^ s1[c >> 8 & 255] ^ s2[c >> 16 & 255] ^ s3[c >> 24] ^ p
        out[k] = c ^ 0xFFFFFFFF
        at += n
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


@lru_cache(100_000)
def _head(n: int) -> bytes:
    length = struct.pack("<Q", n)
    return length + struct.pack("<I", masked(crc32c(length)))


class WordIds(dict):
    """Word to the bytes of its ids. Words end at white space, which this tokenizer drops, so a text's ids
    are its words' ids in turn.

    A word of plain letters, digits and ASCII marks is cut into the tokenizer's pre-tokens here, and only new
    pre-tokens go to the library's model; any other word goes through the whole tokenizer.
    """

    #: The tokenizer's pre-tokens, over these letters alone; they are their own NFC and lower case.
    LETTERS = "a-z\xdf-\xf6\xf8-\xff"
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
    PLAIN = re.compile(rf"[\x21-\x7e{LETTERS}]*")

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(local_file(tokenizer_file))
        special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        #: Special tokens stand in the text as they are written; what is around them is encoded apart.
        self.special = {x: array(self.code, [i]).tobytes() for x, i in special.items()}
        self.literals = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.model = self.tokenizer.model
        self.alphabet = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        super().__init__({"": b""})

    def __missing__(self, word: str) -> bytes:
        low = word.lower() if self.PLAIN.fullmatch(word.lower()) else None
        if low is None:
            self.tokenizer.encode_special_tokens = True  # a word may look like one only once it is lower-cased
            ids = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            self.tokenizer.encode_special_tokens = False
        else:
            found = []
            for p in self.PIECES.findall(low):
                x = self.pieces.get(p)
                if x is None:
                    spelled = p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode()))
                    x = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
                    if len(p) <= MEMO_CHARS:
                        if len(self.pieces) >= MEMO_WORDS:
                            self.pieces.clear()
                        self.pieces[p] = x
                found.append(x)
            ids = b"".join(found)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.__getitem__
        for text in texts:
            parts = self.literals.split(text) if self.literals and any(x in text for x in self.special) else [text]
            ids = []
            for t in parts:
                if t in self.special:
                    ids.append(self.special[t])
                    continue
                if t.isascii():
                    t = t.lower()
                for c in "\n\t\r\x0b\x0c":
                    if c in t:
                        t = t.replace(c, " ")
                ids.extend(map(get, t.split(" ")))
            out.append(b"".join(ids))
        return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes are
    themselves, the others follow from U+0100 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def _word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    low = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


MANIFEST = "part int, file string, records long, ids long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, out, at = _word_ids(tokenizer_file), None, 0
    end = np.array([end_id], encoder.kind).tobytes()
    size = encoder.kind.itemsize
    index: list[tuple[np.ndarray, ...]] = []
    name = uuid.uuid4().hex
    fs, root = open_fs(folder)
    for batch in batches:
        if batch.num_rows and out is None:
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(f"{root}/{name}.rec")
        texts = [t or "" for t in batch.column(1).to_pylist()]
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array([x or 0 for x in batch.column(0).to_pylist()], np.int64)
        nulls = np.array(batch.column(0).is_null())
        for low, high in _slices(texts):
            data = [x + end for x in encoder.encode(texts[low:high])]
            counts = np.array([len(x) for x in data], np.int64) // size
            units = np.frombuffer(b"".join(data), np.uint16)
            crcs = crc32c_many(units, np.cumsum(counts) * (size // 2))
            pieces = []
            for x, c in zip(data, crcs, strict=True):
                pieces += (_head(len(x)), x, struct.pack("<I", masked(c)))
            out.write(b"".join(pieces))
            starts = at + np.concatenate(([0], np.cumsum(counts * size + 16)))
            at = int(starts[-1])
            index.append((doc_ids[low:high].astype("<i8"), nulls[low:high], starts[:-1].astype("<u8"), counts.astype("<u8")))
    if out is None:
        return
    out.close()
    columns = [np.concatenate(c) for c in zip(*index, strict=True)]
    with fs.open_output_stream(f"{root}/{name}.idx") as f:
        f.write(INDEX_HEAD.pack(INDEX_MAGIC, size, len(columns[0])))
        for c in columns:
            f.write(c.tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(columns[0])]), pa.array([int(columns[3].sum())])], names=["part", "file", "records", "ids"]
    )


def write_records(docs: DataFrame, tokenizer_file: str, end_id: int = 1, parts: int | None = None) -> str:
    """Encode docs (doc_id, text) and write the record files in ascending order of doc_id; returns the folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = parts or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_at"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_h", "_at")
    dealt.mapInArrow(lambda it: release(_write(it, f"{folder}/files", tokenizer_file, end_id)), MANIFEST).write.parquet(f"{folder}/committed")
    return folder


def load_index(f, low: int = 0, high: int | None = None) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind of an id, document ids, null mask, offsets, token counts) of the records from low to high of the opened index
    f of a record file. Only those entries are read."""
    f.seek(0)
    magic, size, n = INDEX_HEAD.unpack(f.read(INDEX_HEAD.size))
    if magic != INDEX_MAGIC:
        raise ValueError("not an index")
    high, at, columns = n if high is None else min(high, n), INDEX_HEAD.size, []
    for k in map(np.dtype, ("<i8", "?", "<u8", "<u8")):
        f.seek(at + low * k.itemsize)
        columns.append(np.frombuffer(f.read(max(0, high - low) * k.itemsize), k))
        at += n * k.itemsize
    return np.dtype("<u2" if size == 2 else "<u4"), *columns


def _parse(data: bytes, kind: np.dtype, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, their ends by record) of consecutive framed records; raises ValueError where damaged."""
    size, at, view, bodies, sums = kind.itemsize, 0, memoryview(data), [], []
    for n in counts.tolist():
        if view[at : at + 12] != _head(n * size):
            raise ValueError(f"damaged length at {at}")
        bodies.append(view[at + 12 : at + 12 + n * size])
        sums.append(struct.unpack_from("<I", data, at + 12 + n * size)[0])
        at += n * size + 16
    flat = b"".join(bodies)
    ends = np.cumsum(counts.astype(np.int64))
    for k, (got, want) in enumerate(zip(crc32c_many(np.frombuffer(flat, np.uint16), ends * (size // 2)), sums, strict=True)):
        if masked(got) != want:
            raise ValueError(f"damaged record {k}")
    return np.frombuffer(flat, kind), ends


def read_records(folder: str, file: str, which: list[int]) -> list[np.ndarray]:
    """The ids of the records numbered `which` of a file, in that order, each found by the index: a shuffled read."""
    fs, root = open_fs(folder)
    out = []
    with fs.open_input_file(f"{root}/files/{file}.rec") as f, fs.open_input_file(f"{root}/files/{file}.idx") as index:
        for k in which:
            kind, _, _, offsets, counts = load_index(index, k, k + 1)
            f.seek(int(offsets[0]))
            out.append(_parse(f.read(int(counts[0]) * kind.itemsize + 16), kind, counts)[0])
    return out


RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = open_fs(folder)
    for batch in batches:
        for r in batch.to_pylist():
            with fs.open_input_file(f"{root}/{r['file']}.rec") as f, fs.open_input_file(f"{root}/{r['file']}.idx") as index:
                kind, ids, nulls, offsets, counts = load_index(index, r["low"], r["high"])
                # a record takes 16 bytes besides its ids, so offsets tell the ids before it
                before = r["base"] + (offsets.astype(np.int64) - 16 * np.arange(r["low"], r["low"] + len(ids))) // kind.itemsize
                low = 0
                while low < len(ids):
                    # records up to 8 MB at a time, one at least
                    high = int(np.searchsorted(offsets, int(offsets[low]) + (8 << 20)))
                    high = max(low + 1, min(high, len(ids)))
                    f.seek(int(offsets[low]))
                    got, ends = _parse(f.read(int(offsets[high - 1] - offsets[low]) + int(counts[high - 1]) * kind.itemsize + 16), kind, counts[low:high])
                    wide = memoryview(got.astype("<u4")).cast("B")
                    cuts = [0, *(ends * 4).tolist()]
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[low:high], pa.int64(), mask=nulls[low:high]), pa.array(before[low:high], pa.int64()), pa.array(counts[low:high].astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    low = high


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/committed")
    # one row for each file, and an id count for each: small beside the documents
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(READ_RECORDS)))
    splits = files.withColumn("base", before.cast("long")).select("file", "base", low.alias("low")).withColumn("high", F.col("low") + READ_RECORDS)
    n = max(1, files.agg(F.sum(F.ceil(F.col("records") / READ_RECORDS))).first()[0] or 1)
    return splits.repartition(n).mapInArrow(lambda it: release(_read(it, f"{folder}/files")), RESULT)
