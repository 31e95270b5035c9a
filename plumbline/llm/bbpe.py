"""Byte-level BPE encoding and decoding by two tiers.

First tier: a minimal perfect hash over the vocabulary resolves a whole pre-token that is an entry. Second
tier: any other pre-token's bytes become a linked list whose neighbouring pairs wait in a heap by rank and
position; the least is merged and its two new neighbours enter the heap, so a pre-token of n bytes costs
n log n steps. A worker keeps what it worked out for the runs of text between white space.

Cases: a null or empty text has no ids; any Unicode text decodes to exactly its UTF-8 bytes; one long
pre-token is merged in n log n; the hash table has exactly one slot for each entry and a lookup compares
the entry's bytes, so a pre-token outside the vocabulary never gets an id from it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_file, release, ship

#: Runs of text, and pre-tokens, whose ids a worker keeps; then it forgets all and begins anew.
MEMO_RUNS, MEMO_PIECES = 150_000, 350_000
#: Runs longer than this many characters aren't kept.
MEMO_CHARS = 64
#: Ids after which a batch of output ends.
IDS_A_BATCH = 1 << 20
#: The characters of \s in the pattern, spelled out: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
KEYS_A_BUCKET = 4
MASK = 0xFFFFFFFFFFFFFFFF
MIX = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> dict[bytes, int]:
    with open(local_file(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spelled(pattern: str) -> str:
    """The pattern with white space spelled out, so that every engine agrees on it."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


class PerfectHash:
    """Minimal perfect hash: bytes to a slot in range(n), a different one for each key it was built from.

    Keys fall into small buckets. Largest first, each bucket takes the first displacement that sends its
    keys to free slots; a lookup is one hash, one displacement and one remainder.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.n, self.buckets = len(keys), max(1, len(keys) // KEYS_A_BUCKET)
        hashes = np.array([self.digest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        displace = [0] * self.buckets
        step = 256
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            h = hashes[order[starts[b] : starts[b] + sizes[b]]]
            d = 0
            while True:
                tries = self._slots(h[None, :], np.arange(d, d + step, dtype=np.uint64)[:, None])
                good = free[tries].all(1)
                if len(h) > 1:
                    s = np.sort(tries, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    displace[b] = d + k
                    free[tries[k]] = False
                    break
                d += step
        self.displace = displace

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(MIX))) * np.uint64(MIX)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = self.digest(key)
        x = ((h ^ (self.displace[h % self.buckets] * MIX & MASK)) * MIX) & MASK
        return (x >> 32) % self.n


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.entry = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.entry}
        self.hash = PerfectHash(list(ranks))
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for t, i in ranks.items():
            self.slots[self.hash.slot(t)] = (t, i)
        self.pretokens = regex.compile(spelled(pattern)).findall
        self.runs = regex.compile(r" ?[^ \n]+|\n").findall
        # white space other than single blanks and newlines between words: such texts are split as a whole
        self.odd = regex.compile(rf"[ \n][ \n]|^[ \n]|[ \n]\Z|[{WHITE}--[ \n]]", regex.V1).search
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: bytes) -> int:
        """The id of a vocabulary entry, else -1."""
        t, i = self.slots[self.hash.slot(piece)]
        return i if t == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by merging the pair of least rank, the leftmost of equals, until none has a rank."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j, k = heappop(heap)
            if after[i] != j or after[j] != k:
                continue  # one of the two has been merged meanwhile
            after[i], after[j] = k, -1
            if (h := before[i]) >= 0 and (r := rank(piece[h:k])) is not None:
                heappush(heap, (r, h, i, k))
            if k < n:
                before[k] = i
                if (r := rank(piece[i : after[k]])) is not None:
                    heappush(heap, (r, i, k, after[k]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _ids(self, run: str) -> tuple[int, ...]:
        parts = self.pretokens(run)
        if len(parts) == 1:  # kept as a run, so not once more as a pre-token
            return self._piece(parts[0], keep=False)
        return tuple(i for p in parts for i in self._piece(p))

    def _piece(self, text: str, keep: bool = True) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            piece = text.encode()
            i = self.whole(piece)
            ids = (i,) if i >= 0 else tuple(self.merge(piece))
            if keep and len(text) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_PIECES:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.odd(text):
            return list(self._ids(text))
        memo, out = self.memo, []
        for run in self.runs(text):
            ids = memo.get(run)
            if ids is None:
                ids = self._ids(run)
                if len(run) <= MEMO_CHARS:
                    if len(memo) >= MEMO_RUNS:
                        memo.clear()
                    memo[run] = ids
            out += ids
        return out

    def forget(self) -> None:
        self.memo, self.pieces = {}, {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(load_ranks(path), pattern)
    return _tokenizers[path, pattern]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for x in batch.column(column):
        yield x.as_py() or ""


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    t, sha = tokenizer(path, pattern), hashlib.sha256
    for batch in batches:
        n, a, b = [], [], []
        for text in _texts(batch, 1):
            ids = t.encode(text)
            n.append(len(ids))
            a.append(sha(",".join(map(t.decimal.__getitem__, ids)).encode()).hexdigest())
            b.append(sha(t.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids are decoded again."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: release(_digest(it, path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path, pattern)
    for batch in batches:
        low, ids, ends = 0, array("i"), [0]
        for k, text in enumerate(_texts(batch, 1), 1):
            ids.extend(t.encode(text))
            ends.append(len(ids))
            if len(ids) >= IDS_A_BATCH or k == batch.num_rows:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
                n = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, k - low), n, lists], names=["doc_id", "n_tokens", "ids"])
                low, ids, ends = k, array("i"), [0]
    t.forget()  # other stages of a pipeline go on in this worker


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens and its ids."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: release(_encode(it, path, pattern)), "doc_id long, n_tokens long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path, pattern)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the bytes."""
    ship(ids.sparkSession)
    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lambda it: release(_decode(it, path, pattern)), "doc_id long, data binary")
