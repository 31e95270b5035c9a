"""SimHash near-duplicates: fingerprints of 64 bits, linked at DISTANCE or fewer differing bits, by an index of their bytes.

A fingerprint is eight bytes by position. Two bits that differ lie in two bytes at most, so linked fingerprints share
six positional bytes or more: the guaranteed minimum. A posting list of one byte holds a 256th of the corpus, so lists
are intersections of four positions, one for each two of the four halves of a word: any six shared positions hold one
of these six sets. In a list the shared positional bytes of a pair are tallied, pairs that reach the minimum are kept
and verified by their differing bits.

A list of more than LIST fingerprints isn't compared pair by pair. Its entries go on to lists of six positions, each of
the six extensions by two further positions, which again miss no link and hold 65,536 fingerprints at most, whatever the corpus
holds; there the 136 ways to differ in one or two of the free bits are looked up. Equal fingerprints are one entry.
A task gives a forest of the links it finds, not the links; components come from star contraction in Spark.

Cases: a null text or one without words has fingerprint zero, which links like any other; fewer words than n are one
shingle; texts of any length are read in sections; a bit set in exactly half the shingles is 0; repeated rows and equal
ids are rows with equal fingerprints; null ids are the least of a component only if all are null; an empty table gives
no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import union_find
from .common import discard, release, ship, small, stored
from .ngram_join import MANY_COPIES, components

#: Differing bits up to which fingerprints link; and the positional bytes that such share at least.
DISTANCE = 2
SHARED = 8 - DISTANCE
#: Fingerprints of a list that are compared pair by pair.
LIST = 512
#: Bytes of text worked on at a time, and shingles.
SECTION, SHINGLES = 1 << 20, 1 << 17
SEED = 42
WHITE = re.compile(rb"[\x20\x09-\x0D]")

HALVES = [(0, 1), (2, 3), (4, 5), (6, 7)]
#: Position sets of the first index, and of the second.
FOURS = [a + b for a, b in combinations(HALVES, 2)]
SIXES = list(combinations(range(8), 6))


def mask(positions: tuple[int, ...]) -> int:
    """The bits of these bytes, as a signed long."""
    m = sum(255 << 8 * p for p in positions)
    return m - (m >> 63 << 64)


def _sections(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some of them at a time."""
    low = 0
    while len(data) - low > SECTION and (m := WHITE.search(data, low + SECTION)):
        yield data[low : m.start()].split()
        low = m.start()
    yield data[low:].split()


def _shingles(data: bytes, n: int) -> Iterator[list[bytes]]:
    """Runs of n words joined by blanks, some at a time; of fewer words the whole sequence."""
    kept: list[bytes] = []
    some = False
    for words in _sections(data.lower()):  # A-Z only, as these are bytes
        words = kept + words
        if len(words) >= n:
            text = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size) + np.arange(len(words))
            yield [text[a:z] for a, z in zip((end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)]
            some, words = True, words[len(words) - n + 1 :]
        kept = words
    if kept and not some:
        yield [b" ".join(kept)]


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_digest

    for b in batches:
        ones, total = np.zeros((b.num_rows, 64), np.int64), np.zeros(b.num_rows, np.int64)
        digests: list[bytes] = []
        rows, sizes, held = [], [], 0

        def count(rows=rows, sizes=sizes, digests=digests, ones=ones, total=total) -> None:
            if rows:
                bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
                sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
                np.add.at(ones, rows, sums)
                np.add.at(total, rows, sizes)
            for x in (rows, sizes, digests):
                x.clear()

        for r, text in enumerate(b.column(1)):
            for part in _shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", n):
                digests.extend([xxh64_digest(x, SEED) for x in part])
                rows.append(r)
                sizes.append(len(part))
                held += len(part)
                if held >= SHINGLES:
                    count()
                    held = 0
        count()
        packed = np.packbits(2 * ones > total[:, None], axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(packed).view(">i8").ravel().astype(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: release(_fingerprints(it, n)), "doc_id long, fp long")


def _forest(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Links (x, y) as stars around a node of each of their components."""
    nodes, where = np.unique(np.concatenate((x, y)), return_inverse=True)
    root = union_find(len(nodes), where[: len(x)], where[len(x) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[far]]), pa.array(nodes[far])], names=["p", "x"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(s, key, fp), sorted, in pieces that end where a list does."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        new = [b.column(c).to_numpy() for c in range(3)]
        kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        ends = np.flatnonzero((np.diff(kept[0]) != 0) | (np.diff(kept[1]) != 0))
        if len(ends):
            z = int(ends[-1]) + 1
            yield tuple(c[:z] for c in kept)
            kept = [c[z:] for c in kept]
    if kept is not None and len(kept[0]):
        yield tuple(kept)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of four positions, each of LIST entries at most."""
    for s, key, fp in _whole_lists(batches):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])))
        end = np.append(np.flatnonzero(new)[1:], len(s))[np.cumsum(new) - 1]  # of each entry's list
        x, y = [], []
        at = np.arange(len(s))
        for d in range(1, LIST):  # entries d apart
            at = at[at + d < end[at]]
            if not len(at):
                break
            apart = fp[at] ^ fp[at + d]
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = at[(shared >= SHARED) & (np.bitwise_count(apart.view(np.uint64)) <= DISTANCE)]
            x.append(fp[near])
            y.append(fp[near + d])
        if x and len(found := np.concatenate(x)):
            yield _forest(found, np.concatenate(y))


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of six positions: every way to differ in one or two of the other bits."""
    ways = []
    for six in SIXES:
        free = [1 << 8 * p + k for p in range(8) if p not in six for k in range(8)]
        ways.append(np.array(free + [a | b for a, b in combinations(free, 2)], np.uint64).view(np.int64))
    for s, _, fp in _whole_lists(batches):
        x, y = [], []
        for k in np.unique(s).tolist():
            own = np.unique(fp[s == k])
            for way in ways[k]:
                other = own ^ way
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = np.flatnonzero((own[at] == other) & (other > own))
                x.append(own[hit])
                y.append(other[hit])
        if x and len(found := np.concatenate(x)):
            yield _forest(found, np.concatenate(y))


def links(prints: DataFrame, most: int = LIST) -> DataFrame:
    """Distinct fingerprints (fp) to links (p, x) that connect all that reach each other."""
    fp = F.col("fp")
    keys = lambda sets: F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("s"), fp.bitwiseAND(F.lit(mask(x))).alias("key")) for k, x in sets]))
    posts = prints.select(keys(list(enumerate(FOURS))).alias("e"), "fp").select("e.s", "e.key", "fp")
    long_ones = stored(posts.groupBy("s", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("s").alias("_s"), F.col("key").alias("_k")), "simhash-long")
    held = small(long_ones)  # a list needs more than `most` entries to be one
    same = (F.col("s") == F.col("_s")) & (F.col("key") == F.col("_k"))
    dealt = lambda df: df.repartition("s", "key").sortWithinPartitions("s", "key", "fp").mapInArrow
    found = dealt(posts.join(held, same, "left_anti").select("s", "key", "fp"))(lambda it: release(_tally(it)), "p long, x long")
    found = stored(found, "simhash-links")
    if not long_ones.limit(1).count():
        discard(long_ones)
        return found
    more = F.lit(None)
    for k, four in enumerate(FOURS):
        more = F.when(F.col("s") == k, F.array(*[F.lit(i) for i, six in enumerate(SIXES) if set(four) <= set(six)])).otherwise(more)
    masks = F.array(*[F.lit(mask(x)) for x in SIXES])
    wide = posts.join(held, same).select(F.explode(more).alias("s"), "fp").select("s", F.col("fp").bitwiseAND(F.element_at(masks, F.col("s") + 1)).alias("key"), "fp").distinct()
    wide = stored(dealt(wide.select(F.col("s").cast("int").alias("s"), "key", "fp"))(lambda it: release(_look_up(it)), "p long, x long"), "simhash-wide")
    both = stored(found.unionByName(wide).distinct(), "simhash-all")
    discard(long_ones, found, wide)
    return both


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id it reaches."""
    rows = stored(fingerprints(docs, n), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    found = links(nodes.select("fp"))
    roots = stored(components(found), "simhash-roots")
    discard(found)
    mine = nodes.join(small(roots), F.col("fp") == F.col("_v"), "left").withColumn("root", F.coalesce("root", "fp")).drop("_v")
    mine = stored(mine, "simhash-mine")
    first = mine.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    answer = mine.join(first, F.col("root") == F.col("_r")).select(F.col("fp").alias("_fp"), "copies", "component_id")
    answer = stored(answer, "simhash-answer")
    discard(nodes, roots, mine)
    # a fingerprint of many copies isn't joined by a shuffle; there are at most rows / MANY_COPIES of them
    many = small(answer.filter(F.col("copies") >= MANY_COPIES))
    some = answer.filter(F.col("copies") < MANY_COPIES)
    same = F.col("fp") == F.col("_fp")
    joined = rows.join(many, same, "left_anti").join(small(some), same).unionByName(rows.join(many, same))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
