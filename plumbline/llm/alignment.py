"""Alignment of the tokens of two tokenizers, and how often their tokens meet across the corpus.

Tokens of a text are cut into minimal groups: A and B tokens are the two sides of a graph whose edges are overlaps of
byte ranges, and union-find over it gives components, which are exactly the groups between places where tokens of both
end. The members of a component expand its links. A text is cut first before each single blank that a character other
than a blank precedes and one other than white space follows. Neither tokenizer has a token across such a place, so
each of these keys is encoded and aligned once and remembered; a text's groups are those of its keys in order.

Each text's distinct linked id pairs go through one grouping, which gives the number of documents of each pair. Of
these counts the HOT_PAIRS highest at most are handed to all tasks; pairs beyond them meet their counts in a join by
pair. What is handed out is bounded by that parameter and the vocabulary, whatever the corpus holds.

Cases: null and empty texts, and those whose tokens don't give back their bytes (a literal U+2581, say), have no
tokens, zeros and the empty string; their pairs aren't counted. Very long texts are worked on in sections. Repeated
rows, equal ids and null ids are rows of their own, and each counts as a document. Of tied counts all are best. An
empty table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, local_file, release, ship, stored

#: Pairs whose counts tasks hold (17 bytes each); others are joined.
HOT_PAIRS = 1 << 21
#: Keys, and their characters, that a worker remembers; then it forgets all and begins anew.
MEMO_KEYS, MEMO_CHARS = 150_000, 8_000_000
#: Characters worked on at a time, in sections of long texts too.
SECTION = 1 << 20
#: Keys encoded at a time.
ENCODED = 20_000
CUT = re.compile(r"(?<! ) (?=\S)")

LINKED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components, given edges (u, v): roots of all edges are united at once and
    paths halved until no edge joins two roots."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of A and B tokens whose byte ranges overlap, by i and then j; both sides in order without gaps."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _each(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.int64, int(n.sum())), n


class Aligner:
    """Two tokenizers and what is known of keys: n (A tokens, B tokens, groups), good, groups as text, linked pairs."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(local_file(a_path))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=local_file(b_path))
        level = byte_level()
        a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(level[c] for c in t) if all(c in level for c in t) else t.encode() for t in map(self.a.id_to_token, range(a_size))]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b_size)]
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.decimal = [f"{i}{end}" for i in range(a_size) for end in ",|"] + [f"{i}{end}" for i in range(self.b_size) for end in (",", ";", "")]
        self.a_size = a_size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.text = 0, []
        self.n = np.zeros((0, 3), np.int64)
        self.good = np.zeros(0, bool)
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def learn(self, keys: list[str]) -> None:
        """Encode and align keys that aren't known."""
        for low in range(0, len(keys), ENCODED):
            self._learn(keys[low : low + ENCODED])

    def _learn(self, keys: list[str]) -> None:
        whole = [k if k[0] == " " else " " + k for k in keys]
        a_ids = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        b_ids = self.b.encode([w[1:] for w in whole], num_threads=1)
        good = np.zeros(len(keys), bool)
        for k, (w, x, y) in enumerate(zip(whole, a_ids, b_ids, strict=True)):
            data = w.encode()
            good[k] = b"".join(map(self.a_bytes.__getitem__, x)) == data == b"".join(map(self.b_bytes.__getitem__, y))
            if not good[k]:
                a_ids[k] = b_ids[k] = []
        (a, a_n), (b, b_n) = _each(a_ids), _each(b_ids)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])  # keys one after the other
        i, j = overlaps(a_end - self.a_len[a], a_end, b_end - self.b_len[b], b_end)
        root = union_find(len(a) + len(b), i, len(a) + j)
        a_root, b_root = root[: len(a)], root[len(a) :]
        # members of a component in order: its A tokens, then its B tokens, each with what stands after it
        order = np.lexsort((np.arange(len(root)), root))
        code, of_key = np.zeros(len(root), np.int64), np.concatenate((np.repeat(np.arange(len(keys)), a_n), np.repeat(np.arange(len(keys)), b_n)))
        last = np.concatenate((a_root[1:] != a_root[:-1], [True])) if len(a) else np.zeros(0, bool)
        code[: len(a)] = a * 2 + last
        last = np.concatenate((b_root[1:] != b_root[:-1], [True])) if len(b) else np.zeros(0, bool)
        end = np.zeros(len(b), bool)
        end[np.cumsum(b_n)[b_n > 0] - 1] = True
        code[len(a) :] = 2 * self.a_size + b * 3 + np.where(end, 2, last)
        shown = list(map(self.decimal.__getitem__, code[order].tolist()))
        cuts = np.searchsorted(of_key[order], np.arange(len(keys) + 1)).tolist()
        first = np.zeros(len(a), bool)
        first[np.unique(a_root)] = True
        groups = np.bincount(of_key[: len(a)], weights=first, minlength=len(keys)).astype(np.int64)
        links = np.bincount(of_key[i], minlength=len(keys))
        for k, key in enumerate(keys):
            self.known[key] = len(self.text)
            self.text.append("".join(shown[cuts[k] : cuts[k + 1]]))
            self.chars += len(key)
        self.n = np.concatenate((self.n, np.stack((a_n, b_n, groups), 1)))
        self.good = np.concatenate((self.good, good))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(links)))
        self.pairs = np.concatenate((self.pairs, a[i] * self.b_size + b[j]))

    def align(self, sections: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each section, which begins with a blank: its groups as text, n, good; and of all, (section, pair) as one number and its times."""
        split = [CUT.split(s) for s in sections]
        keys = [x if x[0] else x[1:] for x in split]
        if len(self.known) >= MEMO_KEYS or self.chars >= MEMO_CHARS:
            self.forget()
        self.learn(list({k for x in keys for k in x if k not in self.known}))
        known, text = self.known, self.text
        index = [list(map(known.__getitem__, x)) for x in keys]
        shown = [";".join(map(text.__getitem__, x)) for x in index]
        flat, sizes = _each(index)
        of = np.repeat(np.arange(len(sections)), sizes)
        n = np.stack([np.bincount(of, weights=self.n[flat, c], minlength=len(sections)) for c in range(3)], 1).astype(np.int64)
        good = np.bincount(of[~self.good[flat]], minlength=len(sections)) == 0
        links = self.at[flat + 1] - self.at[flat]
        place = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links) + np.repeat(self.at[flat], links)
        space = self.a_size * self.b_size
        number, times = np.unique(np.repeat(of, links) * space + self.pairs[place], return_counts=True)
        return shown, n, good, number, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def sections(text: str) -> Iterator[str]:
    """A blank and the text, cut where neither tokenizer has a token across, into about SECTION characters each."""
    whole, low = " " + text, 0
    while len(whole) - low > SECTION and (m := CUT.search(whole, low + SECTION)):
        yield whole[low : m.start()]
        low = m.start()
    yield whole[low:]


def _link(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    two, uid = aligner(a_path, b_path), TaskContext.get().partitionId() << 36
    space = two.a_size * two.b_size
    for b in batches:
        rows = b.num_rows
        n, good, sha = np.zeros((rows, 3), np.int64), np.zeros(rows, bool), [None] * rows
        shown: list[list[str]] = [[] for _ in range(rows)]
        numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def work(units: list[tuple[int, str]], n=n, good=good, sha=sha, shown=shown, numbers=numbers, counts=counts) -> None:
            texts, each, fine, number, times = two.align([s for _, s in units])
            row = np.array([r for r, _ in units])
            np.add.at(n, row, each)
            np.logical_and.at(good, row, fine)
            for r, t in zip(row.tolist(), texts, strict=True):
                if sha[r] is None:
                    sha[r] = hashlib.sha256(t.encode())
                else:
                    sha[r].update(b";" + t.encode())
                if keep:
                    shown[r].append(t)
            numbers.append(row[number // space] * space + number % space)
            counts.append(times)

        units, held = [], 0
        for r, x in enumerate(b.column(1)):
            text = x.as_py()
            if not text:
                continue
            good[r] = True
            for s in sections(text):
                units.append((r, s))
                held += len(s)
                if held >= SECTION:
                    work(units)
                    units, held = [], 0
        if units:
            work(units)
        n[~good] = 0
        number, where = np.unique(np.concatenate(numbers), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate(counts), minlength=len(number)).astype(np.int32)
        kept = good[number // space]
        number, times = number[kept], times[kept]
        ends = pa.array(np.searchsorted(number, np.arange(rows + 1) * space), pa.int32())
        links = np.add.reduceat(np.append(times, 0).astype(np.int64), ends.to_numpy()[:-1]) * (np.diff(ends.to_numpy()) > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(uid, uid + rows)), b.column(0), *[pa.array(n[:, c]) for c in range(3)], pa.array(links),
                pa.array([s.hexdigest() if g else "" for s, g in zip(sha, good.tolist(), strict=True)]), pa.array([";".join(t) if g and keep else None for t, g in zip(shown, good.tolist(), strict=True)], pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(number % space)), pa.ListArray.from_arrays(ends, pa.array(times)),
            ],
            names=[c.split(" ")[0] for c in LINKED.split(", ")],
        )
        uid += rows


def linked(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """A row for each row of docs (LINKED): sizes, groups as `a1,a2|b1;a3|b2,b3` (hashed, and whole if asked for) and the
    distinct linked pairs, a * (size of B's vocabulary) + b, with the number of links of each. uid numbers rows."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: release(_link(it, a_path, b_path, keep_groups)), LINKED)


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, a_id, b_id, docs (rows of `linked` that hold the pair) and best, whether it is the highest of its a_id."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = stored(counts.withColumn("a_id", F.expr(f"pair div {b_size}")), "pair-counts")
    top = counts.groupBy(F.col("a_id").alias("_a")).agg(F.max("docs").alias("_top"))  # a row for each entry of the vocabulary at most
    out = counts.join(F.broadcast(top), F.col("a_id") == F.col("_a"))
    out = stored(out.select("pair", "a_id", (F.col("pair") % b_size).alias("b_id"), "docs", (F.col("docs") == F.col("_top")).alias("best")), "align-counts")
    discard(counts)
    return out


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs that are handed out, and what is left."""
    pairs, docs, best = held.value
    for b in batches:
        lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
        at = lists.offsets.to_numpy()
        own = lists.flatten().to_numpy()
        of = np.repeat(np.arange(b.num_rows), np.diff(at))
        place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
        hit = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
        sums = np.zeros((2, b.num_rows), np.int64)
        np.add.at(sums[0], of[hit], times[hit] * best[place[hit]].astype(np.int64))
        np.add.at(sums[1], of[hit], times[hit] * docs[place[hit]])
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[~hit], minlength=b.num_rows)))), pa.int32())
        left = [pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (own, times)]
        rest = [n for n in b.schema.names if n not in ("pairs", "times")]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), *map(pa.array, sums), *left], names=[*rest, "n_best", "count_sum", "pairs", "times"])


def scores(found: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """found (of `linked`, stored), without its pairs, with n_best and count_sum. counts: of `pair_counts`."""
    spark = found.sparkSession
    # the highest counts, as many as `hot` allows, are those from a threshold on
    per = counts.groupBy(F.floor(F.log2("docs") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("docs").alias("least")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in per:  # at most 8 rows for each doubling of the corpus
        if (total := total + r["n"]) > hot:
            break
        least = r["least"]
    table = counts.filter(F.col("docs") >= F.lit(least)).select("pair", "docs", "best").toArrow() if least is not None else None
    pairs, docs, best = (np.asarray(c) for c in table.columns) if table else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    order = np.argsort(pairs)
    held = spark.sparkContext.broadcast((pairs[order], docs[order], best[order]))
    rest = [c for c in found.columns if c not in ("pairs", "times")]
    schema = ", ".join([*(f"{n} {t}" for n, t in found.select(*rest).dtypes), "n_best long, count_sum long, pairs array<long>, times array<int>"])
    sums = found.select(*rest, "pairs", "times").mapInArrow(lambda it: release(_score(it, held)), schema)
    if total <= hot:
        return sums.drop("pairs", "times")
    sums = stored(sums, "align-sums")
    cold = sums.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("_pair"), F.col("x.times").alias("times"))
    cold = cold.join(counts, F.col("_pair") == F.col("pair"))
    more = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_n"), F.sum(F.col("times") * F.col("docs")).alias("_s")]
    cold = cold.groupBy(F.col("uid").alias("_u")).agg(*more)
    both = sums.join(cold, F.col("uid") == F.col("_u"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_n", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_s", F.lit(0))})
    return both.select(*rest, "n_best", "count_sum")


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    import sentencepiece

    found = stored(linked(docs, a_path, b_path).drop("groups"), "linked")
    size = sentencepiece.SentencePieceProcessor(model_file=local_file(b_path)).get_piece_size()
    return scores(found, pair_counts(found, size)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
