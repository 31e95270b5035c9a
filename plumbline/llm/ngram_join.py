"""Exact set-similarity self-join on word n-grams, with skipping by set relations.

Equal sets collapse to one node first. Then:

1. Index. Every node's rarest elements (as many as a link needs at least one of) enter lists. A list whose
   nodes are connected already is skipped whole; of the others, a node is skipped if sizes and positions rule
   out a link with every other node of the list, told from the list's extremes.
2. Heads. Nodes of a list meet its head, the node that most lists hold: as many comparisons as entries. Nodes
   that link are connected. Where at most FEW nodes are outside a list's main component they meet all others that sizes
   and positions leave; a longer list goes on with step 3.
3. Answers from answers. What a node x differs by from the head h, D(x), is its answer. For two nodes that met
   the same head, |D(x) & D(y)| = (|D(x)| + |D(y)| - |x ^ y|) / 2. If both link to h they are connected. If not,
   a link between them needs common elements in D(x) and D(y), however little D(x) has. So the rarest elements of
   the differences enter lists of their own, under h, and steps 1 to 3 go on with these until none is left.

In a group of near copies the differences are mostly what each copy has alone, so lists under a head are few and
short where lists of elements are as long as the group. No pair within a list or group is emitted as such.

Links are as exact as hashes: names of sets have 128 bits; elements have 56, so that in two sets of 100,000
elements together a false common element has a chance below 10^-6, and in usual ones below 10^-11. Any pair that links
shares an entry of a list at each step, is compared, or is connected by links that were found. Components come from
star contraction in Spark. The driver receives one table of COUNTERS rows.

Cases: a null text or one without words has the empty set, links with nothing and is its own component; a
text of fewer words than n is one whole sequence; texts of any length are one set each; rows with the same id are
told apart by their sets; null ids don't count as smallest unless all of a component are null; ties between heads go
to the node that was numbered last and change no result; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, release, ship, small, stored

#: Counters of the elements' frequencies, which order them: any fixed function of an element keeps the join
#: exact. Elements that come once among WINDOW neighbours aren't counted, so that counters hold little else
#: than what documents share. There are 4 counters or more for each counted element, 1 << MOST_BITS at most; a counter
#: is kept as STEPS times its logarithm in a byte. They are gathered in segments of 1 << SEGMENT_BITS.
LEAST_BITS, MOST_BITS, SEGMENT_BITS, STEPS = 20, 26, 12, 6
WINDOW = 1 << 21
#: Elements counted at least so often have their list dealt over 1 << SALT_BITS - 1 tasks.
HOT, SALT_BITS = 50_000, 6
#: Members of a head that meet it in one task at a time.
MEMBERS = 256
#: Edges whose components one task finds.
EDGES_A_TASK = 100_000
#: Nodes of a list outside its main component up to which they meet all of the list; in other lists nodes meet the head.
FEW = 32
#: Nodes of a group under one head, and their elements, up to which they are compared in one task.
GROUP, GROUP_ELEMENTS = 2_048, 4_000_000
#: Heads that a pair of sets can have met, one after the other, before what is left in lists meets directly.
LEVELS = 24
#: Copies of a set from which on their rows aren't joined by a shuffle.
MANY_COPIES = 50_000
#: Narrow rows (a node) up to which they are broadcast.
WANTED_ROWS = 500_000
SLICE = 1 << 18
ROOT = 0x9E3779B97F4A7C15 | 1
U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_places = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(ROOT, -1, 1 << 64)
    out = []
    for r in (ROOT, inverse):
        x = np.full(n, r, U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct n-word shingles, A-Z lower-cased."""
    low = 0
    while low < len(texts):
        high, held = low, 0
        while high < len(texts) and (high == low or held + len(texts[high]) < SLICE):
            held += len(texts[high]) + 1
            high += 1
        part = texts[low:high]
        low = high
        buf = _lower[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)]
        size = 1 << max(18, int(len(buf)).bit_length())
        up, down = _powers(size)
        inside = ~_space[buf]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], dtype=U)))
        word = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
        ends = np.cumsum([len(t) + 1 for t in part])
        cuts = np.concatenate(([0], np.searchsorted(begin, ends)))
        m = max(0, len(word) - n + 1)
        grams = np.zeros(m, U)
        for k in range(n):
            grams += word[k : k + m] * _places[k]
        grams = _mix(grams)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                yield _mix((word[a:b] * _places[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)


def _name(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, in two halves."""
    a = int(_mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum()) + len(s)
    b = int(_mix(s * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9)).sum()) + len(s) * ROOT
    return tuple((x & (1 << 64) - 1) - ((x >> 63 & 1) << 64) for x in (a, b))


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def pack(s: np.ndarray) -> bytes:
    """The high 56 bits of each element."""
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view(U).ravel()


DESCRIBED = "kind int, uid long, doc_id long, th long, n int, hi long, lo long"


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a row for each document. Kind 1: a counter (uid) and by how much to raise it (th)."""
    from pyspark import TaskContext

    held: list[np.ndarray] = []
    size, uid = 0, TaskContext.get().partitionId() << 36
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 2]

    def batch(*columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in DESCRIBED.split(", ")])

    def counts() -> Iterator[pa.RecordBatch]:
        s = np.sort(np.concatenate(held))
        held.clear()
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        times = np.diff(np.concatenate((new, [len(s)])))
        many = np.flatnonzero(times > 1)
        at, times = (s[new[many]] >> U(64 - MOST_BITS)).astype(np.int64), times[many]
        for k in range(0, len(at), 100_000):
            none = pa.nulls(len(at[k : k + 100_000]), pa.int64())
            yield batch(np.ones(len(none), np.int32), at[k : k + 100_000], none, times[k : k + 100_000], none.cast(pa.int32()), none, none)

    for b in batches:
        rows = b.num_rows
        sizes, names = [], []
        for s in shingle_sets(_texts(b.column(2)), n):
            sizes.append(len(s))
            names.append(_name(s))
            if len(s):
                held.append(s)
                size += len(s)
                if size >= WINDOW:
                    yield from counts()
                    size = 0
        yield batch(np.zeros(rows, np.int32), np.arange(uid, uid + rows), b.column(0), b.column(1), sizes, [x[0] for x in names], [x[1] for x in names])
        uid += rows
    if held:
        yield from counts()


class Ranks:
    """How often elements come, as far as it was counted: by the highest `bits` of an element, a byte."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table
        self.hot_from = int(STEPS * np.log2(HOT + 1.0))

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.table[(s >> U(64 - self.bits)).astype(np.int64)]

    def order(self, s: np.ndarray) -> np.ndarray:
        """The order of a sorted set's elements, rarest first: by rank, then by themselves."""
        return np.argsort(self.of(s), kind="stable")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, place, c), all of a segment in one task and sorted, to (segment, bytes)."""
    own, table = None, None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["segment", "ranks"])

    for b in batches:
        segments, places = b.column(0).to_numpy(), b.column(1).to_numpy()
        ranks = np.minimum(STEPS * np.log2(b.column(2).to_numpy() + 1.0), 255).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(segments, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(segments)], strict=True):
            if segments[a] != own:
                if own is not None:
                    yield batch()
                own, table = int(segments[a]), np.zeros(1 << SEGMENT_BITS, np.uint8)
            table[places[a:z]] = ranks[a:z]
    if own is not None:
        yield batch()


def ranks(counted: DataFrame) -> Ranks:
    """counted (uid, th): counters and by how much to raise them. The driver receives a byte for each counter."""
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * counted.count()).bit_length()))
    at = F.shiftright("uid", MOST_BITS - bits)
    sums = counted.groupBy(at.alias("at")).agg(F.sum("th").alias("c"))
    dealt = sums.select(F.shiftright("at", SEGMENT_BITS).cast("int").alias("segment"), F.col("at").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int").alias("place"), "c")
    got = dealt.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda it: release(_segments(it)), "segment int, ranks binary").toArrow()
    table = np.zeros(1 << bits, np.uint8)
    for k, x in zip(got["segment"].to_pylist(), got["ranks"], strict=True):
        table[k << SEGMENT_BITS : k + 1 << SEGMENT_BITS] = np.frombuffer(x.as_buffer(), np.uint8)
    return Ranks(bits, table)


POSTINGS = "key long, hi long, n int, pos int"


def _post(batches: Iterator[pa.RecordBatch], n: int, percent: int, ranks: Ranks) -> Iterator[pa.RecordBatch]:
    """The rarest elements of each set. A key is an element and below it a salt, which is 0 unless the element is hot."""
    seen: set[int] = set()
    for b in batches:
        keys, names, sizes, places = [], [], [], []
        for s in shingle_sets(_texts(b.column(0)), n):
            name = _name(s)[0]
            if not len(s) or name in seen:
                continue  # a copy within this task; doubles across tasks do no harm
            if len(seen) < 1_000_000:
                seen.add(name)
            k = len(s) - (percent * len(s) + 99) // 100 + 1
            first = s[ranks.order(s)[:k]]
            salt = np.where(ranks.of(first) >= ranks.hot_from, U(1 + (name ^ name >> 32) % ((1 << SALT_BITS) - 1)), U(0))
            keys.append(((first >> U(8)) << U(SALT_BITS) | salt).view(np.int64))
            names.append(np.full(k, name, np.int64))
            sizes.append(np.full(k, len(s), np.int32))
            places.append(np.arange(k, dtype=np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, names, sizes, places)], names=["key", "hi", "n", "pos"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(node, name, text) to (node, els), where the text's set has that name."""
    for b in batches:
        nodes, sets = [], []
        for node, name, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(_texts(b.column(2)), n), strict=True):
            if _name(s)[0] == name:
                nodes.append(node)
                sets.append(pack(s))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "els"])


COMPARED = "p long, x long, np int, nx int, o int, linked boolean, els array<long>"


def _compare(batches: Iterator[pa.RecordBatch], percent: int, ranks: Ranks) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head and part, the head's own first: its overlap with each of the others, and, where others
    may have met the head as well, the rarest elements of the difference. The least number of elements that the
    differences of x and y have in common, if x and y link and not both link to h, is bounded from x alone: with
    f = 100 + percent, g = 100 - percent, a and h the sizes of x and the head and d that of x's difference,
    - y not linked to h (f |D(y)| > g (|y| + h)): 2 f common > f d + g (h - a);
    - x not linked, y linked (|y| <= h + |D(y)|, |D(y)| >= 1): 2 f common >= f d - g (h + a) + 2 percent.
    Elements that x has and the head lacks come first. A link needs percent of x's elements; if the head has fewer of
    them, the rest are among those, and no more of them are needed than of a whole set."""
    f, g = 100 + percent, 100 - percent
    group, own, last = None, None, None
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
    for b in batches:
        out = []
        data = b.column("els")
        for k, (p, part, role, x, more) in enumerate(zip(*(b.column(c).to_pylist() for c in ("p", "part", "role", "x", "more")), strict=True)):
            if role == 0:
                if (p, part) != group:
                    group, own, last = (p, part), unpack(data[k].as_buffer().to_pybytes()), None
                continue
            if (p, part) != group or x == last:
                continue
            last, s = x, unpack(data[k].as_buffer().to_pybytes())
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            hit = own[at] == s
            o, h, a = int(hit.sum()), len(own), len(s)
            d = h + a - 2 * o
            linked = f * d <= g * (h + a)
            els = np.zeros(0, np.int64)
            if more:
                least = (f * d + g * (h - a)) // (2 * f) + 1 if linked else max(1, -(-(f * d - g * (h + a) + 2 * percent) // (2 * f)))
                if least <= d:
                    lost = np.ones(h, bool)
                    lost[at[hit]] = False
                    mine, lost = s[~hit], own[lost]
                    most = d - least + 1
                    if (enough := (percent * a + 99) // 100) > o:
                        most = min(most, a - enough + 1)
                    els = np.concatenate((mine[ranks.order(mine)], lost[ranks.order(lost)]))[:most]
                    els = (els >> U(8)).view(np.int64)
            out.append((p, x, h, a, o, linked, els))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in COMPARED.split(", ")])


def _within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, els), sorted by group and node: a forest of the links (p, x) within each group. Overlaps are products of
    the nodes' incidence with the elements that some of them share, some columns at a time."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        new = np.concatenate(([True], element[1:] != element[:-1]))
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        owner, number = owner[shared], np.cumsum(new[shared]) - 1
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            a, z = np.searchsorted(number, (low, low + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[a:z], number[a:z] - low] = 1
            overlap += m @ m.T
        root = np.arange(len(sets))
        p, x = [], []
        for k in range(len(sets) - 1):  # links that join trees are enough
            o = np.rint(overlap[k, k + 1 :]).astype(np.int64)
            for j in (k + 1 + np.flatnonzero((100 * o >= percent * (sizes[k] + sizes[k + 1 :] - o)) & (root[k + 1 :] != root[k]))).tolist():
                if root[j] != root[k]:
                    root[root == root[j]] = root[k]
                    p.append(nodes[k])
                    x.append(nodes[j])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(x, pa.int64())], names=["p", "x"])

    own, nodes, sets = None, [], []
    for b in batches:
        for group, node, els in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if group != own:
                if len(nodes) > 1:
                    yield from links(nodes, sets)
                own, nodes, sets = group, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(unpack(els.as_buffer().to_pybytes()))
    if len(nodes) > 1:
        yield from links(nodes, sets)


def _side(df: DataFrame, k: int) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{k}") for c in df.columns])


class Join:
    """The self-join of docs (doc_id, text): links and components of texts whose n-word shingle sets have a
    Jaccard similarity of at least percent / 100."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80):
        ship(docs.sparkSession)
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        text = F.col("text").cast("string")
        self.docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
        self.kept: list[DataFrame] = []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        out = stored(df, f"join-{what}")
        self.kept.append(out)
        return out

    def could(self, n1: Column, d1: Column, rest1: Column, n2: Column, d2: Column, rest2: Column) -> Column:
        """Whether sets of sizes n1 and n2, whose differences from one head (or which themselves) have d1 and d2
        elements, could link if those have at most rest1 and rest2 elements from here on."""
        f, g = 100 + self.percent, 100 - self.percent
        return 2 * f * F.least(rest1, rest2) >= f * (d1 + d2) - g * (n1 + n2)

    def compare(self, pairs: DataFrame, nodes: DataFrame, held) -> DataFrame:
        """Distinct pairs (p, x, more) of nodes to COMPARED. Only the texts of these nodes are read, and a set meets its
        head in parts of about MEMBERS sets."""
        percent = self.percent
        pairs = self.stored(pairs, "pairs")
        parts = self.stored(pairs.groupBy("p").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts")).withColumnRenamed("p", "_p"), "parts")
        part = F.pmod(F.xxhash64("x"), F.col("_parts")).cast("int")
        members = pairs.join(small(parts), F.col("p") == F.col("_p")).select(F.col("x").alias("_node"), "p", part.alias("part"), F.lit(1).alias("role"), "more")
        heads = parts.select(F.col("_p").alias("_node"), F.col("_p").alias("p"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(False).alias("more"))
        members = self.stored(members.unionByName(heads), "members")
        dealt = self.sets(members, nodes).join(small(members), F.col("node") == F.col("_node")).select("p", "part", "role", F.col("node").alias("x"), "more", "els")
        dealt = dealt.repartition("p", "part").sortWithinPartitions("p", "part", "role", "x")
        return self.stored(dealt.mapInArrow(lambda it: release(_compare(it, percent, held.value)), COMPARED), "compared")

    def sets(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, els) of the nodes among members (_node)."""
        n = self.n
        wanted = nodes.join(small(self.stored(members.select("_node").distinct(), "nodes-wanted")), F.col("node") == F.col("_node"))
        wanted = small(self.stored(wanted.select("node", "hi", F.col("least.doc_id").alias("_id"), F.col("least.th").alias("_th")), "wanted"), WANTED_ROWS)
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "hi", "text")
        return texts.mapInArrow(lambda it: release(_sets(it, n)), "node long, els binary")

    def within(self, groups: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links (p, x) between the nodes of each of groups (base, _node), which are of bounded size."""
        percent = self.percent
        groups = self.stored(groups, "groups")
        dealt = self.sets(groups, nodes).join(small(groups), F.col("node") == F.col("_node")).select("base", "node", "els")
        dealt = dealt.repartition("base").sortWithinPartitions("base", "node")
        return self.stored(dealt.mapInArrow(lambda it: release(_within(it, percent)), "p long, x long"), "within")

    def usable(self, lists: DataFrame, roots: DataFrame, score: DataFrame, first: bool) -> DataFrame:
        """lists (token, base, node, n, d, pos, linked) without what can't hold a link between components, with `root`, each
        list's `head`, and `k`, its nodes that are `out` of its main component, that of the node with the highest score. A
        list's extremes tell whether a node could link with any node outside its own component."""
        own = lists.join(small(roots), F.col("node") == F.col("_v"), "left").withColumn("root", F.coalesce("root", "node")).drop("_v")
        own = own.join(small(score), F.col("node") == F.col("_s"), "left").withColumn("score", F.coalesce("score", F.lit(0))).drop("_s")
        if not first:  # at first every node is a component
            main = self.stored(own, "scored").groupBy("token").agg(F.max(F.struct("score", "node", "root"))["root"].alias("_m")).withColumnRenamed("token", "_t")
            own = self.kept[-1].join(small(self.stored(main, "mains")), F.col("token") == F.col("_t")).withColumn("out", F.col("root") != F.col("_m")).drop("_t", "_m")
        else:
            own = own.withColumn("out", F.lit(True))
        own = self.stored(own, "own")
        if first:
            left = own.drop("w")
        out, rest = F.col("out"), F.col("d") - F.col("pos")
        extremes = lambda when, k: [F.count_if(when).alias(f"c{k}"), F.min(F.when(when, F.col("d"))).alias(f"d{k}"), F.max(F.when(when, F.col("n"))).alias(f"n{k}"), F.max(F.when(when, rest)).alias(f"r{k}")]
        stats = own.groupBy("token").agg(*extremes(out, 0), *extremes(~out, 1)).filter("c0 > 0 and c0 + c1 > 1").withColumnRenamed("token", "_t")
        test = lambda k: self.could(F.col("n"), F.col("d"), rest, F.col(f"n{k}"), F.col(f"d{k}"), F.col(f"r{k}"))
        fits = F.when(out, ((F.col("c0") > 1) & test(0)) | ((F.col("c1") > 0) & test(1))).otherwise(test(0))
        if not first:  # at first that is done where the lists are made
            left = own.join(small(self.stored(stats, "stats")), F.col("token") == F.col("_t")).filter(fits).select(*own.columns)
            left = self.stored(left, "left")
        head = F.max(F.struct((~F.col("linked")).alias("_f"), "score", "node", "n", "d", "pos", "root")).alias("head")
        k = F.count("*") - 1 if first else F.count_if(out)
        heads = left.groupBy("token").agg(F.count("*").alias("m"), k.alias("k"), head, F.min("root").alias("_a"), F.max("root").alias("_b"))
        heads = self.stored(heads.filter("m > 1 and k > 0 and _a <> _b").select(F.col("token").alias("_t"), "k", "head"), "heads")
        return self.stored(left.join(small(heads), F.col("token") == F.col("_t")).drop("_t", "score"), "usable")

    def direct(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs (p, x, more) of nodes of a list, without its head, that could link and aren't connected. One of them is out of
        the main component, as few nodes of these lists are."""
        at = lists.filter(F.col("node") != F.col("head.node")).drop("root", "head", "k", "base")
        at = at.join(small(roots), F.col("node") == F.col("_v"), "left").withColumn("root", F.coalesce("root", "node")).drop("_v")
        a, b = _side(at.filter("out"), 1), _side(at, 2)
        c = F.col
        fit = self.could(c("n1"), c("d1"), c("d1") - c("pos1"), c("n2"), c("d2"), c("d2") - c("pos2")) & ~(c("linked1") & c("linked2"))
        pairs = a.join(b, (c("token1") == c("token2")) & (~c("out2") | (c("node1") < c("node2"))) & (c("root1") != c("root2")) & fit)
        return pairs.select(F.least("node1", "node2").alias("p"), F.greatest("node1", "node2").alias("x"), F.lit(False).alias("more")).distinct()

    def run(self) -> DataFrame:
        """One row for each row of docs: doc_id, th, n_shingles, component_id, n_links (the links found of its set) and
        keeper (doc_id and th of the least row of its component, null without words)."""
        n, percent = self.n, self.percent
        described = stored(self.docs.mapInArrow(lambda it: release(_describe(it, n)), DESCRIBED), "join-described")
        rows = described.filter("kind = 0")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
        nodes = rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("uid").alias("node"), F.max("n").alias("n"), F.count("*").alias("copies"), least.alias("least"))
        nodes = self.stored(nodes, "nodes")

        held = self.spark.sparkContext.broadcast(ranks(described.filter("kind = 1").select("uid", "th")))
        posts = self.docs.select("text").mapInArrow(lambda it: release(_post(it, n, percent, held.value)), POSTINGS)
        # a list is told from its extremes while all of it is in one task, which only hot ones aren't
        w, rest = Window.partitionBy("key"), F.col("n") - F.col("pos")
        extremes = {"_a": F.min("hi").over(w), "_b": F.max("hi").over(w), "_n": F.min("n").over(w), "_r": F.max(rest).over(w), "_m": F.count("*").over(w)}
        fits = self.could(F.col("n"), F.col("n"), rest, F.col("_n"), F.col("_n"), F.col("_r"))
        posts = posts.withColumns(extremes).filter((F.col("key") % (1 << SALT_BITS) != 0) | ((F.col("_a") != F.col("_b")) & fits))
        posts = posts.select("key", "hi", "n", "pos", F.floor(F.log2("_m") * 1024).alias("w")).dropDuplicates(["key", "hi"])
        posts = self.stored(posts, "posts")
        named = nodes.select(F.col("hi").alias("_hi"), F.col("n").alias("_n"), "node")
        lists = posts.join(small(named, WANTED_ROWS), (F.col("hi") == F.col("_hi")) & (F.col("n") == F.col("_n")))
        lists = self.stored(lists.select(F.shiftrightunsigned("key", SALT_BITS).alias("token"), "node", "n", F.col("n").alias("d"), "pos", F.lit(False).alias("linked"), F.lit(None).cast("long").alias("base"), "w"), "lists")
        # nodes that most lists hold, long ones counting more, are heads
        score = self.stored(lists.groupBy(F.col("node").alias("_s")).agg(F.sum("w").alias("score")), "score")
        # different sets whose names agree in their first half never meet in a list of these
        twins = nodes.groupBy("hi").agg(F.count("*").alias("c"), F.collect_set("node").alias("all")).filter("c > 1")
        pending = twins.select(F.array_min("all").alias("p"), F.explode("all").alias("x"), F.lit(False).alias("more")).filter("p <> x")

        links = self.spark.createDataFrame([], "p long, x long")
        roots = links.select(F.col("p").alias("_v"), F.col("x").alias("root"))
        total = nodes.count()
        discard(*[df for df in self.kept if not any(df is x for x in (nodes, score, lists))])
        state = [lists]
        for level in itertools.count():
            self.kept = []
            lists = self.usable(lists, roots, score, not level)
            # groups under one head, of bounded size, are answered at once
            small_groups = lists.filter("base is not null").select("base", "node", "n").distinct().groupBy("base").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter((F.col("c") <= GROUP) & (F.col("s") <= GROUP_ELEMENTS))
            small_groups = small(self.stored(small_groups.select(F.col("base").alias("_base")), "small-groups"))
            inside = lists.join(small_groups, F.col("base") == F.col("_base"), "left_semi").select("base", F.col("node").alias("_node")).distinct()
            inside = self.within(inside, nodes) if level else roots.select(F.col("_v").alias("p"), F.col("root").alias("x"))
            lists = lists.join(small_groups, F.col("base") == F.col("_base"), "left_anti")
            # what is left meets directly where that makes few pairs for all the nodes
            few = FEW if level < LEVELS and 2 * (lists.agg(F.sum("k")).first()[0] or 0) > total else 1 << 62
            # the head meets every other node of a list; of a short list only those that could link with it
            head = F.col("head")
            could = self.could(F.col("n"), F.col("d"), F.col("d") - F.col("pos"), head["n"], head["d"], head["d"] - head["pos"])
            pairs = lists.filter((F.col("node") != head["node"]) & ((F.col("k") > few) | ((F.col("root") != head["root"]) & could)))
            pairs = pairs.select(head["node"].alias("p"), F.col("node").alias("x"), (F.col("k") > few).alias("more"))
            found = self.compare(pairs.unionByName(pending).groupBy("p", "x").agg(F.max("more").alias("more")), nodes, held)
            new = found.filter("linked").select("p", "x").unionByName(inside).distinct()
            joined = roots.select(F.col("_v").alias("p"), F.col("root").alias("x")).unionByName(new)
            links = stored(links.unionByName(new).distinct(), "join-links")
            roots = stored(components(joined), "join-roots")
            pending = stored(self.direct(lists.filter(F.col("k") <= few), roots), "join-pending")
            element = F.posexplode("els").alias("pos", "el")
            lists = found.select("p", F.col("x").alias("node"), F.col("nx").alias("n"), (F.col("np") + F.col("nx") - 2 * F.col("o")).alias("d"), "linked", element)
            lists = stored(lists.select(F.xxhash64("p", "el").alias("token"), F.col("p").alias("base"), "node", "n", "d", "pos", "linked").dropDuplicates(["token", "node"]), "join-lists")
            discard(*self.kept, *state)
            state = self.kept = [links, roots, pending, lists]
            if not lists.limit(1).count() and not pending.limit(1).count():
                break
        degree = links.select(F.explode(F.array("p", "x")).alias("_n")).groupBy("_n").agg(F.count("*").alias("n_links"))
        mine = nodes.join(small(roots), F.col("node") == F.col("_v"), "left").withColumn("root", F.coalesce("root", "node")).drop("_v")
        mine = self.stored(mine, "mine")
        first = mine.groupBy("root").agg(F.min("least").alias("keeper"), F.min("least.doc_id").alias("component_id")).withColumnRenamed("root", "_r")
        mine = mine.join(first, F.col("root") == F.col("_r")).join(degree, F.col("node") == F.col("_n"), "left")
        answer = mine.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "copies", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.struct("keeper.doc_id", "keeper.th").alias("keeper"))
        answer = stored(answer, "join-answer")
        discard(*self.kept, nodes, score)
        held.destroy()
        # a set of many copies isn't joined by a shuffle; there are at most rows / MANY_COPIES of them
        slim = rows.filter("n > 0").select("doc_id", "th", "n", "hi", "lo")
        same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
        many = small(answer.filter(F.col("copies") >= MANY_COPIES))
        some = slim.join(many, same, "left_anti").join(answer.filter(F.col("copies") < MANY_COPIES), same)
        names = ["doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "keeper"]
        none = rows.filter("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("struct<doc_id: bigint, th: bigint>").alias("keeper"))
        return some.select(*names).unionByName(slim.join(many, same).select(*names)).unionByName(none)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task to stars around the least node of each of their components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y] if y in root else y
            x = y
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                root[max(a, c)] = min(a, c)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame, part: int = EDGES_A_TASK) -> DataFrame:
    """Links (p, x) to (_v, root): the least node that each linked node reaches.

    Parts of about `part` edges are contracted each in a task. With one part that is the answer; with more,
    alternating star contraction joins the parts' stars.
    """
    edges = links.select(F.greatest("p", "x").alias("u"), F.least("p", "x").alias("v"))
    parts = max(1, -(-edges.count() // part))
    edges = edges.coalesce(parts).mapInArrow(lambda it: release(_contract(it)), "u long, v long").filter("u <> v")
    edges = stored(edges, "join-edges")
    if parts == 1:
        return edges.select(F.col("u").alias("_v"), F.col("v").alias("root"))
    before = None
    while True:  # until a round changes nothing; rounds grow with the logarithm of the nodes
        # large star: every larger neighbour moves to the least of the neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        edges = both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        moved = edges.join(least, F.col("u") == F.col("_u"))
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(edges, "join-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("_v"), F.col("v").alias("root"))
        before = now


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, null ids last, and of rows of one id that of the
    least hash of its text. Rows without words stay; other columns, whatever their names, stay as they are."""
    found = stored(Join(docs, n, percent).run().filter("keeper is not null").select("doc_id", "th", "keeper"), "join-found")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("th") == F.col("keeper.th"))
    gone = stored(found.filter(~is_keeper).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "join-gone")
    again = stored(found.filter(is_keeper).groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "join-again")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th"))
    left = rows.join(small(gone), same, "left_anti")
    if again.limit(1).count():  # repeated rows of a keeper
        twice = left.join(small(again), same, "left_semi").groupBy("_doc", "_hash").agg(F.first("_row").alias("_row")).select("_row")
        left = left.join(small(again), same, "left_anti").select("_row").unionByName(twice)
    return left.select("_row.*")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)]) END AS sh
  FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, x) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.x = e.a),
m AS (SELECT v, min(x) AS x FROM r GROUP BY v)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.x, s.doc_id)) AS component_id
FROM s LEFT JOIN m ON s.doc_id = m.v
"""
