"""Language-model scoring: a gated recurrent network over a vocabulary learned from all of the corpus.

Spark counts every token of every training document. The most frequent words (at most CLOSED) are the
network's; any other token is the unknown word, whose spelling has an add-one share of the counts of all
words outside the network, so what is gathered grows with the corpus. The output is factored: a softmax
over classes of words of like frequency, times one over the words of the class. The network is trained in
numpy by truncated backpropagation, with the state carried from window to window, over every token of every
training document: documents are dealt by hash to shards of about SHARD_TOKENS, each shard trains a copy of the
network on an executor, and the copies are averaged by their tokens. All copies begin from one network that has
learned a small sample (TRAIN_DOCS documents of the least hash, up to TRAIN_TOKENS tokens), without which they would not be
alike enough to average. A lane that begins inside a document begins there from a fresh state.

Scoring reads whole documents: lanes of consecutive documents step together, each document from a fresh
state, carried across windows to its end. Counts of frequent words (HOT at most) go to the tasks; tokens
outside them are counted by document and meet their counts in a join.

Cases: a null or empty text is its end token alone; without training documents c, N and V are 0 and the
network is uniform; rows with the same id are scored apart; any length of text is scored to its end.
"""

from __future__ import annotations

import copy
import ctypes
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, discard, release, ship, small, stored

CLOSED, CLASSES, UNITS = 2_000, 45, 24
#: Words whose counts tasks hold, some 20 MB; the others meet theirs in a join.
HOT = 150_000
TRAIN_DOCS, TRAIN_TOKENS = 600, 260_000
EPOCHS, LANES, WINDOW, RATE, CLIP = 3, 64, 16, 0.008, 1.0
#: Tokens of a shard, about; tokens that a task holds at a time; lanes of shards and the tokens of a lane, at least.
SHARD_TOKENS, BLOCK_TOKENS, SHARD_LANES, LANE_TOKENS = 3_000_000, 1_000_000, 384, 1_024
#: Rate of shards; copies summed in a task.
SHARD_RATE, SUMMED = 0.004, 64
#: Documents that step together in scoring, and text worked on at a time.
SCORE_LANES, SLICE = 384, 16 << 20
END = "\n"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has: A-Z lower-cased, split at the six ASCII
    white-space characters. Nulls have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parents = lists.flatten().cast(pa.string()), pc.list_parent_indices(lists).to_numpy()
    word = pc.greater(pc.binary_length(flat), 0)  # white space at a text's start or end leaves an empty string there
    return flat.filter(word), np.bincount(parents[word.to_numpy(zero_copy_only=False)], minlength=len(texts))


def numbered(texts: pa.Array, known: pa.Array, end: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, their places in known or -1 with `end` put after each text, tokens of each text)."""
    words, sizes = words_of(texts)
    tokens = sizes + 1
    out = np.full(int(tokens.sum()), end, np.int32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(tokens) - 1] = False
    out[inner] = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
    return words, out, tokens


def cut(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


@lru_cache(1)
def reuse_memory() -> None:
    """Has this worker keep freed arrays of some megabytes for the next ones, which a window makes and frees by the dozen,
    rather than ask the system for them each time; `release` gives them back at the task's end."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


class Network:
    """Gated recurrent units over word ids 0 (unknown) to `words` - 1, with a class-factored softmax."""

    def __init__(self, counts: np.ndarray, units: int = UNITS, classes: int = CLASSES, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(counts)
        self.words, self.units = n, units
        self.per = per = -(-n // classes)  # words of a class, by falling frequency; the unknown word has class 0 alone
        self.classes = k = 1 + -(-(n - 1) // per)
        order = np.concatenate(([0], 1 + np.argsort(-counts[1:], kind="stable")))
        self.place = np.empty(n, np.int64)
        self.place[order] = np.concatenate(([0], per + np.arange(n - 1)))
        held = np.zeros(k * per)
        held[self.place] = counts + 1
        held = held.reshape(k, per)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        with np.errstate(divide="ignore"):
            word_bias = np.log(held / held.sum(1, keepdims=True))
        self.p = {
            "E": r(n, units),
            # of the reset gate, the update gate and the candidate: apart, so that each is contiguous
            "W": r(units, 3, units).transpose(1, 0, 2).copy(),
            "U": r(units, 3, units).transpose(1, 0, 2).copy(),
            "b": np.zeros((3, 1, units), np.float32),
            "C": r(units, k) * 0.1,
            "cb": np.log(held.sum(1) / held.sum()).astype(np.float32),
            "O": r(k, units, per) * 0.1,
            "ob": np.maximum(word_bias, -1e9).astype(np.float32),
        }

    def cell(self, xz: np.ndarray, h: np.ndarray, new=None, g=None, a=None, c=None) -> np.ndarray:
        """The next state; into new, and the gates, the candidate's part from h and the candidate into g, a and c, if given."""
        hz = h @ self.p["U"]
        g = np.add(xz[:2], hz[:2], out=g)
        np.negative(g, out=g)
        np.exp(g, out=g)  # infinity makes a gate 0
        g += 1
        np.reciprocal(g, out=g)
        if a is not None:
            a[...] = hz[2]
        c = np.multiply(g[0], hz[2], out=c)
        c += xz[2]
        np.tanh(c, out=c)
        new = np.subtract(h, c, out=new)
        new *= g[1]
        new += c
        return new

    def steep(self) -> bool:
        """Whether a softmax could leave the range of its numbers. No state is beyond 1, so weights bound all scores."""
        p = self.p
        bound = max(np.abs(p["C"]).sum(0).max() + np.abs(p["cb"]).max(), np.abs(p["O"]).sum(1).max() + np.abs(p["ob"][p["ob"] > -1e8]).max())
        return bool(bound > 60)

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target, and with grads (added to) the loss's gradient by h."""
        p, at = self.p, self.place[y]
        cls, pos = at // self.per, at % self.per
        steep = self.steep()

        def softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            """Log-probability of the targets, and the gradient by the scores."""
            z = h @ w
            z += b
            if steep:
                z -= z.max(1, keepdims=True)
            rows = np.arange(len(z))
            out = z[rows, target]
            np.exp(z, out=z)
            s = z @ np.ones(z.shape[1], np.float32)
            out -= np.log(s)
            if grads is None:
                return out, None
            z /= s[:, None]
            z[rows, target] -= 1
            return out, z

        out, d = softmax(h, p["C"], p["cb"], cls)
        dh = None
        if grads is not None:
            grads["C"] += h.T @ d
            grads["cb"] += np.ones(len(d), np.float32) @ d
            dh = d @ p["C"].T
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # of 16 bits, which numpy sorts by radix
        cuts = np.cumsum(np.bincount(cls, minlength=self.classes)).tolist()
        cuts.insert(0, 0)
        sorted_h, sorted_pos = h[order], pos[order]
        more, back = np.zeros(len(h), np.float32), None if grads is None else np.empty_like(h)
        if back is not None:
            back[: cuts[1]] = 0  # within class 0 nothing is left to choose
        for k in range(1, self.classes):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            hi = sorted_h[a:b]
            more[a:b], d = softmax(hi, p["O"][k], p["ob"][k], sorted_pos[a:b])
            if grads is not None:
                grads["O"][k] += hi.T @ d
                grads["ob"][k] += np.ones(b - a, np.float32) @ d
                np.matmul(d, p["O"][k].T, out=back[a:b])
        out[order] += more
        if grads is not None:
            dh[order] += back
        return out, dh

    def train(self, docs: list[np.ndarray], end: int, epochs: int = EPOCHS, most: int = LANES, rate: float = RATE, state: dict | None = None) -> None:
        """Truncated backpropagation: gradients stop at a window's start, the state goes on. The optimizer's
        moments are in `state`, for further calls."""
        with np.errstate(over="ignore"):
            self._train(docs, end, epochs, most, rate, {} if state is None else state)

    def _train(self, docs: list[np.ndarray], end: int, epochs: int, most: int, rate: float, state: dict) -> None:
        p, n = self.p, self.units
        if not state:
            state |= {"m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(v) for k, v in p.items()}, "rng": np.random.default_rng(11), "step": 0}
        m, v2, rng = state["m"], state["v"], state["rng"]
        total = sum(map(len, docs))
        lanes = max(1, min(most, total // WINDOW))
        length = -(-total // lanes)
        for _ in range(epochs):
            flat = np.full(length * lanes, end, np.int32)
            flat[:total] = np.concatenate([docs[i] for i in rng.permutation(len(docs))])
            real = (np.arange(length * lanes) < total).reshape(lanes, length)
            y = flat.reshape(lanes, length)
            x = np.concatenate((np.full((lanes, 1), end), y[:, :-1]), 1)
            h = np.zeros((lanes, n), np.float32)
            kept = [np.empty((WINDOW, lanes, n), np.float32) for _ in range(8)]
            gates, by_part = np.empty((WINDOW, 2, lanes, n), np.float32), np.empty((3, WINDOW, lanes, n), np.float32)
            for t0 in range(0, length, WINDOW):
                ids = np.ascontiguousarray(x[:, t0 : t0 + WINDOW].T)
                steps = len(ids)
                go_on = (ids != end)[:, :, None].astype(np.float32)  # a document begins from a fresh state
                xz = (p["E"] @ p["W"] + p["b"])[:, ids]  # there are fewer words than places
                before, hs, cs, ass, by_c, by_z, by_r, dhc = (b[:steps] for b in kept)
                gs, dx = gates[:steps], by_part[:, :steps]
                for t in range(steps):
                    np.multiply(h, go_on[t], out=before[t])
                    h = self.cell(xz[:, t], before[t], hs[t], gs[t], ass[t], cs[t])
                h = h.copy()  # the buffers are filled anew
                g = {k: np.zeros_like(v) for k, v in p.items()}
                ok = np.flatnonzero(real[:, t0 : t0 + steps].T.ravel())
                if not len(ok):
                    continue
                size = np.float32(1 / len(ok))
                targets = y[:, t0 : t0 + steps].T.ravel()
                if len(ok) == len(targets):
                    _, dh_out = self.log_probs(hs.reshape(-1, n), targets, g)
                else:
                    dh_out = np.zeros((steps * lanes, n), np.float32)
                    _, dh_out[ok] = self.log_probs(hs.reshape(-1, n)[ok], targets[ok], g)
                dh_out = dh_out.reshape(steps, lanes, n)
                # what a step's gradient is multiplied by, for the candidate, the update gate and the reset gate
                r, z = gs[:, 0], gs[:, 1]
                np.subtract(1, z, out=by_c)
                np.subtract(before, cs, out=by_z)
                by_z *= z
                by_z *= by_c
                cs *= cs
                np.subtract(1, cs, out=cs)
                by_c *= cs
                np.subtract(1, r, out=by_r)
                by_r *= r
                by_r *= ass
                back = np.zeros((lanes, n), np.float32)
                up = p["U"].transpose(0, 2, 1).copy()
                for t in range(steps - 1, -1, -1):
                    d = dh_out[t]
                    d += back
                    dc = np.multiply(d, by_c[t], out=dx[2, t])
                    np.multiply(d, by_z[t], out=dx[1, t])
                    np.multiply(dc, by_r[t], out=dx[0, t])
                    np.multiply(dc, r[t], out=dhc[t])
                    back = dx[0, t] @ up[0]
                    back += dx[1, t] @ up[1]
                    back += dhc[t] @ up[2]
                    d *= z[t]
                    back += d
                    back *= go_on[t]
                dx, seen = dx.reshape(3, -1, n), before.reshape(-1, n).T
                g["U"] = np.stack((seen @ dx[0], seen @ dx[1], seen @ dhc.reshape(-1, n)))
                order = np.argsort(ids.ravel().astype(np.uint16 if self.words <= 1 << 16 else np.int64), kind="stable")
                sorted_ids = ids.ravel()[order]
                cuts = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
                words, by_word = sorted_ids[cuts], np.add.reduceat(dx[:, order], cuts, axis=1)
                g["W"] = p["E"][words].T @ by_word
                g["b"] = by_word.sum(1, keepdims=True)
                g["E"][words] = (by_word @ p["W"].transpose(0, 2, 1)).sum(0)
                state["step"] = step = state["step"] + 1
                norm = math.sqrt(sum(float(np.vdot(a, a)) for a in g.values())) * float(size)
                scale = size * np.float32(min(1.0, CLIP / max(norm, 1e-9)))
                now = rate / (1 + step / 1500)
                for k in p:
                    gk = g[k]
                    gk *= scale
                    m[k] *= np.float32(0.9)
                    m[k] += np.float32(0.1) * gk
                    gk *= gk
                    gk *= np.float32(0.001)
                    v2[k] *= np.float32(0.999)
                    v2[k] += gk
                    np.multiply(v2[k], np.float32(1 / (1 - 0.999**step)), out=gk)
                    np.sqrt(gk, out=gk)
                    gk += np.float32(1e-8)
                    np.divide(m[k], gk, out=gk)
                    gk *= np.float32(now / (1 - 0.9**step))
                    p[k] -= gk

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def put(self, weights: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = weights[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def score(self, docs: list[np.ndarray], end: int, most: int = SCORE_LANES) -> np.ndarray:
        """Natural log-probability of each document (its ids, the end included), whole, from a fresh state."""
        if not docs:
            return np.zeros(0)
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        total = int(sizes.sum())
        lanes = min(most, len(docs), max(1, -(-total // int(sizes.max()))))
        # longest first, each to the lane that is free first
        import heapq

        heap, lane_docs = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in order.tolist():
            n, k = heapq.heappop(heap)
            lane_docs[k].append(i)
            heapq.heappush(heap, (n + int(sizes[i]), k))
        lane_docs.sort(key=lambda x: -sum(int(sizes[i]) for i in x))
        ends = np.array([sum(int(sizes[i]) for i in x) for x in lane_docs])
        length = int(ends[0])
        y = np.zeros((length, lanes), np.int32)
        x = np.full((length, lanes), end, np.int32)
        owner = np.zeros((length, lanes), np.int32)
        for k, ids in enumerate(lane_docs):
            at = 0
            for i in ids:
                n = len(docs[i])
                y[at : at + n, k] = docs[i]
                x[at + 1 : at + n, k] = docs[i][:-1]
                owner[at : at + n, k] = i
                at += n
        inputs = self.p["E"] @ self.p["W"] + self.p["b"]
        alive = (lanes - np.searchsorted(ends[::-1], np.arange(length), "right")).tolist()
        out = np.zeros(len(docs))
        h = np.zeros((lanes, self.units), np.float32)
        begins, lane = np.nonzero(x == end)  # here documents begin, each from a fresh state
        first = np.searchsorted(begins, np.arange(length + 1)).tolist()
        window = max(1, 12_000 // lanes)
        with np.errstate(over="ignore"):
            for t0 in range(0, length, window):
                hs, ys, os_ = [], [], []
                for t in range(t0, min(t0 + window, length)):
                    a = alive[t]
                    h = h[:a]
                    if first[t] < first[t + 1]:
                        h = h.copy()
                        begun = lane[first[t] : first[t + 1]]
                        h[begun[begun < a]] = 0
                    h = self.cell(np.take(inputs, x[t, :a], axis=1, mode="clip"), h)
                    hs.append(h)
                    ys.append(y[t, :a])
                    os_.append(owner[t, :a])
                logs, _ = self.log_probs(np.concatenate(hs), np.concatenate(ys))
                out += np.bincount(np.concatenate(os_), logs, len(docs))
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE bytes of text (the last column), so that lanes are many."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = before = 0
        while at < b.num_rows:
            stop = min(b.num_rows, int(np.searchsorted(ends, before + SLICE - size)) + 1)
            held.append(b.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at, before = stop, int(ends[stop - 1])
            if size >= SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rest.to_batches()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        found = words_of(b.column(0))[0].value_counts()
        words, counts = found.field(0), found.field(1)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.concat_arrays([counts, pa.array([b.num_rows], pa.int64())])], names=["word", "c"])


class Model:
    """The network; hot: words by number (below `closed` also the network's, less 1); counts by number; totals."""

    def __init__(self, network: Network, hot: pa.Array, counts: np.ndarray, closed: int, total: int, distinct: int):
        self.network, self.hot, self.counts, self.closed, self.total, self.distinct = network, hot, counts, closed, total, distinct
        rest = total - int(counts[:closed].sum())
        #: log10 of what the shares of words outside the network are divided by
        self.log_rest = math.log10(rest + (distinct - min(closed, len(counts))) + 1)
        self.learned = 0  # tokens the network has learned from, besides the sample that it begins with
        self.log_all = math.log10(total + distinct + 1)
        self.log_counts = np.append(np.log10(counts + 1.0), 0.0)  # the last, at -1, is of words that aren't hot
        #: the end's number, or -1, and what the network takes it for
        self.end_number = pc.index(hot, END).as_py()
        self.end = self.end_number + 1 if self.end_number < closed else 0


SCORED = "uid long, doc_id long, word string, n long, known long, base double, score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """For each document a row without word: its tokens, those known, and the sums as far as hot words go.
    For each distinct other word of it a row with the word and its tokens."""
    for b in _slices(batches):
        uids, n_rows = b.column(0), b.num_rows
        words, number, n = numbered(b.column(2), model.hot, model.end_number)
        starts = np.cumsum(n) - n
        row = np.repeat(np.arange(n_rows), n)
        hot, own = number >= 0, (number >= 0) & (number < model.closed)
        logs = model.log_counts[number]
        base = np.add.reduceat(logs, starts) - n * model.log_all
        logs[own] = 0
        more = np.add.reduceat(logs, starts) - np.bincount(row[~own], minlength=n_rows) * model.log_rest
        docs = cut(np.where(own, number + 1, 0).astype(np.int32), n)
        score = model.network.score(docs, model.end) / math.log(10) + more
        inner = np.ones(len(number), bool)
        inner[starts + n - 1] = False
        at = np.flatnonzero(~hot[inner])
        cold, cold_row = words.take(pa.array(at)), row[inner][at]
        if model.end_number < 0:
            cold, cold_row = pa.concat_arrays([cold, pa.array([END] * n_rows)]), np.append(cold_row, np.arange(n_rows))
        coded = cold.dictionary_encode()
        different = max(1, len(coded.dictionary))
        pair, times = np.unique(cold_row * different + coded.indices.to_numpy(), return_counts=True)
        known = np.bincount(row[hot], minlength=n_rows)
        yield _rows(uids, b.column(1), None, n, known, base, score)
        if len(pair):
            yield _rows(uids.take(pa.array(pair // different)), None, coded.dictionary.take(pa.array(pair % different)), times, None, None, None)


def _rows(*columns) -> pa.RecordBatch:
    """A batch of SCORED; absent columns are null."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    size = len(columns[0])
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=[c.split(" ")[0] for c in SCORED.split(", ")],
    )


COPIES = "shard int, n long, weights binary"


def _copies(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([r[0] for r in rows], [r[1] for r in rows], [r[2].tobytes() for r in rows]), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "n", "weights"])


def _train(batches: Iterator[pa.RecordBatch], network: Network, closed: pa.Array, end: int) -> Iterator[pa.RecordBatch]:
    """All documents of a shard, once: its tokens and the weights after them, times the tokens."""
    reuse_memory()
    own, state, held, size, n, shard = copy.deepcopy(network), {}, [], 0, 0, 0

    def learn() -> None:
        own.train(held, end, 1, max(1, min(SHARD_LANES, size // LANE_TOKENS)), SHARD_RATE, state)
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0)[0].as_py()
        _, number, sizes = numbered(b.column(1), closed, end - 1)
        for ids in cut(number + 1, sizes):
            held.append(ids)
            size += len(ids)
            n += len(ids)
            if size >= BLOCK_TOKENS:
                learn()
                size = 0
    if held:
        learn()
    if n:
        yield _copies([(shard, n, own.weights() * n)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, n, weights = 0, 0, None
    for b in batches:
        for i in range(b.num_rows):
            w = np.frombuffer(b.column(2)[i].as_buffer(), np.float64)
            shard, n, weights = b.column(0)[i].as_py(), n + b.column(1)[i].as_py(), w.copy() if weights is None else weights + w
    if n:
        yield _copies([(shard, n, weights)])


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """docs (doc_id, text) in shards, one a partition: by a hash of the row and its number, so that equal rows are spread too."""
    hashed = docs.select(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("_h"), F.col("text").cast("string").alias("text"))
    return hashed.repartition(shards, "_h").sortWithinPartitions("_h").select(F.spark_partition_id().alias("shard"), "text")


def summed(copies: DataFrame) -> tuple[int, np.ndarray | None]:
    """Tokens and weights of copies (COPIES, stored), summed in rounds of SUMMED until one row is left, which the driver reads."""
    step = 1
    while (left := copies.count()) > 1:
        step *= SUMMED
        groups = copies.repartition(-(-left // SUMMED), F.floor(F.col("shard") / step)).sortWithinPartitions("shard")
        once = stored(groups.mapInArrow(lambda it: release(_summed(it)), COPIES), "lm-sums")
        discard(copies)
        copies = once
    r = copies.first()
    discard(copies)
    return (r["n"], np.frombuffer(r["weights"], np.float64)) if r else (0, None)


def learn_all(docs: DataFrame, network: Network, closed: pa.Array, end: int, total: int) -> int:
    """Trains the network on all of docs (doc_id, text), in shards on executors. Returns the tokens learned from."""
    held = docs.sparkSession.sparkContext.broadcast((network, closed, end))
    dealt = deal(docs, max(1, -(-total // SHARD_TOKENS)))
    n, weights = summed(stored(dealt.mapInArrow(lambda it: release(_train(it, *held.value)), COPIES), "lm-copies"))
    if n:
        network.put(weights / n)
    return n


def _sample(docs: DataFrame, n: int) -> list[str]:
    """What the network that all copies begin from learns, of n docs: different documents of the least hash, at most
    TRAIN_DOCS and about TRAIN_TOKENS tokens. About twice as many rows leave the scan, whatever n is; repeated rows are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("_h"), text.alias("text")).withColumn("_at", F.pmod("_h", F.lit(1 << 40)))
    near = hashed.filter((F.col("_at") * max(n, 1) <= 2.0 * TRAIN_DOCS * (1 << 40)) & (F.length("text") <= 6 * TRAIN_TOKENS))
    one = stored(near.groupBy("_at", "_h").agg(F.first("text").alias("text"), F.first(F.length("text")).alias("_n")), "lm-sample")
    want, left = [], 6 * TRAIN_TOKENS
    for r in one.orderBy("_at", "_h").limit(TRAIN_DOCS).select("_h", "_n").collect():
        if r["_n"] <= left:
            want.append(r["_h"])
            left -= r["_n"]
    texts = {r["_h"]: r["text"] for r in one.filter(F.col("_h").isin(want)).collect()} if want else {}  # 6 * TRAIN_TOKENS characters
    return [texts[h] for h in want]


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from docs (doc_id, text), all of which may be learned from."""
    ship(docs.sparkSession)
    counts = docs.select(F.col("text").cast("string")).mapInArrow(lambda it: release(_count(it)), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts, "lm-counts")
    steps = [int(1.3**k) for k in range(8, 150)]
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *[F.count_if(F.col("c") >= x) for x in steps]).first()
    total, distinct, over = got[0], got[1], got[2:]
    least = next((x for x, n in zip(steps, over, strict=True) if n <= HOT), steps[-1])
    if distinct <= HOT:
        least = 1
    rows = counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()  # HOT rows at most
    hot = pa.concat_arrays([pa.array([], pa.string()), *rows["word"].cast(pa.string()).chunks])
    number = rows["c"].to_numpy().astype(np.int64)
    closed = min(CLOSED - 1, len(rows))
    own = np.concatenate(([total - number[:closed].sum()], number[:closed])) if total else np.zeros(1)
    network = Network(own.astype(float))
    model = Model(network, hot, number, closed, total, distinct)
    texts = _sample(docs, int(number[model.end_number]) if model.end_number >= 0 else 0)
    _, ids, sizes = numbered(pa.array(texts, pa.string()), hot[:closed], model.end - 1)
    sample = cut(ids + 1, sizes)
    if sum(map(len, sample)) >= WINDOW:
        network.train(sample, model.end, most=min(LANES, len(sample)))
    model.learned = learn_all(docs, network, hot[:closed], model.end, total) if total else 0
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # HOT words and the network
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = stored(rows.mapInArrow(lambda it: release(_score(it, held.value)), SCORED), "lm-scored")
    least = int(model.counts.min()) if len(model.counts) else 0
    tail = small(counts.filter(F.col("c") <= least)).select(F.col("word").alias("_word"), "c")
    # every word in a document that isn't hot, with its count if it has one
    cold = scored.filter("word is not null").select("uid", "word", "n").join(tail, F.col("word") == F.col("_word"))
    cold = cold.groupBy("uid").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_logs")).withColumnRenamed("uid", "_uid")
    out = scored.filter("word is null").join(cold, F.col("uid") == F.col("_uid"), "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.pmod(crc_of_id(doc_id), F.lit(7)) == 2
