"""Language identification of spans: scripts narrow the candidates, then Viterbi over scores of words.

A word is a run of letters. Its script, by ranges of code points, leaves the languages that use it; its
n-grams of 1 to 4 characters, with its edges, give each of them a score. Over the words of a text, Viterbi
with a penalty for every switch labels each word, so a passage in another language becomes a span of its
own. The language with most letters is the text's.

The tables are learned from a bounded sample of labelled documents (DOCS_A_LANGUAGE of each language,
those with the least hash of the id), counted by Spark into a fixed number of hashed features.

Cases: a null text or one without a letter is `und` with score 0; with nothing to learn from every text is
`und`; a word in a script that no learned language uses is neutral; ties go to the language first in
order; rows with null lang aren't learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, least_hash, release, ship, stored

DOCS_A_LANGUAGE = 2_000
#: Hashed features for each length of n-gram.
TABLE = 1 << 15
LENGTHS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Log-probability lost at a switch of language, and the weight of a word's overlapping n-grams.
SWITCH = 6.0
OVERLAP = 0.25
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.02
#: Words a step of the chunked Viterbi runs over, and code points worked on at a time.
CHUNK = 32
SLICE = 1 << 18

#: Ranges of code points of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
)
FEATURES = len(LENGTHS) * TABLE
#: Floats that paths through chunks take at a time.
PATHS = 1 << 24


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it belongs to words (a letter or mark), is a letter, and the number of its script (0: other)."""
    letters = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    alphas = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    scripts = np.zeros(0x110000, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            scripts[a : b + 1] = k
    return letters, alphas, scripts


class Words:
    """The words of some texts: text, begin, size and script of each, and the n-grams with their words."""

    def __init__(self, texts: list[str]):
        letters, alphas, scripts = _kinds()
        # offsets are kept: a character whose lower case is longer stays as it is
        lowered = [x if len(x := t.lower()) == len(t) else "".join(y if len(y := c.lower()) == 1 else c for c in t) for t in texts]
        self.ends = np.cumsum([len(t) + 1 for t in lowered])
        cp = np.frombuffer(("\n".join(lowered) + "\n\n").encode("utf-32-le", "replace"), "<u4")
        is_in = letters[cp]
        self.alphas = np.add.reduceat(alphas[cp].astype(np.int64), np.concatenate(([0], self.ends[:-1])))
        edge = np.diff(is_in.astype(np.int8), prepend=0)
        self.begin = np.flatnonzero(edge == 1)
        self.size = np.flatnonzero(edge == -1) - self.begin
        self.text = np.searchsorted(self.ends, self.begin, "right")
        self.script = scripts[cp[self.begin]] if len(self.begin) else np.zeros(0, np.uint8)
        self.cp, self.is_in, self.edge = cp, is_in, edge

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the hashed features and the words they belong to."""
        c = np.where(self.is_in, self.cp, 32).astype(np.uint32)
        c = np.concatenate(([32], c, [32, 32, 32])).astype(np.uint32)
        inside = np.concatenate(([False], self.is_in, [False] * 3))
        word = np.cumsum(np.concatenate(([0], (self.edge == 1).astype(np.int64), [0] * 3))) - 1
        n = len(self.cp)
        h = np.zeros(n, np.uint32)
        for k, length in enumerate(LENGTHS):
            h = h * np.uint32(0x01000193) + c[length - 1 : length - 1 + n] * np.uint32(0x9E3779B1)
            if length == 1:
                ok, owner = inside[:n], word[:n]
            elif length == 2:
                ok, owner = inside[:n] | inside[1 : 1 + n], np.where(inside[1 : 1 + n], word[1 : 1 + n], word[:n])
            else:
                ok, owner = inside[1 : 1 + n].copy(), word[1 : 1 + n]
                for m in range(2, length - 1):
                    ok &= inside[m : m + n]
            at = np.flatnonzero(ok)
            g = h[at]
            yield (((g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64) + k * TABLE, owner[at]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    low = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield texts[low : k + 1]
            low, held = k + 1, 0
    if low < len(texts):
        yield texts[low:]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: FEATURES + scripts rows, a column for each language."""
        self.languages = languages
        self.table = np.zeros((FEATURES, len(languages)), np.float32)
        for k in range(len(LENGTHS)) if languages else ():
            part = counts[k * TABLE : (k + 1) * TABLE] + SMOOTHING
            logs = np.log(part / part.sum(0))
            self.table[k * TABLE : (k + 1) * TABLE] = (logs - logs.mean(1, keepdims=True)) * OVERLAP
        used = counts[FEATURES:]
        self.uses = used >= SCRIPT_SHARE * np.maximum(used.sum(0), 1)  # script, language
        self.uses[~self.uses.any(1)] = True

    def scores(self, w: Words) -> np.ndarray:
        """A row for each word, a column for each language; -1e4 where the script rules a language out."""
        out = np.zeros((len(self.languages), len(w.begin)))
        for feature, word in w.grams():
            rows = self.table[feature]
            for j in range(len(self.languages)):
                out[j] += np.bincount(word, rows[:, j], len(w.begin))
        allowed = self.uses[w.script]
        return np.where(allowed, out.T - np.where(allowed, out.T, -np.inf).max(1, keepdims=True, initial=-np.inf), -1e4) if len(w.begin) else out.T


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word, for consecutive texts that end at `ends` (in words).

    Exact, and vectorised over chunks of CHUNK words: a chunk is first reduced to its best path between
    every two states, then each text passes from chunk to chunk (all texts at once), then the words inside.
    """
    n, states = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    chunks = -(-sizes // CHUNK)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    text_of = np.repeat(np.arange(len(ends)), sizes)
    place = np.arange(n) - starts[text_of]
    block, col = first[text_of] + place // CHUNK, place % CHUNK
    s = np.zeros((CHUNK, total, states), np.float32)
    s[col, block] = scores
    used = np.bincount(block, minlength=total)
    # each text from chunk to chunk; the best path through a chunk, from the state before it to the state at its end, is
    # worked out for some chunks at a time, as it takes the square of the states
    come = np.zeros((total, states), np.float32)
    order = np.argsort(-chunks, kind="stable")
    fewer = -chunks[order]
    number = np.arange(total) - np.repeat(first, chunks)
    v = np.zeros((len(ends), states), np.float32)
    low = 0
    waiting = np.cumsum(np.bincount(number))
    while low < len(waiting):
        done = waiting[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(waiting, done + PATHS // states**2, "right")))
        some = np.flatnonzero((number >= low) & (number < high))
        place = np.zeros(total, np.int64)
        place[some] = np.arange(len(some))
        own_scores = s[:, some]
        m = np.where(np.eye(states, dtype=bool), 0, -switch).astype(np.float32)[None] + own_scores[0][:, None, :]
        for t in range(1, CHUNK):
            live = (t < used[some])[:, None, None]
            m = np.where(live, np.maximum(m, m.max(2, keepdims=True) - switch) + own_scores[t][:, None, :], m)
        for k in range(low, high):
            act = order[: np.searchsorted(fewer, -k, "left")]
            come[first[act] + k] = v[act]
            v[act] = (v[act][:, :, None] + m[place[first[act] + k]]).max(1)
            v[act] -= v[act].max(1, keepdims=True)
        low = high
    # inside the chunks, with the best state before each word
    back = np.zeros((CHUNK, total, states), np.uint16)
    own = np.arange(states)
    x = come
    for t in range(CHUNK):
        top = x.argmax(1)
        lost = x.max(1, keepdims=True) - switch
        back[t] = np.where(x >= lost, own, top[:, None])
        nxt = np.maximum(x, lost) + s[t]
        x = np.where((t < used)[:, None], nxt, x)
    final = x
    # from the end of each text backwards
    label = np.zeros((CHUNK, total), np.uint16)
    lead = np.tile(own, (total, 1))  # the state before a chunk, for each state at its end
    rows = np.arange(total)[:, None]
    for t in range(CHUNK - 1, -1, -1):
        lead = np.where((t < used)[:, None], back[t][rows, lead], lead)
    end = np.zeros(total, np.int64)
    state = np.zeros(len(ends), np.int64)
    for k in range(int(chunks.max()) - 1, -1, -1):
        act = order[: np.searchsorted(fewer, -k, "left")]
        here = first[act] + k
        state[act] = np.where(chunks[act] - 1 == k, final[here].argmax(1), state[act])
        end[here] = state[act]
        state[act] = lead[here, state[act]]
    now, flat = end, np.arange(total)
    for t in range(CHUNK - 1, -1, -1):
        live = t < used
        label[t] = now
        now = np.where(live, back[t][flat, now], now)
    return label[col, block].astype(np.int64)


def _counter(languages: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + len(SCRIPTS) + 1, len(languages)), np.int64)
        for batch in batches:
            texts, langs = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for lang in set(langs):
                j = languages[lang]
                for part in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    w = Words(part)
                    for feature, _ in w.grams():
                        total[:FEATURES, j] += np.bincount(feature, minlength=FEATURES)
                    total[FEATURES:, j] += np.bincount(w.script, w.size, len(SCRIPTS) + 1).astype(np.int64)
        at, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[at, j])], names=["f", "j", "n"])

    return count


def learn(docs: DataFrame) -> Model:
    """A model from docs (doc_id, text, lang) of which every row may be learned from.

    The driver receives at most FEATURES sums for each language, whatever the size of docs.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    some = stored(least_hash(known, "lang", "doc_id", DOCS_A_LANGUAGE).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "lang-sample")
    languages = sorted(r[0] for r in some.select("_lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((FEATURES + len(SCRIPTS) + 1, 0)))
    # at most DOCS_A_LANGUAGE ids for each language, each once: bounded by the number of languages
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(some), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("text", "_lang")
    got = rows.mapInArrow(_counter({x: k for k, x in enumerate(languages)}), "f int, j int, n long").groupBy("f", "j").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FEATURES + len(SCRIPTS) + 1, len(languages)))
    counts[got["f"].to_numpy(), got["j"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, spans: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, and with spans: an array of (begin, size, lang) in code points. Columns
    of docs with these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(*names, *(["spans"] if spans else []))
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats for each language
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    if spans:
        span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("lang", T.StringType())])
        schema = schema.add("spans", T.ArrayType(span))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            lang, score, found = [], [], []
            for part in _slices([x or "" for x in batch.column(where).to_pylist()]):
                a, b, c = label(m, part, spans)
                lang += a
                score += b
                found += c
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            head = [*batch.schema.names, *names]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("size", pa.int32()), ("lang", pa.string())]))))
                head.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=head)

    return docs.mapInArrow(lambda it: release(run(it)), schema)


def label(m: Model, texts: list[str], spans: bool = False) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of each text. Score: the share of letters in the language, times how much
    better its words score than the second best language's, as a logistic of the difference."""
    w = Words(texts)
    if not len(w.begin) or not m.languages:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    s = m.scores(w)
    ends = np.searchsorted(w.text, np.arange(len(texts)), "right")
    some = np.flatnonzero(np.diff(ends, prepend=0))
    labels = viterbi(s, ends[some])
    k = len(m.languages)
    letters = np.bincount(w.text * k + labels, w.size, len(texts) * k).reshape(-1, k)
    best = letters.argmax(1)
    share = letters.max(1) / np.maximum(letters.sum(1), 1)
    sums = np.stack([np.bincount(w.text, np.maximum(s[:, j], -20), len(texts)) for j in range(k)], 1)
    mine = sums[np.arange(len(texts)), best]
    sums[np.arange(len(texts)), best] = -np.inf
    gap = np.clip(mine - sums.max(1), -30, 30) if k > 1 else np.full(len(texts), 30.0)
    score = np.where(letters.sum(1) > 0, share / (1 + np.exp(-gap)), 0.0)
    score = np.where(w.alphas > 0, score, 0.0)
    lang = [m.languages[j] if n else "und" for j, n in zip(best.tolist(), w.alphas.tolist(), strict=True)]
    found: list[list[dict]] = [[] for _ in texts]
    if spans:
        offset = np.concatenate(([0], w.ends[:-1]))
        for i, b, n, j in zip(w.text.tolist(), (w.begin - offset[w.text]).tolist(), w.size.tolist(), labels.tolist(), strict=True):
            if found[i] and found[i][-1]["lang"] == m.languages[j]:
                found[i][-1]["size"] = b + n - found[i][-1]["begin"]
            else:
                found[i].append({"begin": b, "size": n, "lang": m.languages[j]})
    return lang, score.tolist(), found


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0
