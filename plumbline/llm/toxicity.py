"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and their first letters, hashed. In every labelled text that has an identity
term, all its occurrences are swapped for another term of its group, and for none; the text so made has its own
features and length, and the training loss has a penalty on the square of the change of the score's logit from
the text to it, so that a neutral mention of a group doesn't raise the score. A feature that another word of
the text has too stays, since it is the text that is scored again. Terms that no labelled text has are put at
the end of as many labelled texts as PROBES, and swapped there.

Learning sees a bounded sample: at most SAMPLE_A_CLASS labelled documents of each class, those with the
least hash of the id. Spark counts the hashed features by class; those that differ most between the
classes, and those of the identity terms, are kept. Scoring is one pass over all texts, without a shuffle.

Cases: null and empty texts get the score of no evidence; rows with a null label or id aren't learned from;
an id labelled more than once counts by its highest label, and one with several texts by the first in order; with
one class or none to learn from every score is 0. Long texts are whole. Equal texts have equal scores, and each
of the repeated rows gets its own; a score of exactly THRESHOLD is predicted toxic. An empty table gives
no rows. Of docs only doc_id and text are read, so columns of other names neither clash nor pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, discard, least_hash, release, ship, stored
from .langid import Words, _slices

SAMPLE_A_CLASS = 8_000
TABLE = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = 6_000
#: Least difference between the classes, in standard deviations of a count, and least documents with a feature.
LEAST_Z, LEAST_DOCS = 4.0, 4
STEPS, RATE, RIDGE = 600, 0.05, 1e-5
#: Weight of the penalty on changes by swaps, and swaps of terms that no text has.
FAIR, PROBES = 1.0, 200
#: What a toxic text weighs in the loss beside another: they are few, and a single word can make them so.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7

#: Identity terms by group.
IDENTITY = {
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists catholic catholics atheist atheists musulman juif chrétien muslimisch jüdisch christlich musulmán judío cristiano",
    "origin": "african africans asian asians european europeans american americans mexican mexicans chinese indian indians arab arabs latino latina immigrant immigrants refugee refugees étranger ausländer extranjero",
    "colour": "black white brown noir blanc schwarz weiß negro blanco",
    "gender": "man men woman women male female girl boy girls boys transgender nonbinary homme femme mann frau hombre mujer",
    "orientation": "gay lesbian bisexual straight homosexual heterosexual queer lesbienne schwul lesbisch",
    "age": "old young elderly teenager teenagers senior seniors vieux jeune alt jung viejo joven",
    "ability": "blind deaf disabled autistic wheelchair aveugle sourd behindert ciego sordo",
}


@lru_cache(1)
def terms() -> tuple[list[str], list[list[int]]]:
    """All identity terms, and for each the others of its group."""
    names, groups = [], []
    for line in IDENTITY.values():
        own = line.split()
        groups.append(range(len(names), len(names) + len(own)))
        names += own
    return names, [[j for j in g if j != i] for g in groups for i in g]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    root = 0xD6E8FEB86659FD93
    out = []
    for r in (root, pow(root, -1, 1 << 64)):
        x = np.full(n, r, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, text) of each word, then of each prefix that is shorter than its word."""
    up, down = _powers(1 << max(18, len(w.cp).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((w.cp.astype(np.uint64) + np.uint64(1)) * up[: len(w.cp)], dtype=np.uint64)))

    def of(begin: np.ndarray, size, kind: int) -> np.ndarray:
        h = (sums[begin + size] - sums[begin]) * down[begin] + np.uint64(kind)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(TABLE)).astype(np.int64)

    yield of(w.begin, w.size, 0), w.text
    for k in PREFIXES:
        at = np.flatnonzero(w.size > k)
        yield of(w.begin[at], k, k), w.text[at]


def occurrences(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A text's number times TABLE, plus the feature, for each feature of each word; and words by text. kept: mask of features."""
    w = Words(texts)
    keys = []
    for f, t in features(w):
        if kept is not None:
            at = np.flatnonzero(kept[f])
            f, t = f[at], t[at]
        keys.append(t * TABLE + f)
    return np.concatenate(keys), np.bincount(w.text, minlength=len(texts))


def distinct(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs without doubles, sorted by text, and words by text."""
    key, n = occurrences(texts, kept)
    key = np.unique(key)
    return key // TABLE, key % TABLE, n


@lru_cache(1)
def term_features() -> list[Counter]:
    """For each identity term, its features and how often it has each."""
    key, _ = occurrences(terms()[0])
    out = [Counter() for _ in terms()[0]]
    for k in key.tolist():
        out[k // TABLE][k % TABLE] += 1
    return out


def found_terms(texts: list[str]) -> list[Counter]:
    """How often each identity term is among each text's words, which are runs of letters as in the features."""
    number = {t: i for i, t in enumerate(terms()[0])}
    known = np.zeros(TABLE, bool)
    known[next(features(Words(terms()[0])))[0]] = True
    w, out = Words(texts), [Counter() for _ in texts]
    for i in np.flatnonzero(known[next(features(w))[0]]).tolist():
        word = w.cp[w.begin[i] : w.begin[i] + w.size[i]].tobytes().decode("utf-32-le")
        if word in number:
            out[w.text[i]][number[word]] += 1
    return out


def swapped(own: dict[int, int], term: int, times: int, to: int | None) -> tuple[list[int], list[int]]:
    """The features that go from a text and those that come when the term, which it has so many times, is swapped
    for another or for none. own: how often words of the text have each feature."""
    old, new = term_features()[term], term_features()[to] if to is not None else Counter()
    return [f for f, k in old.items() if own[f] == k * times and f not in new], [f for f in new if f not in own]


def swaps(own: dict[int, int], found: Counter, text: str) -> list[dict]:
    """Both swaps of each identity term of a text; `words` is how many fewer words the text has after one."""
    out, pick = [], zlib.crc32(text.encode("utf-8", "replace"))
    for term, times in sorted(found.items()):
        others = terms()[1][term]
        for to in (others[(pick + term) % len(others)], None):
            gone, come = swapped(own, term, times, to)
            out.append({"term": term, "to": to, "gone": gone, "come": come, "words": times if to is None else 0})
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, TABLE), np.int64)
    for b in batches:
        toxic = np.array(b.column(1).to_pylist(), bool)
        low = 0
        for part in _slices([x or "" for x in b.column(0).to_pylist()]):
            text, feature, _ = distinct(part)
            label = toxic[low : low + len(part)][text].astype(np.int64)
            counts += np.bincount(label * TABLE + feature, minlength=2 * TABLE).reshape(2, TABLE)
            low += len(part)
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["f", "n0", "n1"])


def _rows(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, texts = [], [x or "" for x in b.column(0).to_pylist()]
        labels = b.column(1).to_pylist()
        low = 0
        for part in _slices(texts):
            key, n = occurrences(part, kept)
            key, times = np.unique(key, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(part) + 1) * TABLE)
            for k, found in enumerate(found_terms(part)):
                feature = (key[cuts[k] : cuts[k + 1]] % TABLE).tolist()
                own = dict(zip(feature, times[cuts[k] : cuts[k + 1]].tolist(), strict=True)) if found else {}
                out.append((labels[low + k], int(n[k]), feature, swaps(own, found, part[k])))
            low += len(part)
        if out:
            cols = list(zip(*out, strict=True))
            features, swap = pa.list_(pa.int32()), [("term", pa.int32()), ("to", pa.int32()), ("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("words", pa.int64())]
            kinds = (pa.int32(), pa.int64(), features, pa.list_(pa.struct(swap)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["toxic", "n", "features", "swaps"])


class Model:
    """weights by hashed feature, a weight for the logarithm of the words, a bias; trained: whether it learned."""

    def __init__(self, weights: np.ndarray, length: float, bias: float, trained: bool):
        self.weights, self.length, self.bias, self.trained = weights, length, bias, trained

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        text, feature, n = distinct(texts, self.weights != 0)
        z = self.bias + self.length * np.log1p(n) + np.bincount(text, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def changes(n: np.ndarray, rows: list[np.ndarray], swapped_in: list[list[dict]]) -> list[tuple[list[int], list[int], float]]:
    """What each swap changes in its text: features that go, features that come, and the logarithm of the words by so much less.
    Terms that no text has are put at the end of some texts first."""
    size = np.log1p(n)
    out = [(s["gone"], s["come"], size[i] - np.log1p(n[i] - s["words"])) for i, of in enumerate(swapped_in) for s in of]
    rng, present = np.random.default_rng(7), {s["term"] for of in swapped_in for s in of}
    for term in [t for t in range(len(terms()[0])) if t not in present]:
        for _ in range(max(1, PROBES // len(terms()[0]))):
            i, to = int(rng.integers(len(rows))), int(rng.choice(terms()[1][term]))
            own = dict.fromkeys(rows[i].tolist(), 1)
            a, b = ([f for f in term_features()[t] if f not in own] for t in (term, to))
            out.append(([f for f in a if f not in b], [f for f in b if f not in a], 0.0))
            out.append((a, [], np.log1p(n[i] + 1) - size[i]))
    return out


def fit(toxic: np.ndarray, n: np.ndarray, rows: list[np.ndarray], swapped_in: list[list[dict]], kept: np.ndarray, fair: float = FAIR) -> Model:
    """Full-batch Adam on the logistic loss, a ridge and the counterfactual penalty."""
    column = np.full(TABLE, -1, np.int64)
    column[kept] = np.arange(kept.sum())
    d = int(kept.sum()) + 2
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f = column[np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)]
    size = np.log1p(n)
    made = changes(n, rows, swapped_in)
    pair_at = np.repeat(np.arange(len(made)), [len(a) + len(b) for a, b, _ in made])
    pair_f = column[np.array([f for a, b, _ in made for f in (*a, *b)], np.int64)]
    sign = np.array([x for a, b, _ in made for x in (*[1.0] * len(a), *[-1.0] * len(b))])
    shorter = np.array([x for _, _, x in made])
    w = np.zeros(d)
    rate = toxic.mean()
    weight = np.where(toxic > 0, TOXIC_WEIGHT, 1.0) / len(rows)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros(d), np.zeros(d)
    for step in range(1, STEPS + 1):
        z = w[-1] + w[-2] * size + np.bincount(at, w[f], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        g = np.bincount(f, e[at], d)
        g[-2], g[-1] = (e * size).sum(), e.sum()
        change = np.bincount(pair_at, sign * w[pair_f], len(made)) + w[-2] * shorter
        g += np.bincount(pair_f, sign * change[pair_at], d) * (2 * fair / len(made))
        g[-2] += (change * shorter).sum() * (2 * fair / len(made))
        g[:-2] += RIDGE * w[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(TABLE)
    weights[kept] = w[:-2]
    return Model(weights, float(w[-2]), float(w[-1]), True)


def learn(docs: DataFrame, labels: DataFrame, fair: float = FAIR) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), all of which may be learned from."""
    ship(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("_y"))
    some = least_hash(known, "_y", "doc_id", SAMPLE_A_CLASS).select(F.col("doc_id").alias("_id"), "_y")
    # 2 * SAMPLE_A_CLASS rows of two numbers: a broadcast of bounded size
    sampled = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    # an id is one row, however often it is repeated
    sample = stored(sampled.groupBy("_id").agg(F.min("text").alias("text"), F.max("_y").cast("int").alias("toxic")).drop("_id"), "toxic-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(TABLE), 0.0, 0.0, False)
    got = sample.mapInArrow(lambda it: release(_count(it)), "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # TABLE rows at most
    n0, n1 = np.zeros(TABLE), np.zeros(TABLE)
    n0[got["f"].to_numpy()], n1[got["f"].to_numpy()] = got["n0"].to_numpy(), got["n1"].to_numpy()
    p = (n0 + n1 + 1) / (sizes[0] + sizes[1] + 2)
    z = np.abs(n1 - p * sizes[1]) / np.sqrt(p * (1 - p) * sizes[1] * sizes[0] / (sizes[0] + sizes[1]))
    z[(n0 + n1 < LEAST_DOCS) | (z < LEAST_Z)] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    kept = np.zeros(TABLE, bool)
    kept[best[z[best] > 0]] = True
    for x in term_features():
        kept[list(x)] = True
    held = docs.sparkSession.sparkContext.broadcast(kept)
    rows = sample.mapInArrow(lambda it: release(_rows(it, held.value)), "toxic int, n long, features array<int>, swaps array<struct<term:int,to:int,gone:array<int>,come:array<int>,words:long>>").toArrow()  # the sample's rows
    discard(sample)
    return fit(
        rows["toxic"].to_numpy().astype(float),
        rows["n"].to_numpy().astype(float),
        [np.array(x, np.int64) for x in rows["features"].to_pylist()],
        rows["swaps"].to_pylist(),
        kept,
        fair,
    )


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        scores = np.concatenate([model.scores(part) for part in _slices(texts)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # TABLE numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(lambda it: release(_score(it, held.value)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.pmod(crc_of_id(doc_id), F.lit(3)) == 1
