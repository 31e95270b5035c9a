"""Quality rules: decision lists learned from labelled statistics by sequential covering. Native Spark only.

`statistics` turns a text into numbers with built-in functions, within its row: no shuffle. `learn` grows
and prunes conjunctions of thresholds. Each step of growing is one aggregation of the labelled rows into
counts by (feature, bin), so the driver sees features * bins rows, however many rows are labelled.
`verdict` emits the list as one ordered CASE expression.

Cases: a null or empty text has statistics of 0 and fails the base rule (under 10 words); rows with null
labels aren't learned from; a doc_id that is labelled more than once counts by its lowest label; without
labels no rule is learned and only the base rule decides; windows are compared by 64-bit hashes of their
words' 64-bit hashes; other columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

#: Rows of the labelled sample that rules are learned from: those with the least hash of doc_id.
SAMPLE_ROWS = 20_000
WINDOW = 5
BINS = 32
MAX_RULES, MAX_CONDITIONS = 6, 3
#: Of the pruning rows that a rule covers, at least this share must be of low quality.
LEAST_PRECISION = 0.9
#: Of the pruning rows of low quality, a rule must cover at least this share.
LEAST_COVER = 0.01

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_symbols", "f_shouts", "f_upper", "f_dup_lines", "f_repeat", "f_word_chars", "f_distinct", "f_ends")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(h: Column) -> Column:
    """Words inside a WINDOW whose hashes come twice or more. h: hashes of the words, in order."""
    n = F.size(h)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))
        at = _let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"])))
        total = F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]
        # only texts with a window that comes twice pay for the sort of (window, position)
        return F.when(F.size(F.array_distinct(win)) < F.size(win), total).otherwise(0)

    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(windows, covered))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns BASE and FEATURES, and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")

    def of_words(w: Column) -> Column:
        chars, n = F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(w).cast("long").alias("n_words")
        return _let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(n, chars, F.size(F.array_distinct(h)).alias("distinct"), _repeat_words(h).cast("long").alias("n_repeat_words")),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    every = F.struct(
        _let(words(F.col(text)), of_words).alias("w"),
        of_lines.alias("l"),
        count(r"[#*$%&|<>]").alias("symbols"),
        count(r"\p{Lu}").alias("upper"),
        count("[!?]").alias("shouts"),
        count("[.,;:]").alias("ends"),
    )
    # The id makes the column one that Catalyst neither copies into later expressions nor moves filters
    # below: each text is worked through once, even where a filter on the verdict follows.
    df = docs.withColumn("_s", F.when(F.monotonically_increasing_id() >= 0, every))
    per = lambda x, y: x.cast("double") / F.greatest(y, F.lit(1).cast("long"))
    c = lambda name: F.col(f"_s.{name}")
    return df.withColumns(
        {
            "n_words": c("w.n_words"),
            "word_chars": c("w.word_chars"),
            "n_symbols": c("symbols"),
            "n_dup_lines": c("l.dup"),
            "n_repeat_words": c("w.n_repeat_words"),
            "f_symbols": per(c("symbols"), c("w.word_chars")),
            "f_shouts": per(c("shouts"), c("w.word_chars")),
            "f_upper": per(c("upper"), c("w.word_chars")),
            "f_dup_lines": per(c("l.dup"), c("l.lines")),
            "f_repeat": per(c("w.n_repeat_words"), c("w.n_words")),
            "f_word_chars": per(c("w.word_chars"), c("w.n_words")),
            "f_distinct": per(c("w.distinct"), c("w.n_words")),
            "f_ends": per(c("ends"), c("w.n_words")),
            "base_failed": (c("w.n_words") < 10) | (100 * c("w.n_repeat_words") > 20 * c("w.n_words")),
        }
    ).drop("_s")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    c = F.lit(True)
    for x in rule:
        c = c & x.column()
    return c


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(_all(rules[0]), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(_all(rule), F.lit(k))
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: midway between neighbouring quantiles of all rows and of each class."""
    points = [k / BINS for k in range(BINS + 1)]
    of = {"a": F.lit(True), "b": F.col("bad") == 1, "c": F.col("bad") == 0}
    got = rows.agg(*[F.percentile_approx(F.when(c, F.col(f)), points, 10_000).alias(k + f) for f in FEATURES for k, c in of.items()]).first()
    values = {f: sorted({float(x) for k in of for x in got[k + f] or []}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}


def _bin(value: Column, points: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in points]), lambda x: x < value))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(feature, bin) to counts of low and high quality; bin: thresholds under the value."""
    bins = [F.struct(F.lit(f).alias("f"), _bin(F.col(f), cuts[f]).alias("b")) for f in FEATURES if cuts[f]]
    if not bins:
        return {}
    got = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n"))
    return {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in got.collect()}


def _best(rows: DataFrame, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[Condition, int, int] | None:
    """The condition with the most information gain over rows, which hold p0 low and n0 high."""
    counts, best, gain = _counts(rows, cuts), None, 1e-9
    base = math.log2((p0 + 1) / (p0 + n0 + 2))
    for f, points in cuts.items():
        p = n = 0
        for k, x in enumerate(points):
            a, b = counts.get((f, k), (0, 0))
            p, n = p + a, n + b
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                g = pp * (math.log2((pp + 1) / (pp + nn + 2)) - base)
                if g > gain and nn < n0:
                    best, gain = (Condition(f, above, x), pp, nn), g
    return best


def learn(labelled: DataFrame) -> list[Rule]:
    """Ordered rules that reject, from rows with FEATURES, bad (1 or 0) and grow (boolean).

    A rule grows on the rows with grow set until it covers no row of high quality, and loses its last
    conditions while that does not lower its precision on the others. Covered rows then leave both parts.
    """
    rules: list[Rule] = []
    total = labelled.filter(~F.col("grow")).agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]
    cuts = _thresholds(labelled)
    rest = labelled
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        rows = rest.filter("grow")
        p, n = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0))).first()
        while p and n and len(rule) < MAX_CONDITIONS and (found := _best(rows, cuts, p, n)):
            rule, (p, n) = (*rule, found[0]), found[1:]
            rows = rows.filter(found[0].column())
        if not rule:
            break
        held = rest.filter(~F.col("grow"))
        cells = held.agg(*[F.sum(F.when(_all(rule[:k]), x)) for k in range(1, len(rule) + 1) for x in (F.col("bad"), F.lit(1))]).first()
        got = [(cells[2 * k] or 0, cells[2 * k + 1] or 0) for k in range(len(rule))]
        sure = [(a + 1) / (b + 2) for a, b in got]
        keep = max(range(len(rule)), key=lambda k: (round(sure[k], 3), got[k][0], -k))
        a, b = got[keep]
        if not b or a / b < LEAST_PRECISION or a < max(3, LEAST_COVER * total):
            break
        rules.append(rule[: keep + 1])
        rest = rest.filter(~_all(rules[-1]))
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FEATURES, bad and grow of a bounded sample of labelled documents that pass the base rule."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    # at most SAMPLE_ROWS rows of two numbers: a broadcast of bounded size
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).withColumnRenamed("doc_id", "_id")
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")))
    return rows.filter(~F.col("base_failed")).select(
        *FEATURES, F.when(F.col("_q") > 0, 0).otherwise(1).alias("bad"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grow")), F.lit(3)) != 0).alias("grow")
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with BASE, base_failed, rule (the number of the learned rule that rejects) and kept."""
    rules = learn(stored(labelled_rows(docs, labels), "quality-sample"))
    df = statistics(docs).withColumn("rule", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
