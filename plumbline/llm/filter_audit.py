"""What filters of a corpus remove alone, together and in each order, with exact duplicates by partition refinement.

Four filters look at one text; the fifth asks whether a row with a smaller id has the same text. Rows start in classes by
code-point length. Classes are split by the hash of their texts' first block, then of the next block, 16 times as
long each time, and classes of one row go at every step; the text of rows that outlive the first block is kept, so that
only those are read on. Of the classes that outlive all blocks full texts are compared: a class of several texts is
split by them. Rows that don't have the least id of their text are marked.

A row's failed filters are five bits. Rows are counted by part, bits and labels in one aggregation, from which every order
follows: a step removes the rows that fail its filter and none of those before it.

Cases: a null text is the empty one, which fails the first filter and may be a duplicate; texts of any length are
whole; a null id isn't smaller than any, and all ids are smaller than it; rows that repeat an id and a text aren't
marked for each other; of several labels of an id a 1 counts; a null lang is the part ''; an empty table has no parts;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, n_words, small, stored, words

FILTERS = "ABCDE"
#: Code points of the first block; every further block is STEP times as long.
BLOCK, STEP = 256, 16
#: Rows of a class from which on it isn't joined by a shuffle.
MANY_ROWS = 50_000


def own_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters that look at one text."""
    w = words(text)
    few = n_words(text) < 100
    repeated = 100 * F.size(F.array_distinct(w)) < 80 * F.size(w)
    loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 10 * F.length(text)
    odd = text.rlike("[#$%&*|]")
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate((few, repeated, loud, odd))), F.lit(0)).cast("int")


def _start(k: Column) -> Column:
    """Code points before block k, from 0."""
    return (BLOCK * (F.pow(F.lit(STEP), k) - 1) / (STEP - 1)).cast("long")


def later_blocks(text: Column, digest: Callable[[Column], Column]) -> Column:
    """Hashes of the blocks after the first, in order."""
    n = F.length(text)
    last = F.ceil(F.log(float(STEP), n * ((STEP - 1) / BLOCK) + 1.0)).cast("int") - 1  # it holds the last code point
    block = lambda k: digest(F.substring(text, (_start(k) + 1).cast("int"), F.least(_start(k + 1) - _start(k), n).cast("int")))
    return F.when(n > BLOCK, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), block)).otherwise(F.array().cast("array<bigint>"))


def _named(classes: DataFrame, *more: str) -> DataFrame:
    return classes.select(F.col("n").alias("_n"), F.col("chain").alias("_chain"), *more)


def duplicates(docs: DataFrame, keep: dict[str, Column] | None = None, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows of docs (doc_id, text) whose text a row with a smaller id has: doc_id and the columns of `keep`."""
    keep = keep or {}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n, first = F.length(text), digest(F.substring(text, 1, BLOCK))
    same = (F.col("n") == F.col("_n")) & (F.col("chain") == F.col("_chain"))
    then = lambda chain, k: F.when(F.size("blocks") > k, F.xxhash64(chain, F.get("blocks", F.lit(k)))).otherwise(chain)
    # by length, then by the first block: rows are counted where the texts are read
    classes = stored(docs.select(n.alias("n"), first.alias("chain")).groupBy("n", "chain").agg(F.count("*").alias("rows")), "audit-classes")
    lengths = stored(classes.groupBy(F.col("n").alias("_n")).agg(F.sum("rows").alias("_rows")).filter("_rows > 1"), "audit-lengths")
    live = classes.join(small(lengths), F.col("n") == F.col("_n"), "left_semi").filter("rows > 1")
    live = stored(live.select(F.col("n").alias("_audit_n"), F.col("chain").alias("_audit_chain")), "audit-live")
    rest = docs.join(small(live), (n == F.col("_audit_n")) & (first == F.col("_audit_chain")), "left_semi")
    rest = rest.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[c.alias(x) for x, c in keep.items()], n.alias("n"), first.alias("chain"), later_blocks(text, digest).alias("blocks"))
    rest = stored(rest, "audit-rest")
    discard(classes, lengths, live)
    # by further blocks: one step for every 16-fold of the longest text that is left
    alive, old, whole = rest.drop("text"), [], F.col("chain")
    for k in range(rest.agg(F.max(F.size("blocks"))).first()[0] or 0):
        split, whole = alive.withColumn("chain", then(F.col("chain"), k)), then(whole, k)
        live = stored(_named(split.groupBy("n", "chain").agg(F.count("*").alias("rows")).filter("rows > 1")), "audit-live")
        alive = stored(split.join(small(live), same, "left_semi"), "audit-alive")
        discard(live, *old)
        old = [alive]
    # full texts of the classes that are left; copies meet where they are read
    final = stored(alive.groupBy("n", "chain").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "audit-final")
    texts = rest.withColumn("chain", whole).join(small(_named(final)), same, "left_semi").groupBy("n", "chain", "text").agg(F.lit(1).alias("one"))
    mixed = stored(_named(texts.groupBy("n", "chain").agg(F.count("*").alias("texts")).filter("texts > 1")), "audit-mixed")
    one = stored(_named(final.join(small(mixed), same, "left_anti"), "rows", "least"), "audit-one")
    marked = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    out = ["doc_id", *keep]
    many = small(one.filter(F.col("rows") >= MANY_ROWS))  # rows of docs / MANY_ROWS at most
    some = small(one.filter(F.col("rows") < MANY_ROWS))
    found = alive.join(many, same).unionByName(alive.join(some, same)).filter(marked).select(*out)
    if mixed.limit(1).count():  # texts that agree in length and all hashes, and differ
        odd = rest.withColumn("chain", whole).join(small(mixed), same, "left_semi")
        least = odd.groupBy(F.col("n").alias("_n"), F.col("text").alias("_text")).agg(F.min("doc_id").alias("least"))
        found = found.unionByName(odd.join(least, (F.col("n") == F.col("_n")) & (F.col("text") == F.col("_text"))).filter(marked).select(*out))
    return found


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows counted: part, mask (bits of the failed filters), good, toxic (labels) and rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = {"part": F.coalesce(F.col("lang").cast("string"), F.lit("")), "mask": own_failures(text)}
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in keep.items()])
    twice = stored(duplicates(docs, keep), "audit-twice")
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(is_one("quality"), is_one("toxic"))
    marks = stored(marks.filter("quality = 1 or toxic = 1"), "audit-labels")
    # marked rows leave the count of their first four bits and enter that of all five
    e = 1 << FILTERS.index("E")
    rows = once.withColumn("_w", F.lit(1)).unionByName(twice.withColumn("_w", F.lit(-1))).unionByName(twice.withColumns({"_w": F.lit(1), "mask": F.col("mask") + e}))
    rows = rows.join(small(marks), F.col("doc_id") == F.col("_id"), "left").na.fill(0, ["quality", "toxic"])
    return rows.groupBy("part", "mask", F.col("quality").alias("good"), "toxic").agg(F.sum("_w").alias("rows"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; counts are of documents of the part."""
    counted = stored(failures(docs, labels), "audit-counts")  # 128 rows a part at most
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {c: F.instr("filter_order", c) for c in FILTERS}
    bits = lambda when: sum((F.when(when(place[c]), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})
    m, n = F.col("mask"), F.col("rows")
    fails, gone = m.bitwiseAND(F.col("own")) != 0, m.bitwiseAND(F.col("before")) != 0
    sum_of = lambda when, name, value=n: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long").alias(name)
    # of k failed filters each is the first of them in 120 / k of all orders
    share = n * (len(orders) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        sum_of(~fails & ~gone, "kept"),
        sum_of(fails & ~gone, "removed"),
        sum_of(fails & gone, "redundant"),
        sum_of(m == F.col("own"), "unique_fails"),
        sum_of(fails & ~gone & (F.col("good") == 1), "good_lost"),
        sum_of(fails & ~gone & (F.col("toxic") == 1), "toxic_lost"),
        sum_of(fails, "shapley", share),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT f.*, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS s,
             a::INT + b::INT + c::INT + d::INT + e::INT AS k FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT o, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
c AS (SELECT part, a, b, c, d, e, good, toxic, k, count(*) AS n FROM g GROUP BY ALL),
fl AS (
  SELECT c.*, o, step, substr(o, step, 1) AS own,
         CASE substr(o, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         (contains(substr(o, 1, step - 1), 'A') AND a) OR (contains(substr(o, 1, step - 1), 'B') AND b) OR (contains(substr(o, 1, step - 1), 'C') AND c)
         OR (contains(substr(o, 1, step - 1), 'D') AND d) OR (contains(substr(o, 1, step - 1), 'E') AND e) AS gone
  FROM c, st),
r AS (
  SELECT part, o AS filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT gone AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM fl GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
