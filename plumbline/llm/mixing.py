"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w, with u in (0, 1) from a hash of its id and w in (0, 1] from its
text; ascending keys are a weighted order without replacement. A source whose target is T words and whose
size is S words takes floor(T / S) complete epochs of its documents, then the documents of least key whose
prefix sum of words comes nearest to the rest of T.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
an empty table gives an empty plan and result; rows of one id and weight share a key and come in order of
size, and of rows equal in these too as many are taken as bring the sum nearest to the target; other columns of
the input pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_before, small, stored, words

#: Fixed weights, given to the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: No target is over this many times its source's size.
MOST_EPOCHS = 3
#: Buckets of the key within a source; only a bucket of one source meets in a task.
BUCKETS = 2048
#: Least quality weight.
LEAST_WEIGHT = 0.1


def quality_weight(text: Column) -> Column:
    """Share of a text's word characters that aren't markup symbols, at least LEAST_WEIGHT."""
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", ""))
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>!]"))
    share = (chars - symbols).cast("double") / F.when(chars > 0, chars).otherwise(1).cast("double")
    return F.greatest(F.lit(LEAST_WEIGHT), share)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def with_keys(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with _size, _key and _bucket."""
    return docs.withColumns(
        {"_size": n_words(F.col("text")), "_key": sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed)}
    ).withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row for each source, with source, source_size to target: shares by weight, filled up to the cap.

    The level at which weight * level meets every cap is found on the sources sorted by cap / weight:
    those before the first source that stays under its cap are capped. One row for each source meets in a
    task, which is a count of sources, not of documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_rank", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumns({"_w": weight.cast("long"), "_cap": F.col("source_size") * MOST_EPOCHS})
    s = s.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w").cast("double"))
    by = Window.orderBy("_ratio", "_rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "_rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_ws": F.sum("_w").over(after),
            "_at": F.row_number().over(by),
        }
    )
    s = s.withColumn("_level", F.col("_rest").cast("double") / F.col("_ws").cast("double"))
    s = s.withColumn("_open", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level")))
    s = s.withColumn("_first", F.min("_open").over(whole))
    free = F.col("_first").isNotNull() & (F.col("_at") >= F.col("_first._at"))
    target = F.when(free, F.col("_w").cast("double") * F.col("_first._level")).otherwise(F.col("_cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def plan(keyed: DataFrame) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, cut_bucket, cut_key.

    keyed has source, _size, _key, _bucket and should be stored: it is read twice. Sums by (source, bucket)
    locate the bucket in which the fractional epoch ends; only its rows are sorted.
    """
    sums = stored(keyed.groupBy("source", "_bucket").agg(F.sum("_size").alias("_s")), "mix-sums")
    t = targets(sums.groupBy("source").agg(F.sum("_s").alias("source_size")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0).cast("long"))
    t = stored(t.withColumn("_need", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cum = sums.withColumn("_off", F.coalesce(F.sum("_s").over(w), F.lit(0))).withColumnRenamed("source", "_src")
    edge = (
        t.join(cum, F.col("source").eqNullSafe(F.col("_src")))
        .filter((F.col("_off") <= F.col("_need")) & (F.col("_off") + F.col("_s") > F.col("_need")))
        .select(F.col("_src"), F.col("_bucket").alias("_b"), "_off", "_need")
    )
    # rows that share key, id and size are one row with a count, so a hot one meets in no task
    equal = ["_src", "_b", "_off", "_need", "_key", "doc_id", "_size"]
    at_edge = keyed.select("doc_id", "source", "_size", "_key", "_bucket").join(
        small(stored(edge, "mix-edge")), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b"))
    )
    last = Window.partitionBy("_src", "_b").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    counted = at_edge.groupBy(*equal).agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_before", F.col("_off") + F.coalesce(F.sum(F.col("_size") * F.col("_c")).over(last), F.lit(0)))
    fits = lambda k: F.col("_before") + k * F.col("_size") + F.col("_size") / 2.0 <= F.col("_need")
    near = F.when(F.col("_size") > 0, F.floor((F.col("_need") - F.col("_before")) / F.col("_size") + 0.5)).otherwise(F.when(F.col("_before") <= F.col("_need"), F.col("_c")).otherwise(0))
    counted = counted.withColumn("_m", F.greatest(F.least(near, F.col("_c")), F.lit(0)))
    # the division may round; the comparison decides
    exact = F.when(F.col("_size") == 0, F.col("_m")).when((F.col("_m") < F.col("_c")) & fits(F.col("_m")), F.col("_m") + 1).when((F.col("_m") > 0) & ~fits(F.col("_m") - 1), F.col("_m") - 1)
    counted = counted.withColumn("_m", F.coalesce(exact, F.col("_m")))
    edge_row = F.struct("_key", "doc_id", "_size", F.col("_m").alias("took"), F.col("_c").alias("of"))
    cut = counted.groupBy("_src", "_b").agg(F.max(F.when(F.col("_m") > 0, edge_row)).alias("cut"))
    # without an edge (the need is the whole source, or nothing) no document is cut within a bucket
    return t.join(cut, F.col("source").eqNullSafe(F.col("_src")), "left").select(
        "source",
        "source_size",
        "target",
        "epochs",
        F.coalesce("_b", F.when(F.col("_need") > 0, F.lit(BUCKETS)).otherwise(-1)).alias("cut_bucket"),
        "cut",
    )


def apply(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """keyed with source_size, target and taken; a map-side join while the sources are few.

    Only where some of several equal rows at a source's cut are taken are these stored, to be numbered; their
    numbers are prefix counts over partitions, so no task holds more than one partition of them.
    """
    p = stored(planned, "mix-plan").withColumnRenamed("source", "_src")
    mine, edge = F.struct("_key", "doc_id", "_size"), F.struct("cut._key", "cut.doc_id", "cut._size")
    at_cut = (F.col("_bucket") == F.col("cut_bucket")) & F.col("cut").isNotNull()
    rows = keyed.join(small(p), F.col("source").eqNullSafe(F.col("_src")))
    chosen = (F.col("_bucket") < F.col("cut_bucket")) | (at_cut & (mine <= edge))
    some = at_cut & (F.col("cut.took") < F.col("cut.of")) & mine.eqNullSafe(edge)
    rows = rows.withColumns({"_chosen": F.coalesce(chosen, F.lit(False)), "_some": F.coalesce(some, F.lit(False))})
    if p.filter("cut.took < cut.of").limit(1).count():
        tied = stored(rows.filter("_some").withColumn("_n", F.monotonically_increasing_id()), "mix-ties")
        tied = tied.withColumns({"_part": F.shiftright("_n", 33), "_one": F.lit(1).cast("long")})
        tied = running_before(tied, ["_src"], "_part", [F.col("_n")], "_one", "_nth")
        tied = tied.withColumn("_chosen", F.col("_nth") < F.col("cut.took")).select(*rows.columns)
        rows = rows.filter("not _some").unionByName(tied)
    return rows.withColumn("_copies", F.least(F.col("epochs") + F.col("_chosen").cast("long"), F.lit(MOST_EPOCHS))).withColumn("taken", F.col("_copies") * F.col("_size"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Every row of docs by doc_id, with size, source_size, target and the words taken."""
    keyed = stored(with_keys(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-keys")
    return apply(keyed, plan(keyed)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken."""
    names = docs.columns
    slim = stored(with_keys(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-keys")
    rows = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    taken = apply(with_keys(rows, seed), plan(slim)).filter(F.col("taken") > 0)
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


SQL = """
WITH keyed AS (
  SELECT doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')) AS symbols,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keys AS (
  SELECT doc_id, source, size,
         -ln(u) / greatest(0.1::DOUBLE, (chars - symbols)::DOUBLE / (CASE WHEN chars > 0 THEN chars ELSE 1 END)::DOUBLE) AS k
  FROM keyed),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM keys GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk
  FROM src),
ratio AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w::DOUBLE AS r FROM ranked),
filled AS (
  SELECT *, row_number() OVER (ORDER BY r, rk) AS pos,
         ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(w) OVER (ORDER BY r, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM ratio),
first_open AS (SELECT min(pos) AS p, arg_min(lvl, pos) AS lvl FROM filled WHERE lvl <= r),
tgt AS (
  SELECT source, source_size, CASE WHEN filled.pos >= f.p THEN w::DOUBLE * f.lvl ELSE cap::DOUBLE END AS target
  FROM filled, first_open f),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM tgt),
pre AS (
  SELECT k.doc_id, k.size, n.source_size, n.target, n.epochs, k.k,
         greatest(n.target - n.epochs * n.source_size, 0.0) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
  FROM keys k JOIN need n ON k.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (least(epochs + CASE WHEN rest > 0 AND bef + size / 2.0 <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM pre
"""
