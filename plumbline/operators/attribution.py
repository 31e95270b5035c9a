"""Changed lines to statements, statements to coverage, and the coverage rule.

Everything is keyed by (change_id, path): one exchange on it serves the range join, the deduplication and
the counts by file. A NULL after an outer join is always given its meaning at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import UNATTRIBUTABLE
from .report import hint_text

KEY = ["change_id", "path"]


def runs_of(owners: DataFrame) -> DataFrame:
    """(change_id, path, line, owner), owner NULL or 0 where inert, to maximal runs of one owner."""
    code = owners.filter(F.col("owner").isNotNull() & (F.col("owner") != 0))
    w = Window.partitionBy(*KEY).orderBy("line")
    starts = ~((F.lag("owner").over(w) == F.col("owner")) & (F.lag("line").over(w) == F.col("line") - 1))
    code = code.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))
    code = code.withColumn("_run", F.sum("_start").over(w))
    return code.groupBy(*KEY, "_run").agg(F.min("line").alias("rfirst"), F.max("line").alias("rlast"), F.first("owner").alias("owner")).drop("_run")


def innermost(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each point (change_id, path, line) with the greatest start among the intervals (istart, iend) that hold it.

    One sweep over a file's points and starts in order: intervals that began wait on a stack, and those on top that have ended
    go for good. Rows grow with points and intervals, not with their product.
    """
    begins = intervals.select(*KEY, F.col("istart").alias("line"), F.col("iend").alias("iend"))
    both = begins.unionByName(points.select(*KEY, "line", F.lit(None).cast("int").alias("iend")))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    dealt = both.repartition(*KEY).sortWithinPartitions(*KEY, "line", F.col("iend").isNull())
    return dealt.mapInArrow(_sweep, f"change_id {kinds['change_id']}, path {kinds['path']}, line {kinds['line']}, owner {kinds['line']}")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, open_, last = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        c, p = b.column(0), b.column(1)
        first = (c[0].as_py(), p[0].as_py())
        new = pc.or_(pc.not_equal(c[1:], c[:-1]), pc.not_equal(p[1:], p[:-1])).to_pylist()
        rows, owners = [], []
        for k, (begins, line, end) in enumerate(zip([first != file, *new], b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if begins:
                open_, last = [], None
            if end is not None:
                open_.append((line, end))
            elif line != last:
                last = line
                while open_ and open_[-1][1] < line:
                    open_.pop()
                if open_:
                    rows.append(k)
                    owners.append(open_[-1][0])
        file = (c[-1].as_py(), p[-1].as_py())
        kept = b.select(["change_id", "path", "line"]).take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(owners, kept.column(2).type)], names=["change_id", "path", "line", "owner"])


def attribute(changed: DataFrame, runs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each changed line with its owner: NULL in no run of a mapped file, UNATTRIBUTABLE without a map.

    Runs of a file don't overlap, so lines and runs are merged and ordered once, and each line takes the last run that
    began, if that hasn't ended; what is known of the file's map comes before them. One exchange, no pairs of lines and runs.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kind = runs.schema["owner"].dataType
    row = F.struct(*changed.columns)
    run = "struct<rlast: long, owner: long>"
    lines = changed.select(*KEY, F.col("line").cast("long").alias("_at"), F.lit(2).alias("_kind"), row.alias("_row"), none(run).alias("_run"))
    starts = runs.select(*KEY, F.col("rfirst").cast("long").alias("_at"), F.lit(1).alias("_kind"), none(changed.select(row.alias("r")).schema["r"].dataType).alias("_row"), F.struct(F.col("rlast").cast("long"), F.col("owner").cast("long")).cast(run).alias("_run"))
    maps = mapped.filter(F.col("error").isNull()).select(*KEY, none("long").alias("_at"), F.lit(0).alias("_kind"), none(changed.select(row.alias("r")).schema["r"].dataType).alias("_row"), none(run).alias("_run"))
    so_far = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines.unionByName(starts).unionByName(maps).withColumns({"_mapped": F.bool_or(F.col("_kind") == 0).over(so_far), "_last": F.last("_run", ignorenulls=True).over(so_far)})
    df = df.filter("_kind = 2")
    own = F.when(F.col("_at") <= F.col("_last.rlast"), F.col("_last.owner").cast(kind))
    return df.select("_row.*", F.when(F.col("_mapped"), own).otherwise(UNATTRIBUTABLE).alias("owner"))


def statements(attributed: DataFrame) -> DataFrame:
    """One row for each statement (a file's owner) with the line at which it was seen first, by pos.

    Lines that can't be attributed are each a statement of their own, told apart by the line.
    """
    code = attributed.filter(F.col("owner").isNotNull())
    code = code.withColumn("stmt", F.when(F.col("owner") == UNATTRIBUTABLE, F.col("line")).otherwise(F.col("owner")))
    w = Window.partitionBy(*KEY, "owner", "stmt").orderBy("pos")
    return code.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*KEY, "file_ord", "owner", "stmt", F.col("line").alias("first_line"), "pos")


def statement_status(stmts: DataFrame, coverage: DataFrame, branches: DataFrame) -> DataFrame:
    """stmts with covered, excluded and gap. The branch test looks at the statement and at the line seen first only."""
    ran = coverage.groupBy(*KEY, F.col("line").alias("_l")).agg(F.bool_or(F.col("status") == "executed").alias("_x"), F.bool_or(F.col("status") == "excluded").alias("_e"))
    partial = branches.select(*KEY, F.col("src_line").alias("_l")).distinct()

    def left(df: DataFrame, other: DataFrame, at: str, flags: list[str]) -> DataFrame:
        o = other.withColumnsRenamed({"change_id": "_c", "path": "_p"})
        j = df.join(o, (F.col("change_id") == F.col("_c")) & (F.col("path") == F.col("_p")) & (F.col(at) == F.col("_l")), "left").drop("_c", "_p", "_l")
        return j.na.fill(False, flags)

    df = left(stmts, ran, "stmt", ["_x", "_e"])
    df = left(df, partial.withColumn("_g1", F.lit(True)), "stmt", ["_g1"])
    df = left(df, partial.withColumn("_g2", F.lit(True)), "first_line", ["_g2"])
    covered = F.col("_x") & (F.col("owner") != UNATTRIBUTABLE)
    return df.select(*stmts.columns, covered.alias("covered"), (F.col("_e") & ~covered).alias("excluded"), (F.col("_g1") | F.col("_g2")).alias("gap"))


def first_gap(status: DataFrame) -> DataFrame:
    """Per change the place of its first statement with a branch that no test took, as file:line."""
    first = F.min(F.struct("file_ord", "pos", "path", "stmt"))
    return status.filter("gap").groupBy("change_id").agg(first.alias("_g")).select("change_id", F.concat("_g.path", F.lit(":"), F.col("_g.stmt").cast("string")).alias("first_gap"))


def by_file(files: DataFrame, attributed: DataFrame, status: DataFrame) -> DataFrame:
    """Counts for every edited file, those without changed lines included."""
    had = attributed.groupBy(*KEY).agg(F.lit(True).alias("had_lines"))
    n = status.groupBy(*KEY).agg(
        F.count("*").alias("statements"), F.count_if("covered").alias("covered"), F.count_if("excluded").alias("excluded"), F.count_if("gap").alias("gaps"), F.count_if(~F.col("covered")).alias("uncovered")
    )
    out = files.select(*KEY, "file_ord").join(had, KEY, "left").join(n, KEY, "left")
    return out.na.fill(0, ["statements", "covered", "excluded", "gaps", "uncovered"]).na.fill(False, ["had_lines"])


def coverage_rule(files: DataFrame) -> DataFrame:
    """Per change: covered only if every file has coverable statements, all of them ran, and no branch was missed."""
    coverable = F.col("statements") - F.col("excluded")
    good = (coverable > 0) & (F.col("covered") >= coverable) & (F.col("gaps") == 0)
    return files.groupBy("change_id").agg(
        F.bool_and(good).alias("changed_lines_covered"),
        F.sum("statements").alias("total"),
        F.sum("covered").alias("covered"),
        F.sum("gaps").alias("gaps"),
        F.sum("uncovered").alias("uncovered_total"),
        F.count_if(F.col("uncovered") > 0).alias("files_with_uncovered"),
        F.count_if(F.col("had_lines") & (F.col("statements") == 0)).alias("inert_files"),
        F.count_if(~F.col("had_lines")).alias("removal_files"),
        F.count("*").alias("files"),
    )


def nothing_to_attest(rule: DataFrame) -> DataFrame:
    """rule with all_accounted: nothing uncovered, and every file only removes lines or only changes inert ones."""
    every = (F.col("inert_files") + F.col("removal_files") == F.col("files")) & (F.col("files") > 0)
    return rule.withColumn("all_accounted", ~F.col("changed_lines_covered") & (F.col("uncovered_total") == 0) & every)


def fair_share(uncovered: DataFrame, cap: int, per_file: int) -> DataFrame:
    """Rows of uncovered (change_id, file_ord, path, pos, ...) to show: every file's first `per_file` come before
    any file's others, in order, `cap` in all; with shown and total of the change."""
    files = uncovered.groupBy("change_id", "file_ord", "path").agg(F.count("*").alias("_n"))
    files = files.withColumn("_fs", F.least(F.col("_n"), F.lit(per_file)))
    whole = Window.partitionBy("change_id")
    before = whole.orderBy("file_ord", "path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumns(
        {
            "_t": F.sum("_fs").over(whole),
            "total": F.sum("_n").over(whole),
            "_p": F.coalesce(F.sum("_fs").over(before), F.lit(0)),
            "_x": F.coalesce(F.sum(F.col("_n") - F.col("_fs")).over(before), F.lit(0)),
        }
    )
    tight = F.greatest(F.lit(0), F.least(F.col("_fs"), cap - F.col("_p")))
    roomy = F.col("_fs") + F.greatest(F.lit(0), F.least(F.col("_n") - F.col("_fs"), cap - F.col("_t") - F.col("_x")))
    files = files.withColumn("_taken", F.when(F.col("_t") > cap, tight).otherwise(roomy))
    rows = uncovered.withColumn("_rn", F.row_number().over(Window.partitionBy("change_id", "file_ord", "path").orderBy("pos")))
    out = rows.join(files.select("change_id", "file_ord", "path", "_taken", "total"), ["change_id", "file_ord", "path"]).filter("_rn <= _taken")
    return out.drop("_rn", "_taken").withColumn("shown", F.least("total", F.lit(cap)))


def hints(shown: DataFrame, cap: int) -> DataFrame:
    """One hint for each of the first `cap` rows of a capped list, with the total from before any cap."""
    order = Window.partitionBy("change_id").orderBy("file_ord", "path", "pos")
    at = F.concat("path", F.lit(":"), F.col("stmt").cast("string"))
    text = hint_text(at, F.col("excluded"))
    out = shown.withColumns({"_rn": F.row_number().over(order), "hint": text}).filter(F.col("_rn") <= cap)
    return out.select("change_id", "hint", F.least("total", F.lit(cap)).alias("shown"), "total")


def unmeasured(files: DataFrame, changed: DataFrame, measured: DataFrame) -> DataFrame:
    """Edited files with changed lines that the coverage run never loaded: coverage of the change is unknown."""
    return files.select(*KEY).join(changed.select(*KEY).distinct(), KEY, "left_semi").join(measured.select(*KEY), KEY, "left_anti")
