"""Differences between a base and a changed run: imports, failures, log blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import some_of


def introduced(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of side 'shadow' that side 'base' lacks, distinct on keys."""
    return refs.filter("side = 'shadow'").select(*keys).distinct().join(refs.filter("side = 'base'").select(*keys), keys, "left_anti")


def reasons(introduced_rows: DataFrame, most: int) -> DataFrame:
    """Per change: the first reasons, then how many more."""
    text = F.concat("path", F.lit(": "), "module")
    return introduced_rows.groupBy("change_id").agg(F.sort_array(F.collect_set(text)).alias("_r")).select("change_id", some_of(F.col("_r"), most, "; ").alias("reason"), F.size("_r").alias("n"))


# ---- fixed values: lines by which test runners report a failed test ----
PYTEST_LINE = r"^(?:FAILED|ERROR)\s+(.+)\z"
VITEST_LINE = r"^\s*(?:FAIL|×|✗)\s+(\S+\.(?:test|spec)\.[cm]?[jt]sx?)\s*(?:>\s*(.+))?\z"
REPR = " - "
# ---- end of fixed values ----
_WHITE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends, a carriage return included."""
    return F.regexp_replace(text, f"^{_WHITE}|{_WHITE}\\z", "")


def failure_ids(lines: DataFrame, text: str = "line") -> DataFrame:
    """lines with test_id where a line reports a failed or broken test, in either runner's form; other lines go."""
    line = F.col(text)
    rest = trimmed(F.regexp_extract(trimmed(line), PYTEST_LINE, 1))
    node = trimmed(F.substring_index(rest, REPR, 1))
    file, name = F.regexp_extract(line, VITEST_LINE, 1), trimmed(F.regexp_extract(line, VITEST_LINE, 2))
    found = F.when(rest != "", node).when(name != "", F.concat(file, F.lit(" > "), name)).otherwise(file)
    return lines.withColumn("test_id", found).filter(F.col("test_id") != "")


def run_failures(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, test_id) of test_run rows: what either channel of a run reports."""
    both = F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit("")))
    return failure_ids(runs.select(*keys, F.explode(F.split(both, "\n", -1)).alias("line"))).select(*keys, "test_id").distinct()


def failure_blocks(lines: DataFrame, keys: list[str], order: str, header: Column, summary: Column, most: int = 10) -> DataFrame:
    """Islands that a header opens and the next header or summary closes: keys, block number, header and the
    first `most` lines joined. Summary islands and lines before the first header go."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = (header | summary).cast("int")
    df = lines.withColumns({"_h": header, "_o": opens}).withColumn("_b", F.sum("_o").over(w))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    df = df.withColumn("_i", F.row_number().over(inside)).filter((F.col("_b") > 0) & (F.col("_i") <= most + 1))
    blocks = df.groupBy(*keys, "_b").agg(F.bool_or(F.col("_h") & (F.col("_i") == 1)).alias("_real"), F.array_sort(F.collect_list(F.struct("_i", "line"))).alias("_l")).filter("_real")
    body = F.array_join(F.transform(F.slice("_l", 2, most), lambda x: x["line"]), "\n")
    return blocks.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_b")).alias("block"), F.col("_l")[0]["line"].alias("header"), body.alias("message"))


def last_attempt(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The first green attempt if there is one, else the last attempt."""
    return runs.groupBy(*keys).agg(F.min(F.when(F.col("exit_code") == 0, F.col("attempt"))).alias("_g"), F.max("attempt").alias("_m")).select(
        *keys, F.coalesce("_g", "_m").alias("attempt"), F.when(F.col("_g").isNotNull(), "passed").otherwise("failed").alias("outcome")
    )


def tests_gate(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Decision of the tests gate per change from its runs (kind, attempt, exit_code) and its failures (kind, test_id).

    No runs: no runner. No green baseline: can't be judged. A green run after the change passes. A red one
    without readable ids fails, as does one whose retry is red; a retry that heals makes the new ids flaky.
    """
    code = lambda kind: F.min(F.when(F.col("run_kind") == kind, F.col("exit_code")))
    per = runs.groupBy("change_id").agg(code("baseline").alias("b"), code("after").alias("a"), code("retry").alias("r"))
    ids = failures.filter("run_kind = 'after'").groupBy("change_id").agg(F.sort_array(F.collect_set("test_id")).alias("ids"))
    per = per.join(ids, "change_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    why = (
        F.when(F.col("b").isNull(), "NO_RUNNER")
        .when(F.col("b") != 0, "BASELINE_RED")
        .when(F.col("a") == 0, "PASSED")
        .when(F.size("ids") == 0, "UNREADABLE")
        .when(F.coalesce("r", F.lit(1)) != 0, "FAILED")
        .otherwise("FLAKY")
    )
    return per.select("change_id", why.isin("PASSED", "FLAKY").alias("passed"), why.alias("reason_code"), F.when(why == "FLAKY", F.array_join("ids", ",")).otherwise("").alias("flaky"))
