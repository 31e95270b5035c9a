"""The verdict: one decision list over what is known of a change. Pure columns, no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import some_of

#: Reason codes of a tests gate that could judge nothing.
UNJUDGED = ("NO_RUNNER", "BASELINE_RED")
NEEDS = (
    "syntax_passed boolean, imports_passed boolean, tests_passed boolean, tests_code string, covered string, gaps long, survivors long, varied long, "
    "flaky long, scope string, uncovered_total long, total long, covered_statements long, removal_files long, inert_files long, all_accounted boolean"
)


def masked_gates(df: DataFrame) -> DataFrame:
    """Later gates count as not run (passed, with reason SKIPPED) once an earlier one failed."""
    ok1, ok2 = F.col("syntax_passed"), F.col("syntax_passed") & F.col("imports_passed")
    return df.withColumns(
        {
            "imports_passed": F.when(ok1, F.col("imports_passed")).otherwise(True),
            "tests_passed": F.when(ok2, F.col("tests_passed")).otherwise(True),
            "tests_code": F.when(ok2, F.col("tests_code")).otherwise("SKIPPED"),
        }
    )


def first_failed(gates: DataFrame, key: str) -> DataFrame:
    """Of gate rows (key, gate_ord, gate, passed, reason) the first that failed, by order."""
    bad = F.when(~F.col("passed"), F.struct("gate_ord", "gate", F.coalesce("reason", F.concat("gate", F.lit(" gate failed"))).alias("reason")))
    return gates.groupBy(key).agg(F.min(bad).alias("_b")).select(key, F.col("_b.gate").alias("gate"), F.col("_b.reason").alias("reason"))


def would_be_safe() -> Column:
    """Whether costly checks could still change the verdict."""
    return F.col("syntax_passed") & F.col("imports_passed") & F.col("tests_passed") & (F.col("flaky") == 0) & (F.col("scope") != "narrowed")


def _one_or_many(n: str, code: str) -> Column:
    return F.when(F.col(n) == 1, f"{code}_ONE").otherwise(f"{code}_MANY")


def fuse(df: DataFrame) -> DataFrame:
    """df (with NEEDS) with verdict, reason_code and scope as reported."""
    failed = F.when(~F.col("syntax_passed"), "GATE_SYNTAX").when(~F.col("imports_passed"), "GATE_IMPORTS").when(~F.col("tests_passed"), "GATE_TESTS")
    unjudged = (failed == "GATE_TESTS") & F.coalesce(F.col("tests_code").isin(*UNJUDGED), F.lit(False))
    narrowed, full = F.col("scope") == "narrowed", F.col("covered") == "true"
    nothing = F.coalesce(F.col("all_accounted"), F.lit(False)) & (F.col("covered") == "false") & (F.col("uncovered_total") == 0)
    about_coverage = (
        F.when(full & (F.col("survivors") > 0), _one_or_many("survivors", "SURVIVOR"))
        .when(nothing & (F.col("inert_files") == 0), "REMOVAL_ONLY")
        .when(nothing & (F.col("removal_files") == 0), "INERT_ONLY")
        .when(nothing, "REMOVAL_AND_INERT")
        .when(F.col("covered") == "unknown", "COVERAGE_UNKNOWN")
        .when(F.col("gaps") > 0, _one_or_many("gaps", "BRANCH"))
        .when((F.col("total") > 0) & (F.col("covered_statements") > 0), "PARTIAL")
        .otherwise("NOT_EXERCISED")
    )
    above = F.when(narrowed, "NARROWED").when(F.col("flaky") > 0, "FLAKY").when(F.col("varied") > 0, _one_or_many("varied", "VARIED"))
    clean = full & (F.col("gaps") == 0) & (F.col("survivors") == 0) & (F.col("varied") == 0) & (F.col("flaky") == 0) & ~narrowed
    reason = F.when(unjudged, F.col("tests_code")).when(failed.isNotNull(), failed).when(clean, "SAFE").when(full, F.coalesce(above, about_coverage)).otherwise(about_coverage)
    verdict = F.when(unjudged, "UNPROVEN").when(failed.isNotNull(), "UNSAFE").when(clean, "SAFE").otherwise("UNPROVEN")
    return df.withColumns({"verdict": verdict, "reason_code": reason, "scope": F.when(unjudged, "unknown").otherwise(F.col("scope"))})


def exit_code(error: Column | None = None, signed_in: Column | None = None) -> Column:
    """7 without leave to ask, 2 where the input can't be taken, else 1 for UNSAFE and 0 for the others."""
    out = F.when(~F.coalesce(signed_in, F.lit(False)), 7) if signed_in is not None else F.when(F.lit(False), 7)
    if error is not None:
        out = out.when(error.isNotNull(), 2)
    return out.when(F.col("verdict") == "UNSAFE", 1).otherwise(0)


#: Languages in the order in which their gates speak.
LANGUAGES = ("python", "typescript")


def by_language(results: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Rows (keys, language, reason: NULL where it passed) to keys, passed, reason, the first of the first language that failed, and
    reasons of all languages, Python's first, each language's in order, `most` of them and how many more there are."""
    order = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("language"))
    bad = F.when(F.col("reason").isNotNull(), F.struct(order.alias("ord"), "reason"))
    per = results.groupBy(*keys).agg(F.array_sort(F.collect_set(bad)).alias("_b"))
    texts = F.transform("_b", lambda x: x["reason"])
    return per.select(*keys, (F.size("_b") == 0).alias("passed"), F.get(texts, F.lit(0)).alias("reason"), some_of(texts, most, "; ").alias("reasons"))


def coverage_state(rule: DataFrame, unmeasured: DataFrame, other_languages: DataFrame | None = None) -> DataFrame:
    """rule with covered_state: unknown where a file was never measured (or isn't Python), else the rule's answer."""
    u = unmeasured.select("change_id").distinct().withColumn("_u", F.lit(True))
    df = rule.join(u, "change_id", "left")
    if other_languages is not None:
        df = df.join(other_languages.select("change_id").distinct().withColumn("_o", F.lit(True)), "change_id", "left").withColumn("_u", F.coalesce("_u", "_o")).drop("_o")
    return df.withColumn("covered_state", F.when(F.col("_u"), "unknown").otherwise(F.col("changed_lines_covered").cast("string"))).drop("_u")
