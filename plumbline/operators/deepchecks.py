"""Counts over mutation and stability outcomes. Both can only lower a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 40


def chosen(mutants: DataFrame, keys: list[str], order: list, budget: int = BUDGET) -> DataFrame:
    """The mutants within budget, operators before constants, each group in order; with rn."""
    w = Window.partitionBy(*keys).orderBy((F.col("kind") == "constant").cast("int"), *order)
    return mutants.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= budget)


def mutation_summary(outcomes: DataFrame, keys: list[str], budget: int = BUDGET) -> DataFrame:
    """Per key: tested, killed, survived, inconclusive, and whether there were more than the budget.

    outcomes holds every mutant with rn and outcome; only those within budget count.
    """
    inside = F.col("rn") <= budget
    n = lambda x: F.count_if(inside & (F.col("outcome") == x))
    return outcomes.groupBy(*keys).agg(
        F.count_if(inside).alias("tested"), n("killed").alias("killed"), n("survived").alias("survived"), n("inconclusive").alias("inconclusive"), (F.count("*") > budget).alias("truncated")
    )


def outcomes(mutants: DataFrame, results: DataFrame, place: list[str]) -> DataFrame:
    """mutants with the outcome of the run that stands for their place (path, line and column, say), which is inconclusive without
    one. Of several runs of a place the one that speaks most against the change counts."""
    worst = F.max(F.struct(F.when(F.col("outcome") == "survived", 2).when(F.col("outcome") == "killed", 0).otherwise(1).alias("_k"), "outcome"))
    once = results.groupBy(*place).agg(worst["outcome"].alias("_o"))
    return mutants.join(once, place, "left").withColumn("outcome", F.coalesce("_o", F.lit("inconclusive"))).drop("_o")


def varied_outcomes(runs: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, test_id) that failed in some conclusive run; a red run without readable ids has a name of its own, with
    its seed where runs have one."""
    k = [*keys, "run_no"]
    ids = failures.select(*k, "test_id").distinct()
    red = runs.filter("not timed_out and exit_code <> 0")
    seed = F.coalesce(F.concat(F.lit(" (seed "), F.col("seed").cast("string"), F.lit(")")), F.lit("")) if "seed" in runs.columns else F.lit("")
    blind = red.join(ids, k, "left_anti").select(*keys, F.concat(F.lit("run "), F.col("run_no").cast("string"), seed).alias("test_id"))
    return red.join(ids, k).select(*keys, "test_id").unionByName(blind).distinct()


def stability(runs: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: conclusive runs, outcomes that varied, and runs that timed out."""
    varied = varied_outcomes(runs, failures, keys).groupBy(*keys).agg(F.count("*").alias("_v"))
    return (
        runs.groupBy(*keys)
        .agg(F.count_if(~F.col("timed_out")).alias("runs"), F.count_if("timed_out").alias("inconclusive"))
        .join(varied, keys, "left")
        .select(*keys, "runs", F.coalesce("_v", F.lit(0)).alias("varied"), "inconclusive")
    )


def spliced(line: str = "line", at: str = "col", end: str = "end_col", orig: str = "orig", repl: str = "repl") -> F.Column:
    """The line with the mutant in place of [at, end), counted in code points from 0; NULL where the text there isn't the original."""
    here = F.expr(f"substring({line}, {at} + 1, {end} - {at})")
    return F.when(here == F.col(orig), F.concat(F.expr(f"substring({line}, 1, {at})"), F.col(repl), F.expr(f"substring({line}, {end} + 1)")))
