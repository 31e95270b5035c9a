"""What comes in before the checks: edits or diffs, base files, walked trees, helpers' answers, coverage's availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_discovered, some_of

#: Folders that a walk for tests leaves out.
UNWALKED = ("node_modules", ".git", ".venv", "venv", ".tox", ".nox", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs")
WALK_CAP = 5000
#: Characters kept of a suite's output and of an error.
TAIL, HEAD = 4000, 200


def chosen_edits(edits: DataFrame, from_diff: DataFrame) -> DataFrame:
    """Edits of each change: those given as such win over those of its diff."""
    return edits.unionByName(from_diff.join(edits.select("change_id").distinct(), "change_id", "left_anti"))


#: Variables that a suite must not see, and endings that mark a credential.
DENIED = (
    "GITHUB_TOKEN", "GH_TOKEN", "NPM_TOKEN", "NODE_AUTH_TOKEN", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN", "PYPI_API_TOKEN", "TWINE_PASSWORD", "DOCKER_PASSWORD", "SLACK_TOKEN", "OPENAI_API_KEY", "ANTHROPIC_API_KEY",
)
DENIED_ENDINGS = ("_TOKEN", "_SECRET", "_API_KEY", "_PASSWORD", "_CREDENTIALS")


def kept_variable(name: Column) -> Column:
    ends = F.lit(False)
    for x in DENIED_ENDINGS:
        ends = ends | F.endswith(name, F.lit(x))
    return ~(name.isin(*DENIED) | ends)


def kept_environment(env: Column) -> Column:
    """A map of variables without those that a suite must not see."""
    return F.map_filter(env, lambda k, v: kept_variable(k))


def walked_tests(tree: DataFrame, cap: int = WALK_CAP) -> DataFrame:
    """Per change of repo_file (change_id, path, kind): tests in the order of a walk, and truncated: whether anything came after
    the `cap`th, when the rest can't be known and tests is NULL.

    A walk visits a folder's entries by name and goes into each folder at once, which is the order of paths as lists of
    names. Of a folder that is left out (UNWALKED, or beginning with a dot) the walk meets the folder itself, and nothing in it.
    """
    parts = F.split("path", "/")
    last = F.size(parts) - 1
    left_out = F.transform(parts, lambda p, i: p.isin(*UNWALKED) | (F.startswith(p, F.lit(".")) & ((i < last) | (F.col("kind") == "dir"))))
    stop = F.array_position(left_out, True)
    df = tree.select("change_id", "path", "kind", F.when(stop > 0, F.slice(parts, 1, stop.cast("int"))).otherwise(parts).alias("at"), (stop == 0).alias("_walked"))
    test = (F.col("kind") == "file") & F.col("_walked") & is_discovered(F.col("path"))
    w = Window.partitionBy("change_id").orderBy("at")
    some = df.filter(test).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    per = some.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("_t"), F.max(F.when(F.col("_n") == cap, F.col("at"))).alias("_cap"))
    ends = df.groupBy("change_id").agg(F.max("at").alias("_end"))
    out = ends.join(per, "change_id", "left")
    truncated = F.coalesce(F.col("_end") > F.col("_cap"), F.lit(False))
    tests = F.coalesce(F.transform("_t", lambda x: x["path"]), F.array().cast("array<string>"))
    return out.select("change_id", F.when(~truncated, tests).alias("tests"), truncated.alias("truncated"))


def accounted(requested: DataFrame, answered: DataFrame, failed: DataFrame) -> DataFrame:
    """Every requested (change_id, path) with error: its reason, NULL where it was answered, and an error of its own
    where a helper said neither."""
    a = answered.select("change_id", "path").distinct().withColumn("_a", F.lit(True))
    e = failed.groupBy("change_id", "path").agg(F.min("reason").alias("_e"))
    df = requested.join(a, ["change_id", "path"], "left").join(e, ["change_id", "path"], "left")
    return df.select("change_id", "path", F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_a").isNull(), F.lit("no answer")).alias("error"))


def unresolved_log(lines: DataFrame) -> DataFrame:
    """UNRESOLVED<tab>path<tab>module lines of a helper's log to (change_id, path, module)."""
    f = F.split("line", "\t")
    return lines.filter(F.startswith("line", F.lit("UNRESOLVED\t")) & (F.size(f) == 3)).select("change_id", f[1].alias("path"), f[2].alias("module"))


def output_tail(stdout: Column, stderr: Column) -> Column:
    return F.right(F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit(""))), F.lit(TAIL))


def coverage_availability(files: DataFrame, runs: DataFrame, unmeasured: DataFrame, maps: DataFrame) -> DataFrame:
    """Why coverage of a change is unknown, NULL if it isn't; the first that holds.

    runs: change_id, tool_found, failed, failure_code; maps: change_id, path, error as `accounted` gives it.
    others names up to five files in other languages.
    """
    py = F.col("path").endswith(".py")
    other = F.array_sort(F.collect_list(F.when(~py, F.col("path"))))
    langs = files.groupBy("change_id").agg(F.count_if(py).alias("_py"), other.alias("_o"))
    u = unmeasured.select("change_id").distinct().withColumn("_u", F.lit(True))
    bad = maps.filter("error is not null").select("change_id").distinct().withColumn("_m", F.lit(True))
    df = langs.join(runs, "change_id", "left").join(u, "change_id", "left").join(bad, "change_id", "left")
    code = (
        F.when(F.size("_o") > 0, "OTHER_LANGUAGES")
        .when(F.col("_py") == 0, "NO_PYTHON")
        .when(~F.coalesce("tool_found", F.lit(False)), "TOOL_MISSING")
        .when(F.coalesce("failed", F.lit(False)), F.coalesce("failure_code", F.lit("RUN_FAILED")))
        .when(F.col("_u"), "NOT_IMPORTED")
        .when(F.col("_m"), "EXTENTS_FILE_ERROR")
    )
    return df.select("change_id", code.alias("unknown_code"), F.when(F.size("_o") > 0, some_of(F.col("_o"), 5)).alias("others"))
