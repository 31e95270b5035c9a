"""The report row, its JSON form and the text for a terminal: columns over what fusion decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test

REPORT_VERSION = 1
ENGINE_VERSION = "0.1.0"

#: The sentence of each reason code, which consumers match on; {x} is a column of FIELDS.
SENTENCES = {
    "SAFE": "Tests pass and the changed code is covered.",
    "FLAKY": "Tests pass, but {flaky} test(s) flipped on retry (flaky); a stable green could not be established.",
    "NARROWED": "Tests pass, but the test command narrowed the suite ({signals}), so the tests that ran are a subset the caller chose.",
    "VARIED_ONE": "Tests pass, but a test outcome varied across reruns ({first_varied}); the green is flaky, not stable. Fix the flakiness or the verdict cannot be SAFE.",
    "VARIED_MANY": "Tests pass, but {varied} test outcomes varied across reruns; the green is flaky, not stable. Fix the flakiness or the verdict cannot be SAFE.",
    "REMOVAL_ONLY": "Tests pass. The change only removes code; there are no added lines for coverage to attest.",
    "INERT_ONLY": "Tests pass. The change only touches comments and blank lines; there are no added statements for coverage to attest.",
    "REMOVAL_AND_INERT": "Tests pass. The change only removes code and touches comments and blank lines; there are no added statements for coverage to attest.",
    "PARTIAL": "Tests pass, but only {covered_statements} of {total} changed statements were exercised.",
    "NOT_EXERCISED": "Tests pass, but the changed code is not exercised by any test.",
    "COVERAGE_UNKNOWN": "Tests pass, but coverage of the changed code could not be determined.",
    "BRANCH_ONE": "Tests pass, but a changed conditional has a branch no test took ({first_gap}). Add a test that enters the other branch.",
    "BRANCH_MANY": "Tests pass, but {gaps} changed conditionals have a branch no test took. Add tests that enter the untaken branches.",
    "SURVIVOR_ONE": "Tests pass, but a mutant of a changed statement survived ({first_survivor}): no test failed when its behaviour changed. Add a test that asserts on it.",
    "SURVIVOR_MANY": "Tests pass, but {survivors} mutants of changed statements survived: no test failed when their behaviour changed. Add assertions that would catch them.",
    "NO_RUNNER": "no test runner detected (pytest, vitest, jest); pass testCmd to override",
    "BASELINE_RED": "baseline tests already fail before refactoring; fix them first.",
    "GATE_SYNTAX": "{gate_reason}",
    "GATE_IMPORTS": "{gate_reason}",
    "GATE_TESTS": "{gate_reason}",
}
# ---- fixed values: hints and notes, which consumers match on; {0}, {1} are filled in ----
EXCLUDED_HINT = "{0} is excluded from coverage (e.g. `# pragma: no cover`, `if TYPE_CHECKING:`), so no test can exercise it; review this change by hand"
TEST_HINT = "add a test exercising {0}"
NOTES = {
    "narrowed": "  note: the test command narrowed the suite ({0}), so this run cannot be SAFE. Re-run without the filter to get a verdict on the whole suite.",
    "unknown_scope": "  note: could not determine whether the test command runs the whole suite{0}; the verdict assumes it does.",
    "flaky": "note: {0} test(s) flipped on retry and were treated as flaky: {1}",
    "mutation_not_run": "note: --mutate did not run ({0}); this verdict is not mutation-checked",
    "nothing_to_mutate": "note: --mutate found no mutable operators or constants in the changed statements; nothing to check",
    "mutation_budget": "only {0} of {1} mutants were run (budget)",
    "mutation_inconclusive": "{0} inconclusive (skipped)",
    "mutation_incomplete": "note: --mutate was incomplete — {0}; a surviving mutant could have been missed",
    "stability_not_run": "note: --flaky-check did not run ({0}); this verdict is not stability-checked",
    "stability_inconclusive": "note: --flaky-check reran the suite but every rerun was inconclusive ({0} timed out); flakiness could have been missed",
    "no_conclusion": "no conclusion",
}
# ---- end of fixed values ----


def filled(text: str, *values: Column) -> Column:
    """text with {0}, {1} as columns."""
    parts = [text]
    for k, v in enumerate(values):
        parts = [y for x in parts for y in ([x] if not isinstance(x, str) else [z for i, w in enumerate(x.split(f"{{{k}}}")) for z in ([v.cast("string"), w] if i else [w])])]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


#: Columns that sentences name; those that a frame lacks count as empty.
FIELDS = ("flaky", "signals", "first_varied", "varied", "covered_statements", "total", "first_gap", "gaps", "first_survivor", "survivors", "gate_reason")


def reason(df: DataFrame) -> Column:
    """The sentence of df's reason_code."""
    have = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("")
    out = F.when(F.col("reason_code").isNull(), F.lit(None).cast("string"))
    for code, text in SENTENCES.items():
        parts, rest = [], text
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), have(name)]
        out = out.when(F.col("reason_code") == code, F.concat(*parts, F.lit(rest)))
    return out


def file_lists(files: DataFrame) -> DataFrame:
    """Per change: its files in order, and those that are tests."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "path"))), lambda x: x["path"])
    return files.groupBy("change_id").agg(ordered.alias("changed_files")).withColumn("test_files", F.filter("changed_files", lambda p: is_test(p)))


def uncovered_lists(shown: DataFrame) -> DataFrame:
    """Per change, from capped rows: uncovered, an array in order, and shown and total. At most the cap's rows each."""
    row = F.struct("file_ord", "pos", F.col("path").alias("file"), F.col("stmt").alias("line"), "excluded")
    item = lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), F.when(x["excluded"], True).alias("excluded"))
    return shown.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(row)), item).alias("uncovered"), F.max("shown").alias("shown"), F.max("total").alias("uncovered_all"))


def hint_text(at: Column, excluded: Column) -> Column:
    return F.when(excluded, filled(EXCLUDED_HINT, at)).otherwise(filled(TEST_HINT, at))


def hint(u: Column) -> Column:
    return F.struct(u["file"].alias("file"), hint_text(F.concat(u["file"], F.lit(":"), u["line"].cast("string")), F.coalesce(u["excluded"], F.lit(False))).alias("hint"))


def verdict_report(fused: DataFrame, files: DataFrame, shown: DataFrame, hints: int = 50) -> DataFrame:
    """One row for each change with the report's fields as columns; absent fields are NULL."""
    df = fused.withColumn("reason", reason(fused)).join(file_lists(files), "change_id").join(uncovered_lists(shown), "change_id", "left")
    open_ = (F.col("verdict") == "UNPROVEN") & F.col("uncovered").isNotNull()
    cut = lambda n, most: F.when(n > most, F.struct(F.lit(most).cast("long").alias("shown"), n.cast("long").alias("total")))
    gate = lambda name: F.struct(F.col(f"{name}_passed").alias("passed")).alias(name)
    listed = F.coalesce("uncovered", F.array().cast("array<struct<file:string,line:int,excluded:boolean>>"))
    return df.select(
        "change_id",
        F.lit(REPORT_VERSION).alias("reportVersion"),
        F.lit(ENGINE_VERSION).alias("engineVersion"),
        "verdict",
        "reason",
        F.struct(gate("syntax"), gate("imports"), gate("tests")).alias("gates"),
        F.col("changed_files").alias("changedFiles"),
        F.col("test_files").alias("testFilesChanged"),
        F.struct(
            F.when(F.col("covered_state") != "unknown", F.lit("coverage.py")).otherwise("none").alias("tool"),
            F.col("covered_state").alias("changedLinesCovered"),
            listed.alias("uncovered"),
            F.when(F.col("uncovered_all") > F.col("shown"), F.struct("shown", F.col("uncovered_all").alias("total"))).alias("uncoveredTruncated"),
            F.when(F.col("files_with_uncovered") > 0, F.col("files_with_uncovered")).alias("filesWithUncovered"),
            F.struct("total", F.col("covered_statements").alias("covered")).alias("changedStatements"),
        ).alias("coverage"),
        F.struct("scope").alias("testScope"),
        F.when(open_, F.transform(F.slice("uncovered", 1, hints), hint)).alias("missingTests"),
        F.when(open_, cut(F.col("uncovered_all"), hints)).alias("missingTestsTruncated"),
    )


def as_json(reports: DataFrame) -> DataFrame:
    """change_id and report, pretty JSON; NULL fields are left out."""
    row = F.struct(*[c for c in reports.columns if c != "change_id"])
    return reports.select("change_id", F.to_json(row, {"pretty": "true"}).alias("report"))


def _preview(names: Column) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, ", ...").otherwise(""))


def notes() -> Column:
    """Notes about what a verdict rests on, in their order, over columns scope, signals, source, flaky_tests, mutation (ran, skipped,
    tested, all: how many there were beyond the budget, inconclusive) and stability (ran, skipped, varied, runs, inconclusive);
    mutation and stability are NULL where they weren't asked for."""
    n = {k: (lambda *v, t=t: filled(t, *v)) for k, t in NOTES.items()}
    signals, flaky, m, s = F.array_join("signals", "; "), F.col("flaky_tests"), F.col("mutation"), F.col("stability")
    why = lambda x: F.coalesce(x["skipped"], F.lit(NOTES["no_conclusion"]))
    scope = F.when(F.col("scope") == "narrowed", n["narrowed"](signals)).when((F.col("scope") == "unknown") & (F.col("source") == "override"), n["unknown_scope"](F.when(signals != "", F.concat(F.lit(" ("), signals, F.lit(")"))).otherwise("")))
    parts = F.array_compact(F.array(F.when(m["all"].isNotNull(), n["mutation_budget"](m["tested"], m["all"])), F.when(m["inconclusive"] > 0, n["mutation_inconclusive"](m["inconclusive"]))))
    mutation = F.when(~m["ran"], n["mutation_not_run"](why(m))).when(m["tested"] == 0, n["nothing_to_mutate"]()).when(F.size(parts) > 0, n["mutation_incomplete"](F.array_join(parts, "; ")))
    stability = F.when(~s["ran"], n["stability_not_run"](why(s))).when((s["varied"] == 0) & (s["runs"] == 0) & (s["inconclusive"] > 0), n["stability_inconclusive"](s["inconclusive"]))
    return F.array_compact(F.array(scope, F.when(F.size(flaky) > 0, n["flaky"](F.size(flaky), _preview(flaky))), mutation, stability))


def as_text(reports: DataFrame) -> DataFrame:
    """change_id and text: the verdict's line, then what is uncovered, then notes in a fixed order."""
    u, cut = F.col("coverage.uncovered"), F.col("coverage.uncoveredTruncated")
    files, stats = F.col("coverage.filesWithUncovered"), F.col("coverage.changedStatements")
    spread = F.when(files > 1, F.concat(F.lit(" across "), files.cast("string"), F.lit(" files"))).otherwise("")
    line = lambda x: F.concat(F.lit("  uncovered: "), x["file"], F.lit(":"), x["line"].cast("string"), F.when(x["excluded"], " (excluded from coverage; no test can reach it)").otherwise(""))
    more = F.concat(F.lit("  ... and "), (cut["total"] - cut["shown"]).cast("string"), F.lit(" more uncovered statement(s) ("), cut["total"].cast("string"), F.lit(" total"), spread, F.lit(")"))
    gap = F.concat(F.lit("  note: "), stats["covered"].cast("string"), F.lit(" of "), stats["total"].cast("string"), F.lit(" changed statements were exercised; "), (stats["total"] - stats["covered"]).cast("string"), F.lit(" could not be"), spread, F.lit(" (excluded from coverage). See --json for the list."))
    safe = F.col("verdict") == "SAFE"
    tests = F.col("testFilesChanged")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("["), "verdict", F.lit("] "), "reason"),
        F.when(safe & (stats["total"] > 0) & (stats["covered"] < stats["total"]), gap),
        F.when(~safe & (F.size(u) > 0), F.array_join(F.transform(u, line), "\n")),
        F.when(~safe & cut.isNotNull(), more),
        F.when(F.size(tests) > 0, F.concat(F.lit("note: this diff modifies test files ("), F.size(tests).cast("string"), F.lit("): "), _preview(tests))),
    )
    return reports.select("change_id", lines.alias("text"))
