"""One query for each operator, over evidence by rule from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import attribution as at
from ..operators import containment, deepchecks, deltas, diffs, fusion, intake, placement, report, resolution
from ..operators import perfile
from ..sources import evidence, scratch
from ..sources.evidence import Documents, table

CAP, PER_FILE, HINTS = 6, 2, 4


def _attributed(d: Documents) -> DataFrame:
    return at.attribute(d.changed, at.runs_of(d.owners), d.mapped)


def _status(d: Documents) -> DataFrame:
    return at.statement_status(at.statements(_attributed(d)), d.coverage, d.branches)


class Shared:
    """The attributed lines and statements of documents, for the several branches that read them."""

    def __init__(self, d: Documents):
        self.attributed = _attributed(d)
        self.status = at.statement_status(at.statements(self.attributed), d.coverage, d.branches)


def _by_file(d: Documents, shared: Shared | None = None) -> DataFrame:
    shared = shared or Shared(d)
    return at.by_file(d.files, shared.attributed, shared.status)


def _fused_documents(d: Documents, shared: Shared) -> DataFrame:
    rule = at.nothing_to_attest(at.coverage_rule(_by_file(d, shared)))
    state = fusion.coverage_state(rule, at.unmeasured(d.files, d.changed, d.measured)).join(at.first_gap(shared.status), "change_id", "left")
    none = {c: F.lit(0) for c in ("survivors", "varied", "flaky")}
    passed = {f"{g}_passed": F.lit(True) for g in ("syntax", "imports", "tests")}
    return fusion.fuse(state.withColumns({**none, **passed, "tests_code": F.lit("PASSED"), "scope": F.lit("full"), "covered_statements": F.col("covered"), "covered": F.col("covered_state")}))


def change_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    return _fused_documents(d, Shared(d)).select("change_id", "total", F.col("covered_statements").alias("covered"), "verdict", "reason_code")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    shared = Shared(d)
    return report.verdict_report(_fused_documents(d, shared), d.files, at.fair_share(shared.status.filter(~F.col("covered")), CAP, PER_FILE), HINTS)


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(_reports(spark, sf_dir))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text(_reports(spark, sf_dir))


def report_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("change_id", "verdict", "reason", F.size("changedFiles").alias("files"), F.size("coverage.uncovered").alias("listed"), "missingTestsTruncated.total")


def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Documents(spark, sf_dir).lines.select("doc_id", F.col("line").alias("line_no"), F.col("inert").alias("is_inert"))


def statement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.runs_of(Documents(spark, sf_dir).owners)


def owner_of_changed_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(Documents(spark, sf_dir)).select("path", "line", "owner")


def first_seen_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.statements(_attributed(Documents(spark, sf_dir))).select("path", "stmt", "first_line")


def attribution_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_file(Documents(spark, sf_dir)).select("path", "statements", "covered", "excluded", "gaps", "had_lines")


def coverage_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.coverage_rule(_by_file(Documents(spark, sf_dir))).select("change_id", "changed_lines_covered", "files_with_uncovered", "total")


def nothing_to_attest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = at.nothing_to_attest(at.coverage_rule(_by_file(Documents(spark, sf_dir))))
    return rule.select("change_id", "inert_files", "removal_files", "all_accounted")


def partial_branch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(Documents(spark, sf_dir)).filter("gap").select("path", "stmt")


def _uncovered(d: Documents) -> DataFrame:
    return _status(d).filter(~F.col("covered"))


def uncovered_fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.fair_share(_uncovered(Documents(spark, sf_dir)), CAP, PER_FILE).select("change_id", "path", "stmt", "shown", "total")


def missing_test_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.hints(at.fair_share(_uncovered(Documents(spark, sf_dir)), CAP, PER_FILE), HINTS)


def unmeasured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    return at.unmeasured(d.files, d.changed, d.measured)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a repository: the url's path, with an extension by rule."""
    p = table(spark, sf_dir, "pages")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".py", ".ts", ".py", "_test.py", ".md", ".mjs", ".spec.ts")]), (F.col("page_id") % 8 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 5 == 0, "tests/").when(F.col("page_id") % 7 == 0, "./src/").when(F.col("page_id") % 11 == 0, "..\\up/").otherwise("src\\")
    name = F.regexp_replace("url", "^https?://([^/]*)/.*$", "$1")
    path = F.concat(folder, name, F.lit("_"), F.col("page_id").cast("string"), ext)
    return p.select("page_id", F.concat(F.lit("c"), F.expr("page_id div 3")).alias("change_id"), path.alias("path"), name.alias("host"), "html")


def python_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).withColumn("py", F.col("path").endswith(".py"))
    other = F.sort_array(F.collect_list(F.when(~F.col("py"), F.col("path"))))
    return p.groupBy("change_id").agg(F.bool_and("py").alias("all_python"), other.alias("_o")).select("change_id", "all_python", paths.some_of(F.col("_o"), 2).alias("others"))


def _import_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports; a page's base is the page before it."""
    p = _pages(spark, sf_dir).select("page_id", "html")
    m = F.explode(F.regexp_extract_all("html", F.lit(r'href="/?([^"]+)"'), 1)).alias("module")
    refs = p.select("page_id", m)
    mine = refs.select("page_id", "module", F.lit("shadow").alias("side"))
    return mine.unionByName(refs.select((F.col("page_id") + 1).alias("page_id"), "module", F.lit("base").alias("side")))


def _introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _import_refs(spark, sf_dir).withColumn("top", F.substring_index("module", ".", 1))
    known = refs.filter(F.length("top") % 3 == 0).select("top").distinct()
    bad = refs.join(known, "top", "left_anti")
    pages = table(spark, sf_dir, "pages").select("page_id")
    return deltas.introduced(bad, ["page_id", "top"]).join(pages, "page_id", "left_semi")


def imports_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _introduced(spark, sf_dir).select("page_id", F.col("top").alias("module"))


def import_reasons_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _introduced(spark, sf_dir).select(F.concat(F.lit("c"), F.expr("page_id div 3")).alias("change_id"), F.concat(F.lit("p"), "page_id").alias("path"), F.col("top").alias("module"))
    return deltas.reasons(rows, 5)


def _logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of suites, with what both channels say: in either runner's form, indented, with carriage returns."""
    e = table(spark, sf_dir, "events")
    k, user, n, kind = F.get_json_object("props", "$.k"), F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type")
    name = F.concat(F.lit("tests/s"), user, F.lit(".py::t"), k)
    end = F.when(n % 4 == 0, "\r").otherwise("")
    blanks = F.repeat(F.lit(" "), (n % 3).cast("int"))
    vitest = F.when(n % 4 == 0, F.concat(F.lit("× src/s"), user, F.lit(".spec.mjs"), end)).otherwise(F.concat(F.lit(" FAIL  src/s"), user, F.lit(".test.ts > adds "), k, F.lit(" > t ")))
    stdout = (
        F.when(kind == "error", F.concat(blanks, F.lit("FAILED "), name, F.lit(" - boom - again"), end, F.lit("\n1 failed")))
        .when(kind == "purchase", F.concat(vitest, F.lit("\n FAIL  src/util.ts > no test's name")))
        .otherwise(F.concat(F.lit("PASSED "), name))
    )
    stderr = F.when(kind == "signup", F.concat(F.lit("\tERROR  "), name, end))
    return e.select("event_id", F.col("user_id").alias("suite"), stdout.alias("stdout"), stderr.alias("stderr"))


def failure_ids_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.run_failures(_logged_runs(spark, sf_dir), ["suite"])


def new_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_id") % 3 == 0, "base").otherwise("shadow")
    return deltas.introduced(deltas.run_failures(_logged_runs(spark, sf_dir).withColumn("side", side), ["suite", "side"]), ["suite", "test_id"])


def failure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    marks = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("FAIL  t"), "turn")).when(F.col("turn") % 6 == 5, F.lit("Test Files  1 failed"))
    # a turn's mark is a line of its own before all lines of its text
    lines = F.concat(F.array_compact(F.array(marks)), F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>")))
    rows = c.select("conv_id", "turn", F.posexplode(lines).alias("n", "line")).select("conv_id", F.struct("turn", "n").alias("at"), "line")
    return deltas.failure_blocks(rows, ["conv_id"], "at", F.startswith("line", F.lit("FAIL  ")), F.startswith("line", F.lit("Test Files")))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = F.col("event_type").isin("error", "purchase")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", red.cast("int").alias("exit_code"))


def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _attempts(spark, sf_dir).select(F.expr("event_id div 4").alias("suite"), (F.col("event_id") % 4).alias("attempt"), "exit_code")
    return deltas.last_attempt(runs, ["suite"])


def tests_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _attempts(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, "baseline").when(F.col("event_id") % 3 == 1, "after").otherwise("retry")
    e = e.withColumns({"change_id": F.expr("event_id div 3"), "run_kind": kind})
    runs = e.filter("event_id % 31 <> 0").select("change_id", "run_kind", "exit_code")
    ids = e.filter("event_type = 'error'").select("change_id", "run_kind", F.concat(F.lit("t"), "user_id").alias("test_id"))
    return deltas.tests_gate(runs, ids)


def _stability(events: DataFrame) -> DataFrame:
    e = events.select(F.expr("event_id div 5").alias("suite"), (F.col("event_id") % 5).alias("run_no"), (F.col("event_type") == "signup").alias("timed_out"), "exit_code", "event_type", "user_id")
    ids = e.filter("event_type = 'error'").select("suite", "run_no", F.concat(F.lit("t"), "user_id").alias("test_id"))
    return deepchecks.stability(e.select("suite", "run_no", "timed_out", "exit_code"), ids, ["suite"])


def stability_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(_attempts(spark, sf_dir))


def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "constant").otherwise("operator")
    outcome = F.when(F.col("l_partkey") % 5 == 0, "inconclusive").when(F.col("l_linestatus") == "O", "killed").otherwise("survived")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", kind.alias("kind"), outcome.alias("outcome"))


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def mutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deepchecks.mutation_summary(deepchecks.chosen(_mutants(spark, sf_dir), ["l_orderkey"], ORDER, 1 << 30), ["l_orderkey"], 3)


def mutant_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deepchecks.chosen(_mutants(spark, sf_dir), ["l_orderkey"], ORDER, 3).select("l_orderkey", "l_linenumber", "l_partkey", "kind", "rn")


def mutant_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Documents(spark, sf_dir).lines.filter(F.length("line_text") > 4).withColumns({"col": F.lit(2), "end_col": F.lit(4), "repl": F.lit("<=")})
    right = F.expr("substring(line_text, 3, 2)")
    lines = lines.withColumn("orig", F.when((F.col("doc_id") + F.col("line")) % 3 == 0, F.lit("==")).otherwise(right))
    return lines.select("doc_id", F.col("line").alias("line_no"), deepchecks.spliced("line_text").alias("mutated"))


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes, with every input of the decision list by rule."""
    k = F.col("o_orderkey")
    one = lambda m, r: (k % m == r).cast("long")
    covered = F.when(F.col("o_orderstatus") == "P", "unknown").when(k % 3 == 0, "false").otherwise("true")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (k % 19 != 0).alias("syntax_passed"),
        (k % 17 != 0).alias("imports_passed"),
        (k % 5 != 0).alias("tests_passed"),
        F.when(k % 5 == 0, F.when(k % 25 == 0, "NO_RUNNER").when(k % 10 == 0, "BASELINE_RED").otherwise("FAILED")).otherwise("PASSED").alias("tests_code"),
        covered.alias("covered"),
        (one(23, 1) + one(29, 1)).alias("gaps"),
        (one(7, 1) + one(14, 1)).alias("survivors"),
        (one(11, 2) + one(22, 2)).alias("varied"),
        one(13, 3).alias("flaky"),
        F.when(F.col("o_orderpriority").startswith("1"), "narrowed").when(F.col("o_orderpriority").startswith("5"), "unknown").otherwise("full").alias("scope"),
        F.when((covered == "false") & (k % 4 == 0), 0).otherwise(3).cast("long").alias("uncovered_total"),
        (k % 9).alias("total"),
        F.greatest(k % 9 - 3, F.lit(0)).alias("covered_statements"),
        (k % 2).alias("removal_files"),
        (F.expr("o_orderkey div 2") % 2).alias("inert_files"),
        (k % 4 == 0).alias("all_accounted"),
    )


def fuse_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(fusion.masked_gates(_gates(spark, sf_dir))).select("o_orderkey", "verdict", "reason_code", "scope")


def reason_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_full(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("n"))


def gated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with mutants and reruns, which are only read for changes that could still be safe."""
    gates = fusion.masked_gates(_gates(spark, sf_dir).drop("survivors", "varied"))
    safe = gates.filter(fusion.would_be_safe()).select(F.col("o_orderkey").alias("_safe"))
    mutants = _mutants(spark, sf_dir).join(safe, F.col("l_orderkey") == F.col("_safe"), "left_semi")
    tested = deepchecks.mutation_summary(deepchecks.chosen(mutants, ["l_orderkey"], ORDER, 1 << 30), ["l_orderkey"], 3).select(F.col("l_orderkey").alias("_m"), F.col("survived").alias("survivors"))
    events = _attempts(spark, sf_dir).withColumn("suite", F.expr("event_id div 5")).join(safe, F.col("suite") == F.col("_safe"), "left_semi")
    rerun = _stability(events).select(F.col("suite").alias("_s"), "varied")
    df = gates.join(tested, F.col("o_orderkey") == F.col("_m"), "left").join(rerun, F.col("o_orderkey") == F.col("_s"), "left").na.fill(0, ["survivors", "varied"])
    return fusion.fuse(df).select("o_orderkey", "verdict", "reason_code", "scope")


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_full(spark, sf_dir).select("o_orderkey", fusion.exit_code().alias("exit_code"))


def first_failed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gates(spark, sf_dir)
    rows = [F.struct(F.lit(i).alias("gate_ord"), F.lit(n).alias("gate"), F.col(f"{n}_passed").alias("passed"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(f"{n} broke")).alias("reason")) for i, n in enumerate(("syntax", "imports", "tests"))]
    return fusion.first_failed(g.select("o_orderkey", F.explode(F.array(*rows)).alias("x")).select("o_orderkey", "x.*"), "o_orderkey")


def test_file_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("path", paths.is_test(F.col("path")).alias("is_test"), paths.is_discovered(F.col("path")).alias("is_discovered"))


def normalise_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _pages(spark, sf_dir).select("path", paths.normalise(paths.strip_prefix(p)).alias("normalised"), paths.inside(p).alias("inside"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.entries(diffs.diff_lines(evidence.diffs(spark, sf_dir)))


def diff_entry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.entry_flags(_entries(spark, sf_dir)).select("path", "deleted", "renamed", "copied", "submodule", "is_binary")


def diff_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, base = _kept(evidence.diffs(spark, sf_dir), "diffs"), _kept(evidence.bases(spark, sf_dir), "bases")  # several branches read them
    e = _kept(diffs.entries(diffs.diff_lines(raw)), "diff-entries")
    flags, hunks = diffs.entry_flags(e), _kept(diffs.hunks(e), "diff-hunks")
    return diffs.refusal(raw, flags, hunks, diffs.entry_errors(flags, hunks, base, placement.placed(hunks, base)))


def hunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placement.placed(_kept(diffs.hunks(_entries(spark, sf_dir)), "diff-hunks"), evidence.bases(spark, sf_dir))
    shown = F.array_join(F.transform("at_lines", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return found.select("path", "applies", shown.alias("at_lines"))


def applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that diffs make of their bases, where they apply."""
    base = _kept(evidence.bases(spark, sf_dir), "bases")
    hunks = _kept(diffs.hunks(_entries(spark, sf_dir)), "diff-hunks")
    made = placement.applied(hunks, base, placement.placed(hunks, base))
    return made.select("path", F.length("new_content").alias("size"), F.md5("new_content").alias("digest"))


def hunk_new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.new_lines(_entries(spark, sf_dir)).select("path", "line")


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffs of many changes as eight bundles, read back in pieces: the lines that each bundle's hunks add. Each task that
    has diffs writes its share of a bundle as one file, so no task meets a whole one."""
    k = F.substring("change_id", 2, 20).cast("long")
    raw = evidence.diffs(spark, sf_dir).withColumn("bundle", k % 8).filter(k % 53 != 0)  # those with a hunk cut short would take lines of the next
    folder = scratch.folder(spark, "diffs")
    raw.select("bundle", F.regexp_replace("text", r"\n\z", "").alias("text")).write.partitionBy("bundle").text(folder)
    # a piece is told by its place; of its file only the bundle's number goes on to its lines
    pieces = evidence.diff_files(spark, folder).withColumn("change_id", F.regexp_extract("change_id", r"bundle=(\d+)", 1))
    return diffs.new_lines(diffs.entries(diffs.diff_lines(pieces))).select(F.col("change_id").cast("int").alias("bundle"), "path", "line")


def coverage_json_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by rule, written as the reports of a tool and read back."""
    d = Documents(spark, sf_dir)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("line")))).alias(f"{s}_lines")
    files = d.coverage.groupBy("change_id", "path").agg(of("executed"), of("missing"), of("excluded"))
    entry = F.struct("path", F.struct("executed_lines", "missing_lines", "excluded_lines"))
    json = files.groupBy("change_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("json"))
    return evidence.coverage_sets(json)[0].select("path", "line", "status")


def coverage_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in which some entries aren't of their shape: lines of the others, and those as unknown."""
    d = Documents(spark, sf_dir)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("line")))).alias(f"{s}_lines")
    files = d.coverage.groupBy("change_id", "path").agg(of("executed"), of("missing"), of("excluded"))
    n = F.substring("path", 2, 20).cast("long")
    entry = (
        F.when(n % 19 == 0, '"none"')
        .when(n % 23 == 0, '{"executed_lines": "1-5", "missing_lines": []}')
        .when(n % 29 == 0, '{"executed_lines": [1, "2"], "missing_lines": []}')
        .when(n % 31 == 0, '{"missing_lines": [1]}')
        .when(n % 37 == 0, '{"executed_lines": [1, null], "missing_lines": []}')
        .when(n % 41 == 0, '{"executed_lines": [1], "missing_lines": [], "missing_branches": [1, 2]}')
        .otherwise(F.to_json(F.struct("executed_lines", "missing_lines", "excluded_lines")))
    )
    json = files.groupBy("change_id").agg(F.concat(F.lit('{"meta": {"version": "7"}, "files": {'), F.array_join(F.collect_list(F.concat(F.lit('"'), "path", F.lit('": '), entry)), ", "), F.lit("}}")).alias("json"))
    lines, _, _, damaged = evidence.coverage_sets(json)
    return lines.select("path", "line", "status").unionByName(damaged.select("path", F.lit(None).cast("int").alias("line"), F.lit("unknown").alias("status")))


def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = [F.lit("c").alias("change_id"), F.col("l_orderkey").cast("string").alias("path")]
    spans = li.select(*keys, F.col("l_linenumber").alias("istart"), (F.col("l_linenumber") + (F.col("l_quantity") % 5)).cast("int").alias("iend"))
    points = li.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("line"))
    return at.innermost(points, spans).select(F.col("path").cast("long").alias("l_orderkey"), F.col("line").alias("point"), "owner")


def outside_testpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files outside every folder that the change's configuration names; a change that names none has none outside."""
    p = _pages(spark, sf_dir).select("change_id", paths.normalise(F.col("path")).alias("file"), "page_id")
    named = p.filter("page_id % 4 <> 3").select("change_id", F.when(F.col("page_id") % 2 == 0, "tests/").otherwise("./src").alias("folder")).distinct()
    right = named.withColumnsRenamed({"change_id": "_c"})
    outside = p.join(named, "change_id", "left_semi").join(right, (F.col("change_id") == F.col("_c")) & paths.under(F.col("file"), F.col("folder")), "left_anti")
    return outside.select("change_id", "file")


def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as repositories with chains of links, one out of the repository, one to nothing and a cycle; pages' files reached by them."""
    p = _pages(spark, sf_dir).select(F.col("host").alias("tree"), "page_id", (F.col("page_id") % 7).cast("string").alias("d"), F.concat(F.lit("/r/"), "host").alias("root"))
    k = F.col("page_id").cast("string")
    trees = p.select("tree", "root").distinct()
    made = {"l0": "d0", "l1": "l0", "l2": "../../etc", "l3": "l4", "l4": "l3", "l5": None, "l6": "gone", "l7": "l1/../d2"}
    each = F.array(*[F.struct(F.lit(a).alias("at"), (F.concat("root", F.lit("/d1")) if b is None else F.lit(b)).alias("target")) for a, b in made.items()])
    links = trees.select("tree", "root", F.explode(each).alias("x")).select("tree", F.concat("root", F.lit("/"), "x.at").alias("path"), "x.target")
    folder = F.concat("root", F.lit("/d"), "d")
    files = p.select("tree", F.explode(F.array(F.struct(folder.alias("path"), F.lit(True).alias("folder")), F.struct(F.concat(folder, F.lit("/p"), k).alias("path"), F.lit(False).alias("folder")))).alias("x"))
    other = F.array(*[F.struct(c.alias("path"), F.lit(d).alias("folder")) for c, d in ((F.lit("/r"), True), (F.col("root"), True), (F.lit("/etc"), True), (F.lit("/etc/passwd"), False))])
    exists = files.unionByName(trees.select("tree", F.explode(other).alias("x"))).select("tree", "x.path", "x.folder")
    n = F.col("page_id") % 10
    rel = (
        F.when(n < 8, F.concat(F.lit("l"), n.cast("string"), F.when(F.col("page_id") % 3 == 0, "/passwd").otherwise(F.concat(F.lit("/p"), k))))
        .when(n == 8, F.concat(F.lit("d"), "d", F.lit("/./p"), k))
        .otherwise(F.concat(F.lit("../"), "tree", F.lit("/x/../d"), "d", F.lit("/new/p"), k))
    )
    return containment.contained(p.select("tree", rel.alias("rel")), trees, links, exists, _kept).select("tree", "rel", "real", "inside")


def _kept(df: DataFrame, what: str) -> DataFrame:
    """df written to a folder that all share and read again."""
    folder = scratch.folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _module_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links of pages as imports of TypeScript and Python files, and the trees of both sides with what some of them name."""
    p = _pages(spark, sf_dir)
    name = F.explode(F.transform(F.regexp_extract_all("html", F.lit(r'href="/?([^"]+)"'), 1), lambda m: F.regexp_replace(m, "[^A-Za-z]", "_"))).alias("m")
    refs = p.select("page_id", "change_id", name).distinct()
    n, m, size = F.col("page_id"), F.col("m"), F.length("m") % 4
    python = n % 3 == 0
    spec = F.when(python, F.when(n % 2 == 1, F.concat(m, F.lit(".sub"))).otherwise(m)).when(n % 4 == 0, F.concat(F.lit("./"), m)).when(n % 4 == 1, F.concat(F.lit("./"), m, F.lit(".js"))).when(n % 4 == 2, F.concat(F.lit("../src/./"), m)).otherwise(m)
    path = F.concat(F.lit("src/p"), n.cast("string"), F.when(python, ".py").otherwise(".ts"))
    sides = F.explode(F.when(n % 2 == 0, F.array(F.lit("base"), F.lit("shadow"))).otherwise(F.array(F.lit("shadow")))).alias("side")
    imports = refs.select("change_id", path.alias("path"), spec.alias("module"), sides)
    more = lambda *t: F.array(*[F.concat(F.lit(a), m, F.lit(b)) for a, b in t])
    names = (
        F.when(size == 0, more(("src/", ".ts"), ("", ".py"), ("node_modules/", "/package.json")))
        .when(size == 1, more(("src/", "/index.ts"), ("", "/sub.py"), ("src/node_modules/@types/", "/index.d.ts")))
        .when(size == 2, more(("src/", ".d.ts"), ("", "/__init__.py")))
        .otherwise(F.array().cast("array<string>"))
    )
    both = F.explode(F.when(size < 2, F.array(F.lit("base"), F.lit("shadow"))).otherwise(F.array(F.lit("shadow")))).alias("side")
    files = refs.select("change_id", F.explode(names).alias("path"), "m").select("change_id", "path", "m", both).drop("m")
    return imports, files


def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that stand for nothing on their side, and whether the change brought them."""
    imports, files = _module_files(spark, sf_dir)
    builtins = spark.createDataFrame([("", "de"), ("", "the"), (".py", "the"), (".py", "und")], "suffix string, name string")
    found = resolution.unresolved(imports, files, builtins, ["side", "change_id"])
    new = deltas.introduced(found, ["change_id", "path", "module"]).select(F.col("path").alias("_p"), F.col("module").alias("_m"), F.lit(True).alias("new"))
    df = found.filter("side = 'shadow'").join(new, (F.col("path") == F.col("_p")) & (F.col("module") == F.col("_m")), "left")
    return df.select("path", "module", F.coalesce("new", F.lit(False)).alias("introduced"))


def console_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' commands, each with a PATH of its own, and the programs in their folders."""
    k = F.col("c_custkey")
    c, text = table(spark, sf_dir, "customer"), lambda x: x.cast("string")
    lines = F.array(*[F.lit(x) for x in ("#!/usr/bin/python3", "#!/usr/bin/env python3.11\r", "#!/usr/bin/python3 -s", "#!/bin/sh", "#!python3", "#! /opt/py/bin/python ", "#!/usr/bin/env -S python3", "ELF")])
    home = F.concat(F.lit("/home/u"), text(k % 50), F.lit("/bin"))
    opt = F.concat(F.lit("/opt/v"), text(k % 7), F.lit("/bin"))
    tool = F.concat(F.lit("tool"), text(k % 13))
    search = F.concat_ws(":", F.when(k % 11 == 0, ""), F.lit("/usr/bin"), F.concat(home, F.when(k % 2 == 0, "/").otherwise("")), F.when(k % 17 == 0, "bin"), opt)
    commands = c.select(k.alias("id"), F.when(k % 29 == 0, F.concat(F.lit("./"), tool)).otherwise(tool).alias("name"), search.alias("search"))
    h, g = (k % 50) * 13 + k % 13, (k % 7) * 13 + k % 13
    one = lambda d, x, e, f, o: c.select(F.concat(d, F.lit("/"), tool).alias("path"), (x % e != 0).alias("executable"), (x % f != 0).alias("is_file"), F.element_at(lines, ((x + o) % 8 + 1).cast("int")).alias("first_line")).distinct()
    return resolution.first_on_path(commands, one(home, h, 4, 9, 0).unionByName(one(opt, g, 3, 7, 3)))


def walked_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests found in a tree for each host, unknown from 3 on."""
    p = _pages(spark, sf_dir).withColumn("page_path", paths.normalise(F.col("path")))
    odd = F.when(F.col("page_id") % 9 == 0, F.lit("node_modules/")).when(F.col("page_id") % 10 == 0, F.lit(".hidden/")).otherwise("")
    tree = p.select(F.col("host").alias("change_id"), F.concat(odd, "page_path").alias("path"), F.lit("file").alias("kind"))
    out = intake.walked_tests(tree, 3)
    return out.select(F.col("change_id").alias("host"), F.array_join("tests", ",").alias("tests"), "truncated")


def unresolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "UNRESOLVED").otherwise("note")
    line = F.concat(kind, F.lit("\tf"), (F.col("event_id") % 50).cast("string"), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("\tm"), F.col("user_id").cast("string"))))
    return intake.unresolved_log(e.select(F.col("event_id").alias("change_id"), line.alias("line")))


def helper_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    bad = d.files.filter("doc_id % 17 = 3").select("change_id", "path", F.lit("SyntaxError").alias("reason"))
    return intake.accounted(d.files.select("change_id", "path"), d.files.filter("doc_id % 17 <> 3 and doc_id % 23 <> 4"), bad)


def coverage_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    ext = F.when(F.col("doc_id") % 29 == 0, ".ts").otherwise(".py")
    files = d.files.withColumn("path", F.concat("path", ext))
    k = F.substring("change_id", 2, 20).cast("long")
    runs = d.files.select("change_id").distinct().filter(k % 31 != 1).select("change_id", (k % 13 != 2).alias("tool_found"), (k % 11 == 3).alias("failed"), F.when(k % 2 == 0, "REPORT_FAILED").alias("failure_code"))
    return intake.coverage_availability(files, runs, at.unmeasured(d.files, d.changed, d.measured), d.files.filter("doc_id % 53 = 0").select("change_id", "path", F.lit("no").alias("error")))


def edits_or_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    size = F.length("text").alias("size")
    given = d.docs.filter("doc_id % 5 = 0").select("change_id", "path", F.lit("edits").alias("origin"), size)
    parsed = d.docs.filter("doc_id % 7 <> 0").select("change_id", "path", F.lit("diff").alias("origin"), size)
    return intake.chosen_edits(given, parsed)


def env_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.explode(F.array(*[F.lit(x) for x in ("_TOKEN", "_TOKENIZER", "_API_KEY", "_HOME", "_SECRET")]))
    names = table(spark, sf_dir, "nation").select(F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("n"), ends.alias("e"))
    names = names.select(F.concat("n", "e").alias("name"))
    return names.select("name", intake.kept_variable(F.col("name")).alias("kept"))


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' environments, a map each, without what a suite must not see, and the end of what the run said."""
    e = table(spark, sf_dir, "events")
    k, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    env = F.create_map(F.concat(F.lit("K"), k), k, F.concat(F.lit("U"), user, F.when(F.col("event_id") % 2 == 0, "_SECRET").otherwise("_SECRETS")), user, F.lit("GITHUB_TOKEN"), F.col("event_type"), F.lit("HOME"), F.lit("/home"))
    long_ = F.concat(F.repeat(F.lit("é"), (F.col("event_id") % 5000).cast("int")), F.lit("<"), user, F.lit(">"))
    kept = F.array_sort(F.map_keys(intake.kept_environment(env)))
    return e.select("event_id", F.array_join(kept, ",").alias("kept"), intake.output_tail(long_, F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("tail"))


def mutant_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutants and the runs of their places, some without a run and some with several."""
    place = ["l_orderkey", "l_linenumber", "l_partkey"]
    m = _mutants(spark, sf_dir)
    results = m.filter("l_partkey % 7 <> 0").select(*place, "outcome").unionByName(m.filter("l_partkey % 3 = 0").select(*place, F.lit("survived").alias("outcome")))
    found = deepchecks.outcomes(m.drop("outcome"), results, place)
    return found.groupBy("l_orderkey").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("killed", "survived", "inconclusive")])


def stability_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What varied in each suite's reruns: tests, or runs with their seeds."""
    e = _attempts(spark, sf_dir).select(F.expr("event_id div 5").alias("suite"), (F.col("event_id") % 5).alias("run_no"), (F.col("event_type") == "signup").alias("timed_out"), "exit_code", F.col("user_id").alias("seed"), "event_type", "event_id")
    ids = e.filter("event_type = 'error' and event_id % 2 = 0").select("suite", "run_no", F.concat(F.lit("t"), F.col("seed") % 9).alias("test_id"))
    found = deepchecks.varied_outcomes(e.select("suite", "run_no", "timed_out", "exit_code", "seed"), ids, ["suite"])
    return found.groupBy("suite").agg(F.array_join(F.array_sort(F.collect_list("test_id")), ", ").alias("varied"))


def command_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of runs, some without leave to ask and some whose input can't be taken."""
    k = F.col("o_orderkey")
    fused = fusion.fuse(fusion.masked_gates(_gates(spark, sf_dir)))
    code = fusion.exit_code(F.when(k % 37 == 0, "no such diff"), F.when(k % 43 != 0, k % 41 != 0))
    return fused.select("o_orderkey", code.alias("exit_code"))


def language_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of both languages for the files of a host; files of others have no gate."""
    p = _pages(spark, sf_dir).withColumn("language", paths.language(F.col("path"))).filter("language is not null")
    reason = F.when(F.length("html") % 3 != 0, F.concat(F.lit("bad "), "path"))
    return fusion.by_language(p.select("host", "language", reason.alias("reason")), ["host"], 2)


def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports: the notes about scope, flaky tests, mutants and reruns."""
    k = F.col("o_orderkey")
    names = F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.element_at(F.array(F.lit("full"), F.lit("narrowed"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("scope"),
        F.when(k % 2 == 0, F.array(F.lit("-k"), F.lit("a b"))).otherwise(F.array().cast("array<string>")).alias("signals"),
        F.when(k % 7 < 4, "override").otherwise("detected").alias("source"),
        F.when(k % 5 > 0, names).otherwise(F.array().cast("array<string>")).alias("flaky_tests"),
        F.when(k % 11 != 0, F.struct((k % 13 != 0).alias("ran"), F.when(k % 2 == 0, "no tests").alias("skipped"), (k % 4).alias("tested"), F.when(k % 6 == 0, k % 4 + 9).alias("all"), (k % 8).alias("inconclusive"))).alias("mutation"),
        F.when(k % 17 != 0, F.struct((k % 19 != 0).alias("ran"), F.lit(None).cast("string").alias("skipped"), (k % 3).alias("varied"), (k % 2).alias("runs"), (k % 5).alias("inconclusive"))).alias("stability"),
    )
    return df.select("o_orderkey", F.array_join(report.notes(), "\n").alias("notes"))


def runner_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner that a repository's files stand for, first match."""
    files = F.element_at(F.array(*[F.lit(x) for x in ("jest.config.js", "pytest.ini", "README.md", "vitest.config.ts", "setup.cfg", "pyproject.toml")]), (F.col("page_id") % 6 + 1).cast("int"))
    p = _pages(spark, sf_dir).select("host", files.alias("f"))
    has = lambda *x: F.bool_or(F.col("f").isin(*x))
    return p.groupBy("host").agg(has("vitest.config.ts", "vitest.config.js").alias("v"), has("jest.config.js", "jest.config.ts").alias("j"), has("pyproject.toml", "pytest.ini", "setup.cfg").alias("p")).select(
        "host", F.when(F.col("v"), "vitest").when(F.col("j"), "jest").when(F.col("p"), "pytest").alias("runner")
    )


def scope_of_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.scopes(perfile.commands(table(spark, sf_dir, "part")))


def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.plans(perfile.commands(table(spark, sf_dir, "part")))


def python_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.syntax(perfile.programs(table(spark, sf_dir, "part")))


def python_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.extents(perfile.programs(table(spark, sf_dir, "part")))


def python_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.mutants(perfile.programs(table(spark, sf_dir, "part")))


def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.imports(perfile.programs(table(spark, sf_dir, "part")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document and its edited form: every ninth line doubled in upper case."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("base"))
    edited = F.flatten(F.transform(F.split("base", "\n"), lambda x, i: F.when(i % 9 == 4, F.array(F.upper(x), F.lit("added"))).otherwise(F.array(x))))
    return docs.withColumn("new", F.array_join(edited, "\n"))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfile.changed_lines(_pairs(spark, sf_dir))


def apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line replaced by a hunk."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("base"))
    first = F.split("base", "\n")[0]
    patch = F.concat(F.lit("@@ -1,1 +1,2 @@\n-"), first, F.lit("\n+new first line\n+"), first, F.lit("\n"))
    return perfile.applied(docs.withColumn("patch", patch))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        change_verdict, explode_lines, statement_runs, owner_of_changed_line, first_seen_statement, attribution_by_file, coverage_rule, nothing_to_attest, partial_branch_gate,
        uncovered_fair_share, missing_test_hints, unmeasured_files, python_only_gate, imports_introduced, import_reasons_capped, failure_ids_from_log, new_failures, failure_blocks,
        last_attempt, tests_gate_decision, stability_varied, mutation_summary, mutant_budget, mutant_splice, first_failed_gate, fuse_full, reason_precedence, test_file_flag,
        normalise_path, diff_entry_flags, diff_refusal, hunk_places, applied_edits, hunk_new_lines, diff_files, coverage_json_sets, innermost_interval, outside_testpaths, env_kept, runner_choice, exit_code, report_json, report_text, report_reason,
        walked_tests, unresolved_log, helper_accounting, coverage_availability, edits_or_diff, path_containment, unresolved_imports, console_script, gated_checks, coverage_damaged, environments, mutant_outcomes, stability_outcomes, command_exit, language_gates, report_notes,
        scope_of_command, coverage_plan, python_syntax, python_extents, python_mutants, python_imports, apply_diff, changed_lines,
    )
}
