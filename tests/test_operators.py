"""Relational operators on small frames, random cases against plain models, and monotonicity of the verdict."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths, sources
from plumbline.operators import attribution as at
from plumbline.operators import containment, deltas, diffs, fusion, intake, perfile, placement, resolution
from plumbline.sources import evidence
from plumbline.streaming import fuse_stream


def test_fair_share_against_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for c in range(40):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(1, 5))]
        cap, left = 6, 6
        first = [min(n, 2) for n in sizes]
        taken = []
        for n in first:
            taken.append(min(n, left))
            left -= taken[-1]
        if sum(first) <= cap:
            for k, n in enumerate(sizes):
                more = min(n - taken[k], left)
                taken[k] += more
                left -= more
        for k, n in enumerate(sizes):
            rows += [(f"c{c}", k, f"f{k}", p) for p in range(n)]
            want |= {(f"c{c}", f"f{k}", p) for p in range(taken[k])}
    df = spark.createDataFrame(rows, "change_id string, file_ord int, path string, pos int")
    got = at.fair_share(df, 6, 2)
    assert {(r.change_id, r.path, r.pos) for r in got.collect()} == want
    totals = {r.change_id: r.total for r in got.collect()}
    assert all(totals[c] == sum(x[0] == c for x in rows) for c in totals)


def test_files_without_lines_survive_and_missing_maps_are_not_inert(spark):
    files = spark.createDataFrame([("c", "a", 0), ("c", "b", 1), ("c", "z", 2)], "change_id string, path string, file_ord int")
    changed = spark.createDataFrame([("c", 0, "a", 1, 5), ("c", 1, "b", 1, 2)], "change_id string, file_ord int, path string, pos int, line int")
    runs = spark.createDataFrame([("c", "a", 1, 3, 1)], "change_id string, path string, rfirst int, rlast int, owner int")
    mapped = spark.createDataFrame([("c", "a", None)], "change_id string, path string, error string")
    a = at.attribute(changed, runs, mapped)
    assert {(r.path, r.owner) for r in a.collect()} == {("a", None), ("b", -1)}
    none = spark.createDataFrame([], "change_id string, path string, line int, status string")
    arcs = spark.createDataFrame([], "change_id string, path string, src_line int, dst_line int")
    rule = at.nothing_to_attest(at.coverage_rule(at.by_file(files, a, at.statement_status(at.statements(a), none, arcs)))).first()
    assert not rule.changed_lines_covered and rule.files == 3 and rule.inert_files == 1 and rule.removal_files == 1 and not rule.all_accounted


def test_partial_branch_on_a_later_line_is_not_found(spark):
    attributed = spark.createDataFrame([("c", 0, "a", 1, 10, 10), ("c", 0, "a", 2, 11, 10)], "change_id string, file_ord int, path string, pos int, line int, owner int")
    cov = spark.createDataFrame([("c", "a", 10, "executed")], "change_id string, path string, line int, status string")
    for line, gap in ((10, True), (11, False)):
        arcs = spark.createDataFrame([("c", "a", line, 20)], "change_id string, path string, src_line int, dst_line int")
        (r,) = at.statement_status(at.statements(attributed), cov, arcs).collect()
        assert r.covered and r.gap is gap


DEFAULT = dict(
    syntax_passed=True, imports_passed=True, tests_passed=True, tests_code="PASSED", covered="true", gaps=0, survivors=0, varied=0, flaky=0,
    scope="full", uncovered_total=0, total=3, covered_statements=3, removal_files=0, inert_files=0, all_accounted=False,
)
FUSION = [
    ({}, "SAFE", "SAFE"),
    ({"syntax_passed": False}, "UNSAFE", "GATE_SYNTAX"),
    ({"imports_passed": False}, "UNSAFE", "GATE_IMPORTS"),
    ({"tests_passed": False, "tests_code": "FAILED"}, "UNSAFE", "GATE_TESTS"),
    ({"tests_passed": False, "tests_code": "NO_RUNNER"}, "UNPROVEN", "NO_RUNNER"),
    ({"tests_passed": False, "tests_code": "BASELINE_RED"}, "UNPROVEN", "BASELINE_RED"),
    ({"tests_passed": False, "tests_code": None}, "UNSAFE", "GATE_TESTS"),
    ({"scope": "narrowed"}, "UNPROVEN", "NARROWED"),
    ({"scope": "unknown"}, "SAFE", "SAFE"),
    ({"scope": "narrowed", "flaky": 1}, "UNPROVEN", "NARROWED"),
    ({"flaky": 1, "varied": 2}, "UNPROVEN", "FLAKY"),
    ({"varied": 2, "survivors": 1}, "UNPROVEN", "VARIED_MANY"),
    ({"survivors": 1}, "UNPROVEN", "SURVIVOR_ONE"),
    ({"survivors": 3, "covered": "false"}, "UNPROVEN", "PARTIAL"),
    ({"covered": "unknown", "flaky": 1, "scope": "narrowed"}, "UNPROVEN", "COVERAGE_UNKNOWN"),
    ({"covered": "false", "gaps": 1}, "UNPROVEN", "BRANCH_ONE"),
    ({"covered": "false", "gaps": 2}, "UNPROVEN", "BRANCH_MANY"),
    ({"covered": "false", "covered_statements": 0}, "UNPROVEN", "NOT_EXERCISED"),
    ({"covered": "false", "all_accounted": True, "removal_files": 1}, "UNPROVEN", "REMOVAL_ONLY"),
    ({"covered": "false", "all_accounted": True, "inert_files": 1}, "UNPROVEN", "INERT_ONLY"),
    ({"covered": "false", "all_accounted": True, "inert_files": 1, "removal_files": 1}, "UNPROVEN", "REMOVAL_AND_INERT"),
]


def test_fusion_cases(spark):
    rows = [(k, *{**DEFAULT, **c[0]}.values()) for k, c in enumerate(FUSION)]
    df = spark.createDataFrame(rows, "id int, " + fusion.NEEDS)
    got = {r.id: (r.verdict, r.reason_code) for r in fusion.fuse(df).collect()}
    assert [got[k] for k in range(len(FUSION))] == [c[1:] for c in FUSION]


def test_more_evidence_of_a_gap_never_raises_a_verdict(spark):
    worse = {"gaps": (0, 1), "survivors": (0, 1), "varied": (0, 1), "flaky": (0, 1), "covered": ("true", "unknown", "false"), "scope": ("full", "narrowed"), "tests_passed": (True, False)}
    combos = list(itertools.product(*worse.values()))
    rows = [(k, *{**DEFAULT, **dict(zip(worse, c, strict=True))}.values()) for k, c in enumerate(combos)]
    got = {r.id: r.verdict for r in fusion.fuse(spark.createDataFrame(rows, "id int, " + fusion.NEEDS)).collect()}
    rank = {"SAFE": 2, "UNPROVEN": 1, "UNSAFE": 0}
    for k, c in enumerate(combos):
        if got[k] == "SAFE":
            assert c == tuple(v[0] for v in worse.values())
        for j, name in enumerate(worse):
            if c[j] == worse[name][0]:
                for v in worse[name][1:]:
                    assert rank[got[combos.index((*c[:j], v, *c[j + 1 :]))]] <= rank[got[k]]


@pytest.mark.parametrize(
    ("path", "inside", "test", "normal"),
    [
        ("a/b.py", True, False, "a/b.py"),
        ("./a/../b.py", True, False, "a/../b.py"),
        ("../a.py", False, False, "../a.py"),
        ("a/../../b", False, False, "a/../../b"),
        ("/etc/x", False, False, "/etc/x"),
        ("", False, False, ""),
        ("tests\\a.py", True, True, "tests/a.py"),
        ("conftest.py", True, True, "conftest.py"),
        ("src/test_a.py", True, True, "src/test_a.py"),
        ("src/a.spec.mts", True, True, "src/a.spec.mts"),
        ("src/contest.py", True, False, "src/contest.py"),
        ("C:\\x", False, False, "C:/x"),
    ],
)
def test_paths(spark, path, inside, test, normal):
    p = F.lit(path)
    r = spark.range(1).select(paths.inside(p).alias("i"), paths.is_test(p).alias("t"), paths.normalise(p).alias("n")).first()
    assert (r.i, r.t, r.n) == (inside, test, normal)


def test_failure_ids(spark):
    lines = {
        "FAILED a.py::x - boom - more": "a.py::x", "ERROR b.py": "b.py", "  FAILED c": "c", "FAILED": None, "passed": None, "FAILED d::e\r": "d::e", "\tERROR  f - x\r": "f", "\u00a0FAILED g\u3000": "g", "FAILED  - x": "- x", "xFAILED h": None,
        " FAIL  src/a.test.ts > b > c ": "src/a.test.ts > b > c", "× src/a.spec.mjs\r": "src/a.spec.mjs", "✗ a.test.jsx >": None, "FAIL src/a.ts > b": None, "FAIL  a.test.ts>b": "a.test.ts > b", "FAIL a.test.ts b": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.test_id for r in deltas.failure_ids(df).collect()} == {k: v for k, v in lines.items() if v}


def test_failures_of_both_channels(spark):
    runs = [("a", "FAILED x\r\nok", "  ERROR y"), ("b", None, "FAIL z.test.ts > n"), ("c", None, None), ("d", "FAILED x", "FAILED x")]
    got = deltas.run_failures(spark.createDataFrame(runs, "id string, stdout string, stderr string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "z.test.ts > n"), ("d", "x")]


def test_innermost_against_all_pairs(spark):
    rng = random.Random(6)
    spans = [(f"c{rng.randrange(4)}", "x", a := rng.randrange(60), a + rng.choice((0, 1, 5, 40))) for _ in range(150)]
    points = [(f"c{c}", "x", n) for c in range(5) for n in range(70)]
    got = at.innermost(spark.createDataFrame(points + points[:9], "change_id string, path string, line int"), spark.createDataFrame(spans, "change_id string, path string, istart int, iend int"))
    want = {(c, p, n): max((s for k, _, s, e in spans if k == c and s <= n <= e), default=None) for c, p, n in points}
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in want.items() if v is not None)


def test_attribution_of_one_large_file(spark):
    """Rows grow with lines and runs, not with their product."""
    n = 100_000
    changed = spark.range(n).select(F.lit("c").alias("change_id"), F.lit(0).alias("file_ord"), F.lit("x").alias("path"), (F.col("id") + 1).cast("int").alias("pos"), (F.col("id") + 1).cast("int").alias("line"))
    runs = spark.range(n // 3).select(F.lit("c").alias("change_id"), F.lit("x").alias("path"), (3 * F.col("id") + 2).cast("int").alias("rfirst"), (3 * F.col("id") + 3).cast("int").alias("rlast"), (3 * F.col("id") + 1).cast("int").alias("owner"))
    mapped = spark.createDataFrame([("c", "x", None), ("d", "x", None)], "change_id string, path string, error string")
    df = at.attribute(changed, runs, mapped)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = F.when((F.col("line") % 3 != 1) & (F.col("line") <= n // 3 * 3), F.col("line") - (F.col("line") - 1) % 3)
    assert df.count() == n and df.filter(~F.col("owner").eqNullSafe(want)).count() == 0
    assert at.attribute(changed.limit(5), runs, mapped.filter("change_id = 'd'")).filter("owner <> -1").count() == 0


def test_containment_as_the_file_system_has_it(spark, tmp_path):
    """Random trees of folders, files and links of every kind, resolved by the file system too."""
    rng, rows, links, exists, want = random.Random(11), [], [], [], {}

    def kept(df, what):
        path = str(tmp_path / "kept" / f"{len(list((tmp_path / 'kept').glob('*'))) if (tmp_path / 'kept').exists() else 0}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    for k in range(6):
        top = tmp_path / f"t{k}"
        root = top / "repo"
        for d in ("repo/a/b", "repo/c", "out/d"):
            (top / d).mkdir(parents=True)
        for f in ("repo/a/f", "repo/a/b/g", "out/d/h", "repo/i"):
            (top / f).write_text("x")
        targets = ["a", "../out", "c/..", "b", "l0", "l1/../i", str(root / "a"), str(top / "out/d"), "gone", "l2/b", ".", "/", "l4"]
        for n in range(6):
            folder = rng.choice(("", "a/", "c/"))
            place = root / f"{folder}l{n}"
            place.symlink_to(rng.choice(targets))
            links.append((f"t{k}", str(place), os.readlink(place)))
        (root / "loop").symlink_to("loop")
        links.append((f"t{k}", str(root / "loop"), "loop"))
        exists += [(f"t{k}", str(p), p.is_dir()) for p in [*top.rglob("*"), top, *top.parents] if not p.is_symlink() and str(p) == os.path.realpath(p)]
        for _ in range(40):
            rel = "/".join(rng.choice(("a", "b", "c", "f", "g", "i", "..", ".", "d", "h", "new", "loop", *(f"l{n}" for n in range(6)))) for _ in range(rng.randint(1, 5)))
            at_ = os.path.normpath(os.path.join(root, rel))
            own = None
            while True:
                try:
                    real = os.path.realpath(at_, strict=True)
                    own = real if own is None and at_ == os.path.normpath(os.path.join(root, rel)) else own
                    break
                except OSError:
                    at_ = os.path.dirname(at_)
            rows.append((f"t{k}", rel))
            want[f"t{k}", rel] = (own, real == str(root) or real.startswith(f"{root}/"))
    roots = spark.createDataFrame([(f"t{k}", str(tmp_path / f"t{k}" / "repo")) for k in range(6)], "tree string, root string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = containment.contained(frame(rows, "tree string, rel string"), roots, frame(links, "tree string, path string, target string"), frame(exists, "tree string, path string, folder boolean"), kept)
    # what lies outside the folders made here isn't in the table, so only its being outside counts
    near = lambda real: real if real is None or real.startswith(str(tmp_path)) else None
    assert {(r.tree, r.rel): (near(r.real), r.inside) for r in got.collect()} == {k: (near(v[0]), v[1]) for k, v in want.items()}
    assert len({v for _, v in want.values()}) == 2


def test_modules_stand_for_files(spark):
    files = ["src/a.ts", "src/b/index.ts", "src/c.d.ts", "src/c/index.ts", "lib/d.tsx", "node_modules/e/package.json", "src/node_modules/f/index.d.ts", "pkg/__init__.py", "pkg/m.py", "top.py", "src/g.mts"]
    of = {
        ("src/x.ts", "./a"): "src/a.ts", ("src/x.ts", "./a.js"): "src/a.ts", ("src/x.ts", "./b"): "src/b/index.ts", ("src/x.ts", "./c"): "src/c.d.ts", ("src/x.ts", "../lib/./d"): "lib/d.tsx", ("src/x.ts", "./d"): None, ("src/x.ts", "./b.js"): None,
        ("src/x.ts", "e"): "node_modules/e/package.json", ("src/deep/y.ts", "f"): "src/node_modules/f/index.d.ts", ("x.ts", "f"): None, ("src/x.ts", "node:fs"): "-", ("src/x.ts", "fs"): "-", ("src/x.ts", "./g.mjs"): "src/g.mts",
        ("src/p.py", "pkg"): "pkg/__init__.py", ("src/p.py", "pkg.m"): "pkg/m.py", ("src/p.py", "top"): "top.py", ("src/p.py", "os.path"): "-", ("src/p.py", "gone"): None, ("src/p.py", "fs"): None,
    }
    imports = spark.createDataFrame([("c", *k) for k in of], "id string, path string, module string")
    tree = spark.createDataFrame([("c", f) for f in files], "id string, path string")
    builtins = spark.createDataFrame([("", "fs"), (".py", "os")], "suffix string, name string")
    found = {(r.path, r.module): r.found for r in resolution.resolve(imports, tree, ["id"]).collect()}
    assert {k: v for k, v in found.items() if of[k] != "-"} == {k: v for k, v in of.items() if v != "-"}
    assert {(r.path, r.module) for r in resolution.unresolved(imports, tree, builtins, ["id"]).collect()} == {k for k, v in of.items() if v is None}


def test_first_program_on_a_path(spark):
    good = "#!/usr/bin/python3"
    files = [("/a/t", True, True, good), ("/b/t", True, True, "#!/bin/sh"), ("/c/t", False, True, good), ("/d/t", True, False, good), ("/e/t", True, True, "#!/usr/bin/env python3.11\r"), ("/f/t", True, True, "#!/usr/bin/python3 -s"), ("/g/t", True, True, "#!python"), ("/h/t", True, True, None)]
    of = {"/a:/b": ("/a/t", "/usr/bin/python3"), "/b:/a": None, "/c:/d/:/a/": ("/a/t", "/usr/bin/python3"), ":/a": None, "/a:": ("/a/t", "/usr/bin/python3"), "x:/a": None, "/z": None, "/e": ("/e/t", "python3.11"), "/f": None, "/g": None, "/h:/a": None, "": None}
    commands = spark.createDataFrame([(k, "t", k) for k in of] + [("slash", "./t", "/a")], "id string, name string, search string")
    got = resolution.first_on_path(commands, spark.createDataFrame(files, "path string, executable boolean, is_file boolean, first_line string"))
    assert {r.id: (r.script, r.interpreter) for r in got.collect()} == {k: v or (None, None) for k, v in of.items()} | {"slash": (None, None)}


def test_walk_is_known_if_nothing_follows(spark):
    trees = {
        "exact": ["a/test_1.py", "b_test.py", "x.txt", "test_2.py"], "more": ["test_1.py", "test_2.py", "x.txt", "y/test_3.py"], "few": ["test_1.py", ".git/test_2.py", "x/build/test_3.py"],
        "hidden": ["test_1.py", "test_2.py", ".z/test_0.py"], "late": ["test_1.py", "test_2.py", "venv/test_0.py"], "deep": ["a/b/test_1.py", "a/test_2.py", "a.txt"], "deeper": ["a/b/test_1.py", "a/test_2.py", "a/b/z"],
    }
    tree = spark.createDataFrame([(k, p, "file") for k, ps in trees.items() for p in ps], "change_id string, path string, kind string")
    got = {r.change_id: r.tests for r in intake.walked_tests(tree, 2).collect()}
    assert got == {"exact": None, "more": None, "few": ["test_1.py"], "hidden": ["test_1.py", "test_2.py"], "late": None, "deep": None, "deeper": ["a/b/test_1.py", "a/test_2.py"]}
    assert {r.change_id: r.tests for r in intake.walked_tests(tree, 3).collect()}["exact"] is None
    assert {r.change_id: r.tests for r in intake.walked_tests(tree.filter("path <> 'x.txt'"), 3).collect()}["exact"] == ["a/test_1.py", "b_test.py", "test_2.py"]


def test_costly_checks_are_read_for_safe_changes_only(spark, sf_dir):
    """The filter stands below the aggregations of both scans, and verdicts are those without it."""
    from plumbline.plans import catalogue

    df = catalogue.gated_checks(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") >= 2
    gates = catalogue._gates(spark, sf_dir)
    never = gates.filter(~(fusion.would_be_safe()))
    assert never.count() > 0
    one = lambda n: fusion.fuse(fusion.masked_gates(never.withColumns({"survivors": F.lit(n).cast("long"), "varied": F.lit(n).cast("long")}))).select("o_orderkey", "verdict", "reason_code")
    assert one(0).exceptAll(one(3)).count() == 0


def test_unreadable_coverage_is_reported(spark):
    df = spark.createDataFrame([("a", '{"files": {"x.py": {"executed_lines": [1], "missing_lines": [2], "excluded_lines": [], "missing_branches": [[1, -2]]}}}'), ("b", "{oops"), ("c", "{}")], "change_id string, json string")
    lines, arcs, bad, damaged = evidence.coverage_sets(df)
    assert damaged.count() == 0
    assert sorted(map(tuple, lines.collect())) == [("a", "x.py", 1, "executed"), ("a", "x.py", 2, "missing")]
    assert [tuple(r) for r in arcs.collect()] == [("a", "x.py", 1, -2)]
    assert sorted(r[0] for r in bad.collect()) == ["b", "c"]


BASES = "change_id string, path string, utf8 boolean, content string"


def refusals(spark, raw, bases=()):
    base = spark.createDataFrame(list(bases), BASES)
    e = diffs.entries(diffs.diff_lines(raw))
    flags, hunks = diffs.entry_flags(e), diffs.hunks(e)
    return {r.change_id: r.error_code for r in diffs.refusal(raw, flags, hunks, diffs.entry_errors(flags, hunks, base, placement.placed(hunks, base))).collect()}


def test_diff_without_edits_and_new_files(spark):
    raw = spark.createDataFrame([("a", ""), ("b", "diff --git a/x b/x\nnew file mode 100644\n--- /dev/null\n+++ b/x\n@@ -0,0 +1,1 @@\n+one\n")], "change_id string, text string")
    assert refusals(spark, raw, [("b", "x", True, "there\n")]) == {"a": "NO_EDITS", "b": "ZERO_CONTEXT"}
    assert refusals(spark, raw, [("b", "x", True, "")]) == refusals(spark, raw) == {"a": "NO_EDITS", "b": None}
    assert [tuple(r) for r in diffs.new_lines(diffs.entries(diffs.diff_lines(raw))).collect()] == [("b", "x", 1)]


def test_plain_diffs(spark):
    """Without `diff` lines pairs of --- and +++ open entries; what hunks count is content, whatever it looks like."""
    hunk = "@@ -1 +1 @@\n-a\n+b\n"
    text = {
        "plain": f"--- a/x.py\n+++ b/x.py\n{hunk}",
        "bare": f"--- x.py\n+++ x.py\n{hunk}",
        "timed": f"--- a/x.py\t2024-01-01\r\n+++ b/x.py\t2024-01-02\r\n{hunk}",
        "gone": "--- a/x.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n",
        "two": f"--- a/x.py\n+++ b/x.py\n{hunk}--- a/y.py\n+++ b/y.py\n{hunk}",
        "under one": f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n{hunk}--- a/y.py\n+++ b/y.py\n{hunk}",
        "content": "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n--- a/q\n+++ b/q\n c\n",
        "no prefix": f"diff --git x.py x.py\n--- x.py\n+++ x.py\n{hunk}",
        "half": f'diff --git a/x.py "b/x.py"\n--- a/x.py\n+++ "b/x.py"\n{hunk}',
        "blank": "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n\n+b\n",
        "short": "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,1 @@\n a\n",
        "trailer": f"--- a/x.py\n+++ b/x.py\n{hunk}-- \n2.40.0\n",
    }
    raw = spark.createDataFrame(list(text.items()), "change_id string, text string")
    e = diffs.entries(diffs.diff_lines(raw))
    paths_of, lines_of = {}, {}
    for r in diffs.entry_flags(e).collect():
        paths_of.setdefault(r.change_id, set()).add((r.path, r.deleted))
    for r in diffs.new_lines(e).collect():
        lines_of.setdefault(r.change_id, []).append((r.path, r.line))
    two = {("x.py", False), ("y.py", False)}
    assert paths_of == {k: {("x.py", k == "gone")} for k in text} | {"two": two, "under one": two}
    both = [("x.py", 1), ("y.py", 1)]
    assert {k: sorted(v) for k, v in lines_of.items()} == {k: [("x.py", 1)] for k in text if k not in ("gone", "short")} | {"two": both, "under one": both, "blank": [("x.py", 3)]}
    base = [(k, p, True, "-- a/q\nc\n" if k == "content" else "a\n\n" if k == "blank" else "a\n") for k in text for p in ("x.py", "y.py")]
    assert refusals(spark, raw, base) == {k: {"gone": "DELETE", "short": "MALFORMED"}.get(k) for k in text}


def test_hunks_are_placed_like_a_loop(spark):
    """Random bases of few different lines, so that places are often several."""
    rng = random.Random(8)
    raw, base, want = [], [], {}
    for c in range(120):
        lines = [rng.choice("abc") if rng.random() < 0.6 else f"l{rng.randrange(30)}" for _ in range(rng.randint(1, 25))]
        text, done, good, at = "--- a/x\n+++ b/x\n", 0, True, 0
        for _ in range(rng.randint(1, 3)):
            at = min(at + rng.randint(0, 6), len(lines) - 1)
            old = lines[at : at + rng.randint(1, 3)]
            if rng.random() < 0.1:
                old = [*old[:-1], "gone"]
            stated = max(1, at + 1 + rng.choice((0, 0, 0, 1, -2)))
            text += f"@@ -{stated},{len(old)} +{stated},{len(old) + 1} @@\n" + "".join(f"-{x}\n" for x in old) + "+n\n" * (len(old) + 1)
            spots = [k for k in range(done, len(lines) - len(old) + 1) if lines[k : k + len(old)] == old]
            spot = stated - 1 if stated - 1 in spots else spots[0] if len(spots) == 1 else None
            good = good and spot is not None
            done = spot + len(old) if good else done
            at += len(old)
        raw.append((f"c{c}", text))
        base.append((f"c{c}", "x", True, "\n".join(lines) + "\n"))
        want[f"c{c}"] = None if good else "NOT_APPLIED"
    assert refusals(spark, spark.createDataFrame(raw, "change_id string, text string"), base) == want
    assert {None, "NOT_APPLIED"} == set(want.values())


def test_applied_like_one_after_the_other(spark):
    """Random edits of random files, with and without a newline at the end, against a plain application of each hunk."""
    from plumbline.functions import patches

    rng, raw, base, want = random.Random(3), [], [], {}
    for c in range(60):
        lines = [f"l{rng.randrange(1000)}" for _ in range(rng.randint(0, 20))]
        text, at, patch = "\n".join(lines) + (rng.choice(("", "\n")) if lines else ""), 0, ""
        absent = c % 9 == 0
        if absent:
            patch = "@@ -0,0 +1,2 @@\n+a\n+b\n" + ("\\ No newline at end of file\n" if c % 2 else "")
        while not absent and at < len(lines):
            at = min(at + rng.randint(0, 5), len(lines) - 1)
            old = lines[at : at + rng.randint(1, 3)]
            new = [f"n{rng.randrange(1000)}" for _ in range(rng.randint(0, 3))]
            patch += f"@@ -{at + 1},{len(old)} +{at + 1},{len(new)} @@\n" + "".join(f"-{x}\n" for x in old) + "".join(f"+{x}\n" for x in new)
            if at + len(old) == len(lines) and new and rng.random() < 0.5:
                patch += "\\ No newline at end of file\n"
            at += len(old) + 1
        if patch:
            raw.append((f"c{c}", f"--- a/x\n+++ b/x\n{patch}"))
            base += [] if absent else [(f"c{c}", "x", True, text)]
            want[f"c{c}"] = patches.apply(None if absent else text, patch)
    hunks = diffs.hunks(diffs.entries(diffs.diff_lines(spark.createDataFrame(raw, "change_id string, text string"))))
    files = spark.createDataFrame(base, BASES)
    assert {r.change_id: r.new_content for r in placement.applied(hunks, files, placement.placed(hunks, files)).collect()} == want


LINKED = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-Subproject commit 1111111\n+Subproject commit 2222222\n"


def test_submodules_are_not_applied_to_files(spark):
    """A file may hold the commit line of a submodule's entry; only without the gitlink's mode is it that file's."""
    raw = [("link", f"diff --git a/x b/x\nindex 1111111..2222222 160000\n{LINKED}"), ("file", f"diff --git a/x b/x\nindex 1111111..2222222 100644\n{LINKED}")]
    hunks = diffs.hunks(diffs.entries(diffs.diff_lines(spark.createDataFrame(raw, "change_id string, text string"))))
    files = spark.createDataFrame([(k, "x", True, "a\nSubproject commit 1111111\nb\n") for k, _ in raw], BASES)
    made = placement.applied(hunks, files, placement.placed(hunks, files))
    assert [(r.change_id, r.new_content) for r in made.collect()] == [("file", "a\nSubproject commit 2222222\nb\n")]


def test_submodules_have_no_place(spark):
    """Neither at the stated line nor at the one other, also where the commit is new and takes no line away."""
    head = "diff --git a/x b/x\n--- a/x\n+++ b/x\n"
    mode = "index 1111111..2222222 160000\n"
    new = "diff --git a/x b/x\nnew file mode 160000\n--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+Subproject commit 2222222\n"
    raw = [("stated", head.replace("---", mode + "---") + LINKED[LINKED.index("@@") :].replace("-1 +1", "-2 +2")), ("other", head.replace("---", mode + "---") + LINKED[LINKED.index("@@") :]), ("new", new), ("file", LINKED)]
    hunks = diffs.hunks(diffs.entries(diffs.diff_lines(spark.createDataFrame(raw, "change_id string, text string"))))
    files = spark.createDataFrame([(k, "x", True, "a\nSubproject commit 1111111\nb\n") for k, _ in raw if k != "new"], BASES)
    got = {r.change_id: (r.applies, r.at_lines) for r in placement.placed(hunks, files).collect()}
    assert got == {"stated": (False, [None]), "other": (False, [None]), "new": (False, [None]), "file": (True, [1])}


def test_submodules_are_not_applied_where_no_hunk_counts_their_commit(spark):
    """A hunk before the commit's line has its place, but the entry is the submodule's and makes no file."""
    head = "index 1111111..2222222 160000\n--- a/x\n+++ b/x\n@@ -2 +2 @@\n-b\n+c\n"
    stray = "+Subproject commit 2222222\n"
    raw = [("link", f"diff --git a/x b/x\n{head}{stray}"), ("file", f"diff --git a/x b/x\n{head.replace('160000', '100644')}{stray}"), ("none", f"diff --git a/x b/x\n{head}")]
    hunks = diffs.hunks(diffs.entries(diffs.diff_lines(spark.createDataFrame(raw, "change_id string, text string"))))
    files = spark.createDataFrame([(k, "x", True, "a\nb\n") for k, _ in raw], BASES)
    found = placement.placed(hunks, files)
    assert {r.change_id: (r.applies, r.at_lines) for r in found.collect()} == {"link": (False, [1]), "file": (True, [1]), "none": (True, [1])}
    assert {r.change_id: r.new_content for r in placement.applied(hunks, files, found).collect()} == {"file": "a\nc\n", "none": "a\nc\n"}


@pytest.mark.parametrize("name", ["hunk_places", "applied_edits", "diff_entry_flags", "diff_refusal", "hunk_new_lines", "diff_files"])
def test_diffs_of_null_texts(spark, tmp_path, name):
    """Null texts of every kind and form of entry among others, against the SQL."""
    from compare import connect, rows_of_duckdb, rows_of_spark

    from plumbline.plans import catalogue, oracles

    ids = sorted({n for m in (89, 97, 101, 103, 107, 109, 113) for k in range(10) for n in range(m * k // 4 * 4, m * k // 4 * 4 + 4)})
    docs = [(n, None if any(n % m == 0 for m in (89, 97, 101, 103, 107, 109, 113)) or n % 3 == 0 else f"a\nb{n}\nc\n") for n in ids]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = rows_of_duckdb(connect(tmp_path), oracles.SQL[name])
    assert rows_of_spark(catalogue.QUERIES[name](spark, str(tmp_path))) == want


def test_bases_that_are_not_text(spark):
    raw = spark.createDataFrame([("a", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n")], "change_id string, text string")
    assert refusals(spark, raw, [("a", "x", False, None)]) == {"a": "NOT_UTF8"}
    assert refusals(spark, raw) == {"a": "NOT_APPLIED"}  # lines can't be taken from a file that isn't there


def test_diff_and_base_files(spark, tmp_path):
    """A tree and large diff files, read in many pieces, to refusals."""
    (tmp_path / "tree" / "pkg").mkdir(parents=True)
    (tmp_path / "tree" / "pkg" / "a.py").write_bytes("\ufeffone\ntwo\n".encode())
    (tmp_path / "tree" / "b.py").write_bytes(b"caf\xe9\n")
    (tmp_path / "tree" / "c.py").write_bytes(b"diff --git\n\nlast")
    (tmp_path / "diffs").mkdir()
    entry = lambda p, old, new: f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n-{old}\n+{new}\n"
    many = "".join(entry(f"new{k}.py", "x", "y").replace("@@ -1 +1 @@\n-x", "@@ -0,0 +1 @@").replace(f"--- a/new{k}.py", "--- /dev/null") for k in range(300))
    texts = {"good": "From 1\n\n" + many + entry("pkg/a.py", "\ufeffone", "1"), "latin": entry("c.py", "diff --git", "x") + entry("b.py", "e", "f") + many, "stale": many + entry("pkg/a.py", "one", "1"), "plain": "--- a/c.py\n+++ b/c.py\n@@ -2,2 +2,3 @@\n\n-last\n+last\n+more\n"}
    for k, t in texts.items():
        (tmp_path / "diffs" / k).write_text(t)
    tree = evidence.base_files(spark, f"file://{tmp_path}/tree")
    assert {(r.path, r.utf8, r.content) for r in tree.collect()} == {("pkg/a.py", True, "\ufeffone\ntwo\n"), ("b.py", False, None), ("c.py", True, "diff --git\n\nlast")}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = evidence.diff_files(spark, f"file://{tmp_path}/diffs").withColumn("change_id", F.substring_index("change_id", "/", -1))
        assert raw.rdd.getNumPartitions() > 10 and raw.count() == 906
        e = diffs.entries(diffs.diff_lines(raw))
        flags, hunks = diffs.entry_flags(e), diffs.hunks(e)
        base = spark.createDataFrame([(k,) for k in texts], "change_id string").join(tree)
        got = diffs.refusal(raw, flags, hunks, diffs.entry_errors(flags, hunks, base, placement.placed(hunks, base)))
        assert {r.change_id: r.error_code for r in got.collect()} == {"good": None, "latin": "NOT_UTF8", "stale": "NOT_APPLIED", "plain": None}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_lines_of_a_diff_are_sorted_once(spark, tmp_path):
    """All windows share one order, also where pieces are read from files; so a task holds its lines once."""
    (tmp_path / "d").write_text(LINKED)
    for raw in (spark.createDataFrame([("a", LINKED)], "change_id string, text string"), evidence.diff_files(spark, f"file://{tmp_path}/d")):
        plan = diffs.new_lines(diffs.entries(diffs.diff_lines(raw)))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"(?m)^[^\w]*Sort \[", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) <= 2


def test_added_lines_need_no_window_of_their_own(spark, sf_dir):
    """A line's number in the new file comes with its entry, so the query has one sort, that of the lines."""
    from plumbline.plans import catalogue

    plan = catalogue.hunk_new_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^[^\w]*Sort \[.*\bn#", plan)) == 1


def test_entries_after_hunks(spark):
    """Running values end with the hunk or entry that they are of: counts, names, gitlink modes and numbers of hunks."""
    text = (
        "@@ -1 +1 @@\n-a\n+b\n"  # of no entry
        "diff --git a/l b/l\nindex 1111111..2222222 160000\n@@ -1 +1 @@\n-Subproject commit 1111111\n+Subproject commit 2222222\n"
        "diff --git a/y b/y\n@@ -1 +5 @@\n-Subproject commit 1111111\n+Subproject commit 2222222\nno body\n+nor this\n@@ -9,2 +14,3 @@\n a\n+c\n b\n"
        "--- a/z\n+++ b/z\n@@ -1 +1 @@\n-a\n+d\n"
    )
    e = diffs.entries(diffs.diff_lines(spark.createDataFrame([("a", text)], "change_id string, text string")))
    assert sorted((r.path, r.line) for r in diffs.new_lines(e).collect()) == [("l", 1), ("y", 5), ("y", 15), ("z", 1)]
    assert sorted((r.path, r.submodule, r.has_hunks) for r in diffs.entry_flags(e).collect()) == [("l", True, True), ("y", False, True), ("z", False, True)]
    assert sorted((r.path, r.h, r.old_start, r.replaced, r.malformed) for r in diffs.hunks(e).collect()) == [
        ("l", 1, 1, ["Subproject commit 1111111"], False), ("y", 1, 1, ["Subproject commit 1111111"], False), ("y", 2, 9, ["a", "b"], False), ("z", 1, 1, ["a"], False),
    ]


def test_diff_entries_of_every_form(spark):
    text = {
        "quoted": ('diff --git "a/x\\303 y" "b/x\\303 y"\n--- "a/x\\303 y"\n+++ "b/x\\303 y"\n@@ -1,1 +1,1 @@\n-a\n+b\n', "x\\303 y", set()),
        "spaces": ("diff --git a/p b/q r b/p b/q r\nindex 1..2 100644\n", "p b/q r", set()),
        "content": ("diff --git a/x b/x\n@@ -1,1 +1,1 @@\n-Subproject commit 1111111\n+Subproject commit 2222222\n", "x", set()),
        "link": ("diff --git a/x b/x\nindex 1111111..2222222 160000\n@@ -1 +1 @@\n-Subproject commit 1111111\n+Subproject commit 2222222\n", "x", {"submodule"}),
        "mode": ("diff --git a/x b/x\nindex 1111111..2222222 160000\n", "x", set()),
        "half": ("diff --git a/x b/x\nrename from y\n", "x", set()),
        "moved": ("diff --git a/y b/x\nrename from y\nrename to x\n", "x", {"renamed"}),
        "names": ("diff --git a/y b/x\n--- a/y\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", "x", {"renamed"}),
        "copy": ("diff --git a/y b/x\ncopy from y\ncopy to x\n--- a/y\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", "x", {"copied"}),
        "gone": ("diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n", "x", {"deleted"}),
        "removed": ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,1 @@\n--- a/q\n a\n", "x", set()),
    }
    raw = spark.createDataFrame([(k, v[0]) for k, v in text.items()], "change_id string, text string")
    rows = diffs.entry_flags(diffs.entries(diffs.diff_lines(raw))).collect()
    flags = ("deleted", "renamed", "copied", "submodule", "is_binary")
    assert {r.change_id: (r.path, {f for f in flags if r[f]}) for r in rows} == {k: v[1:] for k, v in text.items()}


def test_extents_of_copies(spark):
    """Every copy has the rows of its text, from one reading of each text: the shuffle stands before Python."""
    texts = ("a = 1 + 2\nif a < 3:\n    b = ''\n", "def g(:\n", "")
    files = [(f"m{k}.py", texts[k % 3]) for k in range(60)]
    df = perfile.extents(spark.createDataFrame(files, "path string, source string"))
    want = [(p, *r) for p, t in files for r in ([(None, None, None, "SyntaxError")] if "(:" in t else [(*x, None) for x in sources.statement_runs(t)])]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) == 20 * 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInPandas.*?HashAggregate\(keys=\[source", plan, re.S)


def test_mutants_of_copies(spark):
    texts = ("a = 1 + 2\nif a < 3:\n    b = ''\n", "def g(:\n", "")
    files = [(f"m{k}.py", texts[k % 3]) for k in range(60)]
    df = perfile.mutants(spark.createDataFrame(files, "path string, source string"))
    want = [(p, *m) for p, t in files for m in sources.mutants(t, {1, 2, 3})]
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 20 * 6
    assert re.search(r"MapInPandas.*?HashAggregate\(keys=\[source", df._jdf.queryExecution().executedPlan().toString(), re.S)


def test_stream_gives_the_batch_verdicts(spark, tmp_path):
    rows = [(k, *{**DEFAULT, **c[0]}.values()) for k, c in enumerate(FUSION)]
    schema = "id int, " + fusion.NEEDS
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fuse_stream(stream, lambda df, n: got.update({r.id: r.verdict for r in df.collect()}), str(tmp_path / "ck")).awaitTermination()
    assert [got[k] for k in range(len(FUSION))] == [c[1] for c in FUSION]
