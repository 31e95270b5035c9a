"""Plain functions: case tables, and random cases against independent models."""

import ast
import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import commands as cmd
from plumbline.functions import patches
from plumbline.functions import sources as src

SCOPES = [
    ("python3 -m pytest -q", "full"),
    ("pytest", "full"),
    ("pytest .", "full"),
    ("pytest -qx", "full"),
    ("pytest --cov src", "full"),
    ("pytest --cov --collect-only", "narrowed"),
    ("pytest -n 4 --durations=5", "full"),
    ("pytest tests/", "narrowed"),
    ("pytest -k 'not slow'", "narrowed"),
    ("pytest -m slow", "narrowed"),
    ("python3 -m pytest -m slow", "narrowed"),
    ("pytest -o testpaths=a", "narrowed"),
    ("pytest -o log_cli=true", "full"),
    ("pytest --doctest-modules", "unknown"),
    ("pytest --weird x -k a", "narrowed"),
    ("pytest -- tests/a.py", "narrowed"),
    ("pytest --", "full"),
    ('pytest ""', "full"),
    ("pytest -q #nightly", "full"),
    ("pytest -q > out", "unknown"),
    ("cd a && pytest", "unknown"),
    ("make test", "unknown"),
    ("", "unknown"),
    ("PYTHONPATH=. pytest", "full"),
    ("PYTEST_ADDOPTS='-k a' pytest -q", "narrowed"),
    ("PYTEST_ADDOPTS='-q' pytest", "full"),
    ("env PYTEST_ADDOPTS=-x A=1 pytest", "full"),
    ("poetry run pytest tests/a.py", "narrowed"),
    ("poetry install", "unknown"),
    ("npx -y vitest run", "full"),
    ("npx -p vitest vitest run src/a.ts", "narrowed"),
    ("pnpm exec jest --ci", "full"),
    ("vitest run -w src/a.test.ts", "narrowed"),
    ("vitest list", "narrowed"),
    ("jest --findRelatedTests a.js", "narrowed"),
    ("python3 -m unittest", "full"),
    ("python3 -m unittest discover -s tests", "full"),
    ("python3 -m unittest discover -s tests/unit", "narrowed"),
    ("python3 -m unittest discover -p 'a*.py'", "narrowed"),
    ("python3 -m unittest tests.a", "narrowed"),
    ("python3 tests/run.py", "unknown"),
    ("python3 tests/run.py a", "narrowed"),
    ("python3 tests/run.py --parallel 4", "unknown"),
]


@pytest.mark.parametrize(("command", "scope"), SCOPES)
def test_scope(command, scope):
    assert cmd.classify(command)[0] == scope


def test_scope_of_run():
    assert cmd.assess(None) == ("full", "detected", [])
    assert cmd.assess("  ", {}, "python3 -m pytest -q")[:2] == ("full", "detected")
    assert cmd.assess("pytest", {"PYTEST_ADDOPTS": "-k a"})[0] == "narrowed"
    assert cmd.assess("vitest run", {"PYTEST_ADDOPTS": "-k a"})[0] == "full"
    assert cmd.assess(None, {"JEST_ADDOPTS": "-k a"})[0] in ("full", "narrowed")


CONFIGS = [
    ("[pytest]\naddopts = -q --strict-markers\n", ["tests/test_a.py"], "full"),
    ("[pytest]\naddopts =\n    -q\n    -k slow\n", ["tests/test_a.py"], "narrowed"),
    ("[other]\naddopts = -k a\n", ["tests/test_a.py"], "full"),
    ("[pytest]\nx = 1\n[tool]\naddopts = -k a\n", ["tests/test_a.py"], "full"),
    ("[pytest]\ntestpaths = tests\n", ["tests/test_a.py"], "full"),
    ("[pytest]\ntestpaths = tests\n", ["tests_extra/test_a.py"], "narrowed"),
    ("[pytest]\ntestpaths = tests\n", None, "narrowed"),
    ("[pytest]\ntestpaths = tests\n", [], "narrowed"),
    ("[pytest]\ntestpaths = .\n", None, "full"),
    ("[pytest]\ntestpaths = tests\npython_files = check_*.py\n", ["tests/test_a.py"], "narrowed"),
    ("[pytest]\naddopts = '-k\n", ["tests/test_a.py"], "narrowed"),
]


@pytest.mark.parametrize(("content", "tests", "scope"), CONFIGS)
def test_scope_from_configuration(content, tests, scope):
    assert cmd.assess("pytest", {}, None, [("pytest.ini", content)], tests)[0] == scope


def test_toml_configuration():
    toml = '[tool.pytest.ini_options]\naddopts = [\n  "-q",\n  "-k", "a",\n]\n'
    assert cmd.assess("pytest", {}, None, [("pyproject.toml", toml)], ["t"])[0] == "narrowed"


PLANS = [
    ("python3 -m pytest -q", (["-m", "pytest", "-q"], {})),
    ("python3 tests/run.py a", (["tests/run.py", "a"], {})),
    ("PYTHONPATH=. python3 -m pytest -k 'not slow'", (["-m", "pytest", "-k", "not slow"], {"PYTHONPATH": "."})),
    ("pytest -q", None),
    ("PYTHONPATH=$HOME pytest", None),
    ("A=b:~/x python3 -m pytest", None),
    ("pytest && x", None),
    ("A=1", None),
    ("python3 -m", None),
    ("", None),
]


@pytest.mark.parametrize(("command", "plan"), PLANS)
def test_coverage_plan(command, plan):
    assert cmd.coverage_plan(command) == plan


def test_coverage_plan_resolved():
    assert cmd.coverage_plan("pytest -q", ("/bin/pytest", None)) == (["/bin/pytest", "-q"], {})


EXTENTS = [
    ("x = 1\n\n# c\ny = 2\n", [(1, 1, 1), (4, 4, 4)]),
    ("f(\n  1,\n  # c\n  2)\n", [(1, 2, 1), (4, 4, 1)]),
    ("def f():\n    '''a\n\n    b'''\n    return 1\n", [(1, 1, 1), (2, 4, 2), (5, 5, 5)]),
    ("if False:\n    x = 1\n", [(1, 1, 1), (2, 2, 2)]),
    ("try:\n    a\nexcept E:\n    b\nfinally:\n    c\n", [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (5, 5, 1), (6, 6, 6)]),
    ("@d\n@e\ndef f():\n    pass\n", [(1, 3, 1), (4, 4, 4)]),
    ("match x:\n    case 1 if (\n        y):\n        z\n", [(1, 1, 1), (2, 3, 2), (4, 4, 4)]),
    ("", []),
]


@pytest.mark.parametrize(("source", "runs"), EXTENTS)
def test_statement_runs(source, runs):
    assert src.statement_runs(source) == runs


def test_unreadable_source_is_loud():
    with pytest.raises(src.FAILURES):
        src.statement_runs("def f(:\n")
    assert src.syntax_error("def f(:\n") and src.syntax_error("x = 1\n") is None


def test_imports():
    s = "import a, b.c\nfrom d import e\nfrom . import f\nif TYPE_CHECKING:\n    import g\nelse:\n    import h\nif x and t.TYPE_CHECKING:\n    import i\nif x or TYPE_CHECKING:\n    import j\n"
    assert src.imports(s) == ["a", "b.c", "d", "h", "j"]
    assert src.imports("def f(:\n") == []


def test_mutants():
    s = 'def f(a):\n    """doc"""\n    if a < 1 and True:\n        return "x" + ""\n    5\n    return 0 // 2\n'
    got = [(m[0], m[3], m[4], m[6]) for m in src.mutants(s, set(range(1, 9)))]
    assert got == [
        (3, "<", "<=", "operator"), (3, "1", "0", "constant"), (3, "and", "or", "operator"), (3, "True", "False", "constant"),
        (4, '"x"', '""', "constant"), (4, "+", "-", "operator"), (4, '""', '"__mut__"', "constant"),
        (6, "0", "1", "constant"), (6, "//", "/", "operator"), (6, "2", "0", "constant"),
    ]
    assert src.mutants(s, {5}) == [] and src.mutants("x = (", {1}) == []


def test_apply():
    base = "a\nb\nc\n"
    assert patches.apply(base, "@@ -2,1 +2,2 @@\n-b\n+B\n+bb\n") == "a\nB\nbb\nc\n"
    assert patches.apply("x\n" + base, "@@ -1,2 +1,2 @@\n a\n-b\n+B\n") == "x\na\nB\nc\n"
    assert patches.apply(None, "@@ -0,0 +1,2 @@\n+a\n+b\n") == "a\nb\n"
    assert patches.apply("a\nb", "@@ -2,1 +2,1 @@\n-b\n\\ No newline at end of file\n+c\n") == "a\nc\n"
    assert patches.apply("a\nb\n", "@@ -2,1 +2,1 @@\n-b\n+c\n\\ No newline at end of file\n") == "a\nc"
    with pytest.raises(patches.Refused, match="NOT_APPLIED"):
        patches.apply(base, "@@ -1,1 +1,1 @@\n-z\n+y\n")
    with pytest.raises(patches.Refused, match="NOT_APPLIED"):
        patches.apply("q\na\na\n", "@@ -1,1 +1,1 @@\n-a\n+y\n")
    with pytest.raises(patches.Refused, match="ZERO_CONTEXT"):
        patches.apply(base, "@@ -1,0 +1,1 @@\n+y\n")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_added_lines_leave_a_longest_common_subsequence(a, b):
    got = patches.added_lines("".join(f"{x}\n" for x in a), "".join(f"{x}\n" for x in b))
    kept = [x for k, x in enumerate(b, 1) if k not in set(got)]
    it = iter(a)
    assert all(x in it for x in kept)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    assert len(kept) == best[-1][-1]


def test_added_lines_ends():
    assert patches.added_lines(None, "a\nb\n") == [1, 2]
    assert patches.added_lines("a\r\nb\r\n", "a\nb\n") == []
    assert patches.added_lines("a\nb", "a\nb\nc") == [3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["one", "two", "three", "four"]), min_size=1, max_size=15), st.randoms())
def test_apply_inverts_a_generated_diff(lines, rng):
    new = [x for line in lines for x in ([line] if rng.random() < 0.7 else [line.upper(), "added"])]
    patch = "\n".join(difflib.unified_diff(lines, new, lineterm="", n=30)) + "\n"
    if patch.strip():
        assert patches.apply("".join(f"{x}\n" for x in lines), patch) == "".join(f"{x}\n" for x in new)


def test_every_mutant_applies_to_its_source():
    s = "x = 1 + 2\nif x <= 3 or not x:\n    y = 'a'\n"
    lines = s.split("\n")
    for line, a, b, orig, repl, *_ in src.mutants(s, {1, 2, 3}):
        row = lines[line - 1]
        assert row[a:b] == orig
        ast.parse("\n".join([*lines[: line - 1], row[:a] + repl + row[b:], *lines[line:]]))


def test_command_words_random():
    rng = random.Random(3)
    for _ in range(300):
        words = ["".join(rng.choice("ab-=") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 5))]
        assert cmd.split_words(" ".join(f"'{w}'" for w in words)) == words


def test_added_lines_keep_little():
    """Of n steps a byte for each diagonal is kept, not the places that all diagonals reached."""
    import tracemalloc

    base, new = ("\n".join(f"{c}{k}" for k in range(300)) for c in "ab")
    tracemalloc.start()
    try:
        assert patches.added_lines(base, new) == list(range(1, 301))
        assert tracemalloc.get_traced_memory()[1] < 2 << 20
    finally:
        tracemalloc.stop()
