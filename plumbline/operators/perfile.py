"""Functions of one row's text over Arrow batches: commands, Python sources, patches.

Commands repeat, and so do the files of many changes: each distinct one is read once, and its facts are joined back. The
shuffle that finds the distinct ones also spreads them over all tasks, where a table of short rows is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import commands as cmd
from ..functions import patches
from ..functions import sources as src

#: Rows of a batch whose lines' numbers are held at once; texts are taken out of it one by one.
ROWS_AT_ONCE = 256
#: Rows of an Arrow batch: some megabytes of text, where Spark's default of 10,000 would be tens.
BATCH_ROWS = "1000"

#: Test commands by rule, for the queries.
COMMANDS = (
    "python3 -m pytest -q", "pytest tests/unit", "pytest -q --cov src", "PYTEST_ADDOPTS='-k a' pytest", "npx vitest run", "vitest run -w src/a.test.ts", "jest --ci", "poetry run pytest -x",
    "pytest -q && lint", "python3 tests/run.py", "python3 -m unittest discover -s tests", "python3 -m unittest discover -s tests/unit", "pytest --doctest-modules", "make test", "pytest -o testpaths=a", "env A=1 pytest .",
)
#: Python programs by rule; {n} is the row's number.
PROGRAMS = (
    'import os, json.decoder\n\n\ndef f(a, b):\n    """Doc."""\n    if a < b and a:\n        return a + {n}\n    return None\n',
    "from typing import TYPE_CHECKING\n\nif TYPE_CHECKING:\n    import gone{n}\nelse:\n    import sys\n\nx = (\n    1,\n    # note\n    2,\n)\n",
    "def g(:\n    return {n}\n",
    "try:\n    y = {n} == 0\nexcept ValueError:\n    y = ''\n\n\n@dec\nclass A:\n    z = 'text'\n    match z:\n        case 1 if z:\n            pass\n",
)


def _batched(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches are kept small where its user hasn't chosen their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def commands(rows: DataFrame) -> DataFrame:
    one = F.element_at(F.array(*[F.lit(x) for x in COMMANDS]), (F.col("p_partkey") % len(COMMANDS) + 1).cast("int"))
    return rows.select(F.col("p_partkey").alias("id"), one.alias("command"))


def programs(rows: DataFrame) -> DataFrame:
    one = F.element_at(F.array(*[F.lit(x) for x in PROGRAMS]), (F.col("p_partkey") % len(PROGRAMS) + 1).cast("int"))
    return rows.select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.replace(one, F.lit("{n}"), F.col("p_size").cast("string")).alias("source"))


def _by_distinct(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    found = df.select(key).distinct().mapInPandas(fn, schema)
    return df.join(found, key)


def _by_source(df: DataFrame, fn, schema: str) -> DataFrame:
    """path and the rows (of schema) that fn, from a source to tuples, finds in each. A source's rows travel as one list, and
    copies meet it by a digest of the text."""
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "_rows": [[dict(zip(names, r, strict=True)) for r in fn(x)] for x in b["source"]]})

    key = F.sha2("source", 256).alias("_key")
    found = _batched(df).select("source").distinct().select("source", key).mapInPandas(read, f"_key string, _rows array<struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', '))}>>")
    rows = df.select("path", key).join(found, "_key")
    return rows.select("path", F.explode("_rows").alias("_r")).select("path", "_r.*")


def _scope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [cmd.assess(c) for c in b["command"]]
        yield pd.DataFrame({"command": b["command"], "scope": [g[0] for g in got], "signals": ["; ".join(g[2]) for g in got]})


def scopes(df: DataFrame) -> DataFrame:
    return _by_distinct(df, "command", _scope, "command string, scope string, signals string")


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [cmd.coverage_plan(c) for c in b["command"]]
        yield pd.DataFrame({"command": b["command"], "args": [g and " ".join(g[0]) for g in got], "env": [g and ",".join(f"{k}={v}" for k, v in g[1].items()) for g in got]})


def plans(df: DataFrame) -> DataFrame:
    return _by_distinct(df, "command", _plan, "command string, args string, env string")


def _syntax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [src.syntax_error(s) for s in b["source"]]
        yield pd.DataFrame({"path": b["path"], "passed": [g is None for g in got], "reason": got})


def syntax(df: DataFrame) -> DataFrame:
    return _batched(df).mapInPandas(_syntax, "path string, passed boolean, reason string")


def _extents(source: str) -> list[tuple]:
    try:
        return [(*run, None) for run in src.statement_runs(source)]
    except src.FAILURES as e:
        return [(None, None, None, type(e).__name__)]


def extents(df: DataFrame) -> DataFrame:
    """Runs of each file; a file that can't be read is one row with its error, never no row."""
    return _by_source(df, _extents, "rfirst int, rlast int, owner int, error string")


def _mutants(source: str) -> list[tuple]:
    return src.mutants(source, set(range(1, source.count("\n") + 2)))


def mutants(df: DataFrame) -> DataFrame:
    return _by_source(df, _mutants, "line int, col int, end_col int, orig string, repl string, op string, kind string")


def _imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(p, m) for p, s in zip(b["path"], b["source"], strict=True) for m in src.imports(s)], columns=["path", "module"])


def imports(df: DataFrame) -> DataFrame:
    return _batched(df).mapInPandas(_imports, "path string, module string")


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part, paths, lines = b.slice(at, ROWS_AT_ONCE), [], []
            for path, base, new in zip(*(part.column(c) for c in ("path", "base", "new")), strict=True):
                found = patches.added_lines(base.as_py(), new.as_py())
                paths += [path.as_py()] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int32())], names=["path", "line"])


def changed_lines(df: DataFrame) -> DataFrame:
    """Lines of new (path, base, new) that base lacks; base NULL: all of them."""
    return _batched(df).select("path", "base", "new").mapInArrow(_changed, "path string, line int")


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, base, patch in zip(b["path"], b["base"], b["patch"], strict=True):
            try:
                out.append((path, patches.apply(base, patch), None))
            except patches.Refused as e:
                out.append((path, None, str(e)))
        yield pd.DataFrame(out, columns=["path", "new_content", "error_code"])


def applied(df: DataFrame) -> DataFrame:
    return _batched(df).mapInPandas(_applied, "path string, new_content string, error_code string")
