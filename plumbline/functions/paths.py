"""Predicates and normal forms of repository paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(path: Column) -> Column:
    """One leading a/ or b/ off."""
    return F.regexp_replace(path, "^[ab]/", "")


def normalise(path: Column) -> Column:
    """Backslashes to slashes, then one leading ./ off."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def inside(path: Column) -> Column:
    """Lexically within the repository: not empty, not absolute, and never above the root on the way."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    step = lambda d, s: F.when(s == "..", d - 1).when(s.isin("", "."), d).otherwise(d + 1)
    walk = lambda a, s: F.struct(step(a["d"], s).alias("d"), F.least(a["low"], step(a["d"], s)).alias("low"))
    low = F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), walk)["low"]
    return (p != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (low >= 0)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test(path: Column) -> Column:
    """Under tests/ or test/, or named like a Python or TypeScript test."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    named = basename(p).rlike(r"^(conftest\.py|test_.+\.py|.*_test\.py|.*\.(test|spec)\.[cm]?[jt]sx?)\z")
    return F.arrays_overlap(F.split(p, "/"), F.array(F.lit("tests"), F.lit("test"))) | named


def is_discovered(path: Column) -> Column:
    """A name that a test run would collect by default."""
    return basename(path).rlike(r"^(test_.*|.*_test)\.py\z")


def under(path: Column, folder: Column) -> Column:
    """Segment-wise: tests doesn't hold tests_extra/. An empty folder or . holds all."""
    d = F.regexp_replace(F.regexp_replace(folder, r"^\./", ""), "/+$", "")
    return d.isin("", ".") | (path == d) | F.startswith(path, F.concat(d, F.lit("/")))


def language(path: Column) -> Column:
    """python, typescript, or null where no check applies."""
    return F.when(path.endswith(".py"), "python").when(path.rlike(r"\.(ts|tsx|js|jsx)\z"), "typescript")


def some_of(values: Column, most: int, sep: str = ", ") -> Column:
    """The first `most` values joined, then how many more there are."""
    shown = F.array_join(F.slice(values, 1, most), sep)
    more = F.size(values) - most
    return F.when(more > 0, F.concat(shown, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(shown)
