"""Where hunks stand in their base: a join of hashes of the lines they take with hashes of the base's windows.

A base is one row with the hashes of its lines. For each length of a hunk of the file, windows of that length are
hashed where their first line is the first line of such a hunk, and meet the hunks in an equi-join on file,
length and hash; a hunk's places are what it meets. Hunks of an entry are then taken in order: at the stated line if
they stand there, else at the one other place at or after the hunk before; none or several is refused. A submodule's
commit is a line of no file, so a hunk that moves it has no place, even where a file of that path holds such a line;
nor does an entry apply in which such a line follows a hunk that doesn't count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diffs import ENTRY

FILE = ["change_id", "path"]


def lines_of(content: Column) -> Column:
    """Lines of a text; a last newline doesn't begin another."""
    parts = F.split(content, "\n", -1)
    return F.when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def places(hunk_rows: DataFrame, base: DataFrame) -> DataFrame:
    """ENTRY, h and at_lines, the sorted lines (from 0) of the base where a hunk's replaced lines stand. 64-bit hashes of lines decide."""
    h = hunk_rows.filter(F.size("replaced") > 0).select(*ENTRY, "path", "h", _hashes(F.col("replaced")).alias("_old"))
    h = h.select(*ENTRY, "path", "h", F.size("_old").alias("k"), F.element_at("_old", 1).alias("first"), F.xxhash64("_old").alias("window"))
    wanted = h.groupBy(*FILE, "k").agg(F.collect_set("first").alias("_firsts")).withColumnsRenamed({"change_id": "_c", "path": "_p", "k": "_k"})
    files = base.filter("content is not null").select(*FILE, _hashes(lines_of(F.col("content"))).alias("_lines"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines") - F.col("_k") + 1), lambda i: F.array_contains(F.col("_firsts"), F.element_at("_lines", i)))
    starts = F.when(F.size("_lines") >= F.col("_k"), starts).otherwise(F.array().cast("array<int>"))
    windows = files.join(wanted, (F.col("change_id") == F.col("_c")) & (F.col("path") == F.col("_p"))).select("_c", "_p", "_k", "_lines", F.explode(starts).alias("_i"))
    windows = windows.select("_c", "_p", "_k", F.xxhash64(F.slice("_lines", F.col("_i"), F.col("_k"))).alias("_w"), (F.col("_i") - 1).alias("_at"))
    same = (F.col("change_id") == F.col("_c")) & (F.col("path") == F.col("_p")) & (F.col("k") == F.col("_k")) & (F.col("window") == F.col("_w"))
    return h.join(windows, same).groupBy(*ENTRY, "h").agg(F.array_sort(F.collect_list("_at")).alias("at_lines"))


def placed(hunk_rows: DataFrame, base: DataFrame) -> DataFrame:
    """ENTRY, path, applies, and at_lines, where each hunk in order was placed (from 0, NULL from the first refused one on)."""
    there = base.filter("content is not null").select(*FILE).withColumn("_there", F.lit(True))
    found = places(hunk_rows, base)
    df = hunk_rows.select(*ENTRY, "path", "h", F.greatest(F.col("old_start") - 1, F.lit(0)).cast("int").alias("want"), F.size("replaced").alias("k"), "linked", "stray").join(found, [*ENTRY, "h"], "left").join(there, FILE, "left")
    # lines taken from nothing can't be found; lines put into nothing stand at its start
    nowhere = F.array().cast("array<int>")
    spots = F.when(F.col("linked"), nowhere).when((F.col("k") == 0), F.array(F.when(F.col("_there"), F.col("want")).otherwise(0))).otherwise(F.coalesce("at_lines", nowhere))
    rows = df.groupBy(*ENTRY, "path").agg(F.array_sort(F.collect_list(F.struct("h", "want", "k", spots.alias("spots")))).alias("_h"), F.bool_or("stray").alias("_stray"))

    def step(s: Column, x: Column) -> Column:
        later = F.filter(x["spots"], lambda c: c >= s["done"])
        spot = F.when(F.array_contains(later, x["want"]), x["want"]).when(F.size(later) == 1, F.element_at(later, 1))
        spot = F.when(s["ok"], spot)
        return F.struct(F.coalesce(spot + x["k"], s["done"]).alias("done"), spot.isNotNull().alias("ok"), F.concat(s["at_lines"], F.array(spot)).alias("at_lines"))

    begin = F.struct(F.lit(0).alias("done"), F.lit(True).alias("ok"), F.array().cast("array<int>").alias("at_lines"))
    return rows.withColumn("_s", F.aggregate("_h", begin, step)).select(*ENTRY, "path", (F.col("_s.ok") & ~F.col("_stray")).alias("applies"), F.col("_s.at_lines").alias("at_lines"))


def applied(hunk_rows: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """ENTRY, path and new_content of entries that apply. found: of `placed`. Files that aren't UTF-8 have none.

    A file is what stands between its hunks and what they put there. Its last newline is the base's, unless the last hunk reaches the end.
    """
    rows = hunk_rows.groupBy(*ENTRY, "path").agg(F.array_sort(F.collect_list(F.struct("h", F.size("replaced").alias("k"), "put", "open_end"))).alias("_h"))
    b = base.select(F.col("change_id").alias("_c"), F.col("path").alias("_p"), "utf8", "content")
    df = rows.join(found.filter("applies").select(*ENTRY, "at_lines"), ENTRY).join(b, (F.col("change_id") == F.col("_c")) & (F.col("path") == F.col("_p")), "left").filter("utf8 is null or utf8")
    old = F.coalesce(lines_of(F.col("content")), F.array().cast("array<string>"))
    df = df.withColumn("_old", old)
    after = lambda i: F.when(i > 0, F.get("at_lines", i - 1) + F.get("_h", i - 1)["k"]).otherwise(0)
    between = F.transform("_h", lambda x, i: F.concat(F.slice("_old", after(i) + 1, F.get("at_lines", i) - after(i)), x["put"]))
    end = after(F.size("_h"))
    lines = F.concat(F.flatten(between), F.slice("_old", end + 1, F.size("_old")))
    last = F.element_at("_h", -1)
    reaches = (end >= F.size("_old")) & ((F.size(last["put"]) > 0) | last["open_end"])
    newline = F.when(reaches, ~last["open_end"]).otherwise(F.coalesce(F.endswith("content", F.lit("\n")), F.lit(True)))
    text = F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.when(newline, "\n").otherwise("")))
    return df.select(*ENTRY, "path", text.alias("new_content"))
