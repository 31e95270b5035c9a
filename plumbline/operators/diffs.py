"""Unified diff text as a table of lines: hunk bodies by their counts, entries, signals, refusals, new line numbers.

A diff is one text, or several pieces that each begin at an entry's head (`at`); windows are over a piece, so a diff of
any number of pieces is spread. Within a hunk the lines that its header counts are its body, whatever they look
like; only what is left can open an entry: a `diff` line, or a pair of `---` and `+++` lines, which names the entry
opened by the `diff` line before it or else opens one itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import strip_prefix

#: Refusals of a whole change, and of its first entry that can't be taken, in the order in which they are reported.
REFUSALS = ("MALFORMED", "DELETE", "COPY", "RENAME", "SUBMODULE", "NOT_UTF8", "ZERO_CONTEXT", "NOT_APPLIED", "BINARY_ONLY", "BINARY_MIXED", "NO_EDITS")

#: Lines that git writes about an entry (fixed values); those with mode 160000 make it a submodule's.
HEADERS = (
    r'^diff --git "a/.+?" "b/(.+)"$',
    r'^diff --git \S.* "b/(.+)"$',
    r'^diff --git "a/(.+)" b/\1$',
    r"^diff --git a/(.+) b/\1$",
    r"^diff --git a/.+? b/(.+)$",
    r"^diff --git (.+) \1$",
)
GITLINK = r"^index [0-9a-f]+\.\.[0-9a-f]+ 160000$|^(?:new file |deleted file |old |new )?mode 160000$"
SUBPROJECT = r"^[-+ ]Subproject commit [0-9a-f]{7,40}(-dirty)?$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NOTHING = "/dev/null"

PIECE = ["change_id", "at"]
ENTRY = [*PIECE, "entry"]


def whole() -> Column:
    """`at` of a diff that is one piece."""
    return F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("id"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """raw_diff (change_id, text, and `at` where it comes in pieces) to change_id, at, n, line, from 1, and last."""
    at = F.col("at") if "at" in diffs.columns else whole().alias("at")
    lines = F.split("text", "\n", -1)
    return diffs.select("change_id", at, F.size(lines).alias("_size"), F.posexplode(lines).alias("n", "line")).select("change_id", "at", (F.col("n") + 1).alias("n"), "line", (F.col("n") + 1 == F.col("_size")).alias("last"))


def _begins(*marks: str) -> Column:
    return F.substring("line", 1, 1).isin(*marks)


def _count(group: int) -> Column:
    """A number of a hunk's header; a count that is left out is 1."""
    found = F.regexp_extract("line", HUNK, group)
    return F.when(found == "", 1).otherwise(found.try_cast("long")).cast("long")


def _name(of: Column) -> Column:
    """The file of a `---` or `+++` line: up to a tab, quotes and one leading a/ or b/ off."""
    plain = F.rtrim(F.regexp_replace(F.substring_index(F.substring(of, 5, 1 << 30), "\t", 1), r"\r$", ""))
    return strip_prefix(F.regexp_replace(F.replace(plain, F.lit("\\\\"), F.lit("\\")), r'^"(.*)"$', "$1"))


def entries(lines: DataFrame) -> DataFrame:
    """lines with body (of a hunk), entry (0 before the first), h, the number of the hunk within its entry, the header's
    numbers, new_line, the line's number in the new file, old and new as the entry's lines name its file (null without such
    lines, and before them), its path as far as it has been named, and link, whether it is a commit line after the entry's
    gitlink mode.

    All windows run over a piece in the order of its lines, so lines are sorted once; what holds within a hunk or an entry
    is a running value less, or not older than, that of the line which opens it.
    """
    piece = Window.partitionBy(*PIECE).orderBy("n")
    before = piece.rowsBetween(Window.unboundedPreceding, -1)
    upto = piece.rowsBetween(Window.unboundedPreceding, 0)
    newest = lambda when, value, over=upto: F.last(F.when(when, value), ignorenulls=True).over(over)
    line, n = F.col("line"), F.col("n")
    blank = (line == "") & ~F.col("last")
    takes_old, takes_new = _begins(" ", "-") | blank, _begins(" ", "+") | blank
    df = lines.withColumn("_head", line.rlike(HUNK))
    df = df.withColumns({"_heads": F.count_if("_head").over(upto), "_olds": F.count_if(takes_old).over(before), "_news": F.count_if(takes_new).over(before)})
    head = F.struct(n, "_olds", "_news", *[_count(k).alias(c) for c, k in {"old_start": 1, "old_n": 2, "new_start": 3, "new_n": 4}.items()])
    df = df.withColumn("_hunk", newest(F.col("_head"), head))
    old, put = F.col("_olds") - F.col("_hunk._olds"), F.col("_news") - F.col("_hunk._news")
    open_ = (old < F.col("_hunk.old_n")) | (put < F.col("_hunk.new_n"))
    df = df.withColumn("_fits", ((takes_old | takes_new) & open_) | _begins("\\"))
    misfit = newest(~F.col("_fits") & ~F.col("_head"), n, before)
    df = df.withColumn("body", F.col("_hunk").isNotNull() & ~F.col("_head") & F.col("_fits") & ~F.coalesce(misfit > F.col("_hunk.n"), F.lit(False)))
    diff = ~F.col("body") & F.startswith("line", F.lit("diff "))
    pair = ~F.col("body") & F.startswith("line", F.lit("--- ")) & F.coalesce(F.startswith(F.lead("line").over(piece), F.lit("+++ ")), F.lit(False))
    df = df.withColumn("_event", F.when(diff, "diff").when(pair, "pair").when(F.col("_head"), "hunk"))
    opens = (F.col("_event") == "diff") | ((F.col("_event") == "pair") & (F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit("")) != "diff"))
    df = df.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_second": F.coalesce((F.lag("_event").over(piece) == "pair") & ~F.col("body"), F.lit(False))})
    named = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in HEADERS])
    df = df.withColumns(
        {
            "entry": F.count_if("_opens").over(upto),
            "_open": newest(F.col("_opens"), F.struct(n, F.col("_heads").alias("heads"))),
            "_old": newest(F.col("_event") == "pair", F.struct(n, _name(line).alias("name"))),
            "_new": newest(F.col("_second"), F.struct(n, _name(line).alias("name"))),
            "_git": newest(F.col("_event") == "diff", F.struct(n, named.alias("name"))),
            "_mode": newest(line.rlike(GITLINK), n),
        }
    )
    # of the entry: not older than the line that opened it
    own = lambda c, value: F.when(c >= F.coalesce("_open.n", F.lit(0)), value)
    of = {c: own(F.col(f"_{c}.n"), F.col(f"_{c}.name")) for c in ("old", "new", "git")}
    there = lambda c: F.nullif(of[c], F.lit(NOTHING))
    path = F.coalesce(there("new"), there("old"), of["git"], F.lit(""))
    link = line.rlike(SUBPROJECT) & F.coalesce(own(F.col("_mode"), F.lit(True)), F.lit(False))
    numbers = [F.col("_hunk")[c].alias(c) for c in ("old_start", "old_n", "new_start", "new_n")]
    h = F.col("_heads") - F.coalesce("_open.heads", F.lit(0))
    return df.select(*PIECE, "n", "line", "entry", h.alias("h"), "body", *numbers, (F.col("_hunk.new_start") + put).alias("new_line"), of["old"].alias("old"), of["new"].alias("new"), path.alias("path"), link.alias("link"))


def entry_flags(e: DataFrame) -> DataFrame:
    """Signals of each entry. A rename or copy has both its lines, or its two names differ; a submodule has a commit line
    after its mode, since a file's content may hold such a line too."""
    line, none = F.col("line"), F.lit(NOTHING)
    has = lambda pattern: F.bool_or(line.rlike(pattern))
    after = lambda first, then: F.coalesce(F.min(F.when(line.rlike(first), F.col("n"))) < F.max(F.when(line.rlike(then), F.col("n"))), F.lit(False))
    named = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    old, new = F.col("old"), F.col("new")
    # an entry is named by its lines in order, so its last line has its names
    found = e.filter("entry > 0").groupBy(*ENTRY).agg(
        F.max_by("path", "n").alias("path"),
        (has(r"^deleted file mode") | named((new == none) & (old != none) & (old != ""))).alias("deleted"),
        after(r"^rename from .", r"^rename to ").alias("_moved"),
        named((old != none) & (new != none) & (old != "") & (new != "") & (old != new)).alias("_renamed"),
        after(r"^copy from .", r"^copy to ").alias("copied"),
        F.bool_or("link").alias("submodule"),
        has(r"^(Binary files |GIT binary patch)").alias("is_binary"),
        (F.max("h") > 0).alias("has_hunks"),
        named(old == none).alias("from_nothing"),
    )
    renamed = (F.col("_moved") | (F.col("_renamed") & ~F.col("copied"))).alias("renamed")
    return found.select(*ENTRY, "path", "deleted", renamed, "copied", "submodule", "is_binary", "has_hunks", "from_nothing")


def hunks(e: DataFrame) -> DataFrame:
    """One row for each hunk: its start in the base, the lines it takes from there (replaced) and puts there (put), open_end, whether a line
    without newline is the last of those, anchored, whether it has context or a removal, linked, whether it moves a submodule's
    commit, stray, whether such a line follows it that it doesn't count, and malformed, whether its body isn't what its header counts."""
    body = lambda *marks: F.col("body") & _begins(*marks)
    blank = F.col("body") & (F.col("line") == "")
    lines = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when | blank, F.struct("n", F.substring("line", 2, 1 << 30).alias("text"))))), lambda x: x["text"])
    ends = F.max(F.when(body(" ", "+", "\\") | blank, F.struct("n", F.startswith("line", F.lit("\\")).alias("open"))))["open"]
    return e.filter("h > 0 and entry > 0").groupBy(*ENTRY, "path", "h").agg(
        F.max("old_start").alias("old_start"),
        lines(body(" ", "-")).alias("replaced"),
        lines(body(" ", "+")).alias("put"),
        F.coalesce(ends, F.lit(False)).alias("open_end"),
        F.bool_or(body(" ", "-")).alias("anchored"),
        F.bool_or(F.col("body") & F.col("link")).alias("linked"),
        F.bool_or(~F.col("body") & F.col("link")).alias("stray"),
        ((F.count_if(body(" ", "-") | blank) != F.max("old_n")) | (F.count_if(body(" ", "+") | blank) != F.max("new_n"))).alias("malformed"),
    )


def entry_errors(flags: DataFrame, hunk_rows: DataFrame, base: DataFrame, places: DataFrame) -> DataFrame:
    """ENTRY, path and error_code of entries with hunks that can't be taken. base: change_id, path, content, utf8, without a row
    where there is no such file; places: of placement.placed."""
    b = base.select(F.col("change_id").alias("_c"), F.col("path").alias("_p"), "utf8", (F.col("content") == "").alias("empty"))
    per = hunk_rows.groupBy(*ENTRY, "path").agg(F.bool_or(~F.col("anchored")).alias("loose"))
    df = per.join(flags.select(*ENTRY, "from_nothing"), ENTRY).join(places.select(*ENTRY, "applies"), ENTRY, "left")
    df = df.join(b, (F.col("change_id") == F.col("_c")) & (F.col("path") == F.col("_p")), "left")
    fresh = F.col("_p").isNull() | (F.col("from_nothing") & F.coalesce("empty", F.lit(False)))
    code = F.when(~F.coalesce("utf8", F.lit(True)), "NOT_UTF8").when(F.col("loose") & ~fresh, "ZERO_CONTEXT").when(~F.coalesce("applies", F.lit(True)), "NOT_APPLIED")
    return df.select(*ENTRY, "path", code.alias("error_code")).filter("error_code is not null")


def refusal(changes: DataFrame, flags: DataFrame, hunk_rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Why each change's diff can't be taken, NULL if it can. errors: of entry_errors; the first one counts."""
    bad = hunk_rows.groupBy("change_id").agg(F.bool_or("malformed").alias("malformed"))
    first = errors.groupBy("change_id").agg(F.min(F.struct("at", "entry", "error_code"))["error_code"].alias("_first"))
    any_ = lambda c: F.bool_or(c).alias(c)
    per = flags.groupBy("change_id").agg(*[any_(c) for c in ("deleted", "copied", "renamed", "submodule", "is_binary", "has_hunks")])
    on = lambda c: F.coalesce(c, F.lit(False))
    why = (
        F.when(on("malformed"), "MALFORMED")
        .when(on("deleted"), "DELETE")
        .when(on("copied"), "COPY")
        .when(on("renamed"), "RENAME")
        .when(on("submodule"), "SUBMODULE")
        .when(F.col("_first").isNotNull(), F.col("_first"))
        .when(on("is_binary") & ~on("has_hunks"), "BINARY_ONLY")
        .when(on("is_binary"), "BINARY_MIXED")
        .when(~on("has_hunks"), "NO_EDITS")
    )
    all_ = changes.select("change_id").distinct()
    return all_.join(per, "change_id", "left").join(bad, "change_id", "left").join(first, "change_id", "left").select("change_id", why.alias("error_code"))


def new_lines(e: DataFrame) -> DataFrame:
    """Line numbers in the new file of the lines that hunks add."""
    return e.filter(F.col("body") & (F.col("entry") > 0) & _begins("+")).select("change_id", "path", F.col("new_line").cast("int").alias("line"))
