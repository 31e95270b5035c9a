"""Does a path stay within its repository once links are followed?

Paths are rewritten over a table of links until none applies, as a file system does: the first component that is a link
gives way to its target, and `..` takes off what stands before it only when that is known not to be a link. A path that
comes back to what it was, or meets more links than any file system follows, is in a cycle and doesn't resolve. Where a path itself doesn't resolve its deepest
ancestor that does decides, since a file is made through the folders that exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links that a path may meet, as usual kernels have it (fixed value).
MOST_LINKS = 40


def parts(path: Column) -> Column:
    """Components of an absolute path, `..` included."""
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def lexical(path: Column) -> Column:
    """Components with each `..` applied to what stands before it."""
    step = lambda a, c: F.when(c == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(c)))
    return F.aggregate(parts(path), F.array().cast("array<string>"), step)


def _joined(c: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(c, "/"))


def resolved(paths: DataFrame, links: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """paths (tree, path: absolute) with real, the path without links, NULL where it meets more than MOST_LINKS, and needs, what
    stood before a `..` on the way and so has to be a folder.

    links: tree, path (absolute, itself without links but the last component), target. Each round takes all paths over their
    first link and past their first `..`; keep writes a frame for the next round, so plans don't grow. Rounds follow the
    longest chain of links, not the number of paths.
    """
    on = links.select(F.col("tree").alias("_t"), F.col("path").alias("_link"), "target")
    state = paths.select("tree", "path").distinct().withColumns({"c": parts(F.col("path")), "met": F.lit(0), "been": F.array().cast("array<bigint>"), "needs": F.array().cast("array<string>")})
    done = None
    while True:
        up = F.array_position("c", "..").cast("int")
        head = F.when(up > 0, F.slice("c", 1, F.greatest(up - 1, F.lit(0)))).otherwise(F.col("c"))
        rows = state.withColumns({"up": up, "n": F.size(head)})
        depth = F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))))
        each = rows.withColumn("d", depth).withColumn("_prefix", _joined(F.slice("c", 1, F.coalesce("d", F.lit(0)))))
        hit = each.join(on, (F.col("tree") == F.col("_t")) & (F.col("_prefix") == F.col("_link")))
        first = hit.groupBy("tree", "path").agg(F.min(F.struct("d", "target")).alias("_hit")).withColumnsRenamed({"tree": "_tree", "path": "_path"})
        df = rows.join(first, (F.col("tree") == F.col("_tree")) & (F.col("path") == F.col("_path")), "left").drop("_tree", "_path")
        target, d, c = F.col("_hit.target"), F.col("_hit.d"), F.col("c")
        rest = F.slice(c, d + 1, F.size(c))
        over = F.concat(F.when(F.startswith(target, F.lit("/")), F.array().cast("array<string>")).otherwise(F.slice(c, 1, d - 1)), parts(target), rest)
        past = F.concat(F.slice(c, 1, F.greatest(F.col("up") - 2, F.lit(0))), F.slice(c, F.col("up") + 1, F.size(c)))
        moved = F.when(d.isNotNull(), over).when(F.col("up") > 0, past)
        stepped = F.when(d.isNull() & (F.col("up") > 1), F.array(_joined(F.slice(c, 1, F.col("up") - 1)))).otherwise(F.array().cast("array<string>"))
        cycle = moved.isNotNull() & (F.array_contains("been", F.xxhash64(moved)) | (F.col("met") >= MOST_LINKS))
        df = df.select("tree", "path", F.coalesce(moved, c).alias("c"), (F.col("met") + d.isNotNull().cast("int")).alias("met"), F.concat("been", F.array(F.xxhash64(c))).alias("been"), F.concat("needs", stepped).alias("needs"), moved.isNull().alias("over"), F.coalesce(cycle, F.lit(False)).alias("cycle"))
        df = keep(df, "links")
        ended = df.filter("over or cycle").select("tree", "path", F.when(F.col("over"), _joined(F.col("c"))).alias("real"), "needs")
        done = ended if done is None else done.unionByName(ended)
        state = df.filter("not over and not cycle").drop("over", "cycle")
        if not state.limit(1).count():
            return done


def contained(candidates: DataFrame, roots: DataFrame, links: DataFrame, exists: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """candidates (tree, rel) with real, NULL where there is no such file, and inside. roots: tree, root; exists: tree, path and
    folder, whether it is one, of what there is besides links. A root that doesn't resolve holds nothing."""
    r = roots.select(F.col("tree").alias("_r"), "root")
    full = F.when(F.startswith("rel", F.lit("/")), F.col("rel")).otherwise(F.concat("root", F.lit("/"), F.col("rel")))
    all_ = candidates.join(r, F.col("tree") == F.col("_r")).select("tree", "rel", "root", lexical(full).alias("c"))
    # a folder above many files is resolved once
    lines = all_.select("tree", "rel", "root", F.size("c").alias("size"), F.explode(F.sequence(F.lit(0), F.size("c"))).alias("d"), "c").withColumn("path", _joined(F.slice("c", 1, F.col("d"))))
    top = r.select(F.col("_r").alias("tree"), _joined(lexical(F.col("root"))).alias("path"))
    wanted = lines.select("tree", "path").unionByName(top).distinct()
    there = exists.select(F.col("tree").alias("_t"), F.col("path").alias("_there")).distinct()
    found = keep(resolved(wanted, links, keep).filter("real is not null"), "found")
    folders = exists.filter("folder").select(F.col("tree").alias("_t"), F.col("path").alias("_there")).distinct()
    needs = found.select("tree", "path", F.explode("needs").alias("need")).filter("need <> '/'")
    lost = needs.join(folders, (F.col("tree") == F.col("_t")) & (F.col("need") == F.col("_there")), "left_anti").select(F.col("tree").alias("_t"), F.col("path").alias("_path")).distinct()
    real = found.join(lost, (F.col("tree") == F.col("_t")) & (F.col("path") == F.col("_path")), "left_anti").drop("needs")
    real = real.join(there, (F.col("tree") == F.col("_t")) & (F.col("real") == F.col("_there")), "left").filter((F.col("real") == "/") | F.col("_there").isNotNull())
    real = keep(real.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"), "real"), "real")
    same = (F.col("tree") == F.col("_tree")) & (F.col("path") == F.col("_path"))
    base = top.join(real, same).select(F.col("tree").alias("_base"), F.col("real").alias("real_root"))
    deepest = lines.join(real, same).groupBy("tree", "rel").agg(F.max(F.struct("d", "real", (F.col("d") == F.col("size")).alias("own"))).alias("m")).withColumnsRenamed({"tree": "_t", "rel": "_rel"})
    df = candidates.select("tree", "rel").distinct().join(deepest, (F.col("tree") == F.col("_t")) & (F.col("rel") == F.col("_rel")), "left").join(base, F.col("tree") == F.col("_base"), "left")
    at, root = F.col("m.real"), F.col("real_root")
    inside = F.coalesce((at == root) | F.startswith(at, F.concat(F.when(root == "/", "").otherwise(root), F.lit("/"))), F.lit(False))
    return df.select("tree", "rel", F.when(F.col("m.own"), at).alias("real"), inside.alias("inside"))
