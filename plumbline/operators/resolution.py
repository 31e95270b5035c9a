"""Imports to files: candidates in order, the first that exists; and the first executable of a name on a PATH."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import lexical

# ---- fixed values: what a module's name may stand for, in the order in which it is looked for ----
PYTHON = ("{}.py", "{}/__init__.py")
TYPESCRIPT = ("{}.ts", "{}.tsx", "{}.d.ts", "{}/index.ts", "{}/index.tsx", "{}/index.d.ts")
#: A name with the ending of compiled code stands for its source.
SOURCES = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".d.ts"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
PACKAGES = ("node_modules/{}/package.json", "node_modules/{}/index.d.ts", "node_modules/@types/{}/index.d.ts")
# ---- end of fixed values ----


def _filled(patterns: tuple[str, ...], name: Column) -> Column:
    return F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in (p.split("{}") for p in patterns)])



def candidates(path: Column, module: Column) -> Column:
    """Files that an import of `module` in `path` may stand for, in order; both relative to the repository's root."""
    parts = F.split(path, "/")
    folder = F.slice(parts, 1, F.size(parts) - 1)
    at = lambda rel: F.array_join(lexical(F.concat_ws("/", F.array_join(folder, "/"), rel)), "/")
    place = at(module)
    compiled = F.lit(None).cast("array<string>")
    for ending, sources in SOURCES.items():
        stem = F.regexp_replace(place, rf"\{ending}\z", "")
        compiled = F.when(module.endswith(ending), F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(compiled)
    # a package is looked for in every folder from the file's own up to the root
    up = F.transform(F.sequence(F.size(folder), F.lit(0), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(folder, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    package = F.flatten(F.transform(up, lambda d: F.transform(_filled(PACKAGES, module), lambda p: F.concat(d, p))))
    typescript = F.when(F.startswith(module, F.lit(".")), F.coalesce(compiled, _filled(TYPESCRIPT, place))).otherwise(package)
    return F.when(path.endswith(".py"), _filled(PYTHON, F.replace(module, F.lit("."), F.lit("/")))).otherwise(typescript)


def resolve(imports: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """imports (keys, path, module), distinct, with found: the first candidate among files (keys, path), NULL where none is."""
    once = imports.select(*keys, "path", "module").distinct()
    each = once.select(*keys, "path", "module", F.posexplode(candidates(F.col("path"), F.col("module"))).alias("rank", "_file"))
    have = files.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_have")).distinct()
    same = F.col("_file") == F.col("_have")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    first = each.join(have, same, "left").groupBy(*keys, "path", "module").agg(F.min(F.when(F.col("_have").isNotNull(), F.struct("rank", "_file"))).alias("_m"))
    return first.select(*keys, "path", "module", F.col("_m._file").alias("found"))


def unresolved(imports: DataFrame, files: DataFrame, builtins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, module) of imports that stand for no file and are no module of the language. builtins: suffix ('.py', or '' for the
    others) and name, of bounded size; a name that begins with `node:` is one too."""
    b = builtins.select("suffix", F.col("name").alias("_name"))
    top = F.when(F.col("path").endswith(".py"), F.substring_index("module", ".", 1)).otherwise(F.col("module"))
    kind = F.when(F.col("path").endswith(".py"), ".py").otherwise("")
    own = imports.filter(F.col("path").endswith(".py") | ~F.startswith("module", F.lit("node:"))).join(b, (kind == F.col("suffix")) & (top == F.col("_name")), "left_anti")
    return resolve(own, files, keys).filter("found is null").drop("found")


def first_on_path(commands: DataFrame, files: DataFrame) -> DataFrame:
    """commands (id, name, search) with script, the program that a shell would run for `name` with PATH `search`, and interpreter; both
    NULL where that isn't a Python script that can be run the same way, or can't be known.

    files: path, executable, is_file, first_line. The first executable file decides, even if it is of no use. An empty or
    relative entry before it stands for a folder that can't be known, so nothing after it counts.
    """
    entries = commands.select("id", "name", F.posexplode(F.split("search", ":", -1)).alias("pos", "dir"))
    f = files.filter("executable and is_file").select(F.col("path").alias("_file"), "first_line")
    at = F.concat(F.regexp_replace("dir", "/+$", ""), F.lit("/"), F.col("name"))
    hit = entries.withColumn("at", at).join(f, F.col("at") == F.col("_file"), "left")
    unknown = ~F.startswith("dir", F.lit("/"))
    per = hit.groupBy("id").agg(F.min(F.when(unknown | F.col("_file").isNotNull(), F.struct("pos", unknown.alias("unknown"), "_file", "first_line"))).alias("m"))
    line = F.regexp_replace("m.first_line", r"\r\z", "")
    words = F.filter(F.split(F.trim(F.substring(line, 3, 1 << 30)), r"\s+"), lambda w: w != "")
    head = F.get(words, F.lit(0))
    python = F.startswith(line, F.lit("#!")) & line.rlike("(?i)python")
    named = F.when(head.rlike("(^|/)env$"), F.when((F.size(words) == 2) & F.get(words, F.lit(1)).rlike("(?i)python"), F.get(words, F.lit(1)))).when((F.size(words) == 1) & F.startswith(head, F.lit("/")), head)
    ok = ~F.col("m.unknown") & ~F.col("name").rlike(r"[/\\]") & python & named.isNotNull()
    p = per.withColumnRenamed("id", "_id")
    return commands.join(p, F.col("id") == F.col("_id"), "left").select("id", F.when(ok, F.col("m._file")).alias("script"), F.when(ok, named).alias("interpreter"))
