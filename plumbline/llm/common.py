"""What the operators of this folder share: tables, the shared folder, slim prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows up to which a table of narrow rows (under 100 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Rows of an Arrow batch: some megabytes of text, where Spark's default of 10,000 would be tens.
BATCH_ROWS = "1000"

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no copy of the repository, and
    keep this session's Arrow batches small where its user hasn't chosen their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # Spark hands the file out from here while the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "plumbline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("plumbline", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


@lru_cache(1)
def one_thread() -> None:
    """Keeps numpy's matrix products in this worker to one thread: tasks fill the cores already, and threads that wait
    for one another take as much of them as those that work."""
    libraries = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")
    for path in glob.glob(libraries):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def local_file(path: str) -> str:
    """A file of a tokenizer where this process runs: at its path, or else where the package of that name keeps it."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def release(batches: Iterator) -> Iterator:
    """The same batches, made on one thread; at the end the worker gives freed memory back, since it lives on for other
    tasks."""
    one_thread()
    yield from batches
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Only where that is unset and all runs in one process (tests) is a
    local one made; on a cluster without it this raises, since executors would write where nobody reads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            own = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own_folder[app] = f"file://{own}"
        base = _own_folder[app]
    return f"{base.rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored_ones: DataFrame) -> None:
    """Removes what `stored` wrote for these, which nothing may read any more."""
    for df in stored_ones:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows. df should be stored or otherwise cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text, for folds. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows of the same group that come before each row.

    `bucket` must not decrease along `order`. Only one (group, bucket) meets in a task; the offsets
    of buckets come from a table with one row for each of them, so a group of any size is spread.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, bucket])], F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*group, bucket])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(offsets, cond)
        .withColumn(out, F.col("_in") + F.col("_off"))
        .drop("_in", "_off", *[f"_g{i}" for i in range(len(group) + 1)])
    )


def least_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each group, those with the least hash of key.

    Groups are counted first; rows whose hash is beyond twice the share wanted are left before the window, so
    about 2 * most rows of a group meet in a task, whatever its size.
    """
    sizes = small(stored(rows.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g"), "sizes"))
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 40))).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    near = hashed.filter(F.col("_h").cast("double") * F.col("_n") <= 2.0 * most * (1 << 40)).drop("_n", "_g")
    w = Window.partitionBy(group).orderBy("_h", key)
    return near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k", "_h")
