"""What files a folder holds, and passes that decode only those that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.sources.sidecar import SELDOM

#: Changed files that a pass names one by one; with more it lists the folder again and keeps those by a join.
NAMED_FILES = 20_000
_MANIFEST = "path string, size long, modified timestamp, pass long"


def survey(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, size, modified)`` of every file; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stamps(files: DataFrame) -> DataFrame:
    """One row: ``n`` files, and ``stamp`` and ``seldom_stamp`` over the names, sizes and times of all and of the seldom written ones.

    Two surveys with equal stamps stand for the same files. Stamps are sums of hashes, so every task adds up its own.
    """
    one = F.xxhash64("path", "size", "modified").cast("decimal(38,0)")
    ending = F.substring_index(F.substring_index("path", "/", -1), ".", -1)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("string")
    return files.agg(F.count("*").alias("n"), total(one).alias("stamp"), total(F.when(ending.isin(*SELDOM), one)).alias("seldom_stamp"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, what)``: ``added``, ``changed``, ``kept`` or ``gone`` between two surveys."""
    both = now.select("path", F.struct("size", "modified").alias("n")).join(before.select("path", F.struct("size", "modified").alias("b")), "path", "full")
    what = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "gone").when(F.col("n") == F.col("b"), "kept").otherwise("changed")
    return both.select("path", what.alias("what"))


def _last(spark: SparkSession, cache: str) -> tuple[DataFrame, int]:
    """The manifest of the last finished pass and its number; an empty one and 0 if there is none."""
    try:
        passes = spark.read.schema(f"{_MANIFEST}, at long").parquet(f"{cache}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST), 0
    last = passes.agg(F.max("at")).first()[0]
    return passes.where(F.col("at") == last).drop("at"), last


def refresh(spark: SparkSession, paths: list[str], cache: str, decode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The decoded rows of all files under ``paths``, and one row on the pass: n_files, n_read, n_kept, n_gone, moved.

    ``decode`` maps (path, content) to rows with ``file``, the path. Rows are kept under ``cache`` by the pass that decoded
    them, beside a manifest of every pass, so a pass reads the files that are new or whose size or time changed, and takes
    the others' rows from the passes that the manifest names; ``moved`` tells whether anything changed, for the steps
    behind. The manifest is written last: a pass that fails is done again. Nothing kept is rewritten.
    """
    held, last = _last(spark, cache)
    files = survey(spark, paths)
    now = files.join(held.withColumnsRenamed({"size": "__s", "modified": "__m"}), "path", "left")
    same = F.coalesce((F.col("size") == F.col("__s")) & (F.col("modified") == F.col("__m")), F.lit(False))
    no = last + 1
    manifest = now.select("path", "size", "modified", F.when(same, F.col("pass")).otherwise(no).cast("long").alias("pass"))
    manifest.write.mode("overwrite").parquet(f"{cache}/draft/at={no}")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{cache}/draft/at={no}")
    fresh = manifest.where(F.col("pass") == no).select("path")
    n_read, n_files = fresh.count(), manifest.count()
    n_gone = held.join(manifest, "path", "left_anti").count()
    if n_read:
        read = spark.read.format("binaryFile")
        if n_read <= NAMED_FILES and last:
            contents = read.load([r.path for r in fresh.collect()])
        else:
            contents = read.option("recursiveFileLookup", "true").load(paths).join(fresh, "path", "left_semi")
        decode(contents.select("path", "content")).write.mode("overwrite").parquet(f"{cache}/rows/pass={no}")
    if n_read or n_gone or not last:
        manifest.write.mode("overwrite").parquet(f"{cache}/manifest/at={no}")
    report = spark.createDataFrame([(n_files, n_read, n_files - n_read, n_gone, bool(n_read or n_gone))], "n_files long, n_read long, n_kept long, n_gone long, moved boolean")
    return rows_of(spark, cache), report


def rows_of(spark: SparkSession, cache: str) -> DataFrame:
    """The rows of the files that the last pass found, without looking at any file; only the passes that decoded them are read."""
    manifest, _ = _last(spark, cache)
    passes = [r[0] for r in manifest.select("pass").distinct().collect()]
    rows = spark.read.parquet(f"{cache}/rows")
    return rows.where(F.col("pass").isin(passes) if passes else F.lit(False)).join(manifest.select(F.col("path").alias("file"), F.col("pass")), ["file", "pass"]).drop("pass")


def skips(gate: Column, now: DataFrame, stamp: str = "seldom_stamp") -> Column:
    """Whether a step whose gate was ``gate`` has nothing to do, by one row of ``stamps``."""
    return F.coalesce(gate == F.lit(now.first()[stamp]), F.lit(False))
