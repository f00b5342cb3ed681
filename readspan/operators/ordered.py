"""Places in a total order without one window over all rows: sorted ranges, counted once, and pages read by their ranges."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.operators.lineage import pinned

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33


def _ranged(rows: DataFrame, order: Sequence[Column], n: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``rows`` with ``__range`` and ``__row`` (from 0 in its range), and (range, rows before it, its rows) of each."""
    ranged = (rows.repartitionByRange(n, *order) if n else rows.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    held = pinned(ranged.withColumns({"__range": F.shiftright("__m", _ROW_BITS).cast("int"), "__row": F.col("__m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("__m"))
    counts = sorted(map(tuple, held.groupBy("__range").count().collect()))  # one row a range
    return held, [(r, at, n) for (r, n), at in zip(counts, accumulate((n for _, n in counts), initial=0))]  # noqa: B905  the last sum starts no range


def placed(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, the place of each in ``order`` from 0, without gaps.

    Sampled ranges of the order are sorted apart; a place is the rows of all ranges before it and those before it in its
    own. The driver sees one number a range. Rows that are equal in ``order`` come in any sequence.
    """
    held, ranges = _ranged(rows, order)
    if not ranges:
        return held.withColumn(name, F.col("__row")).drop("__range", "__row")
    starts = rows.sparkSession.createDataFrame([(r, at) for r, at, _ in ranges], "__range int, __at long")
    return held.join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") + F.col("__row")).select(*rows.columns, name)


def keep_listing(rows: DataFrame, order: Sequence[Column], path: str, n: int | None = None) -> None:
    """Write ``rows`` in ``order`` to ``path`` for ``page``: a folder a range with places in it, and ``path``_ranges with where each begins. ``n`` is the number of ranges; by default Spark chooses by size."""
    held, ranges = _ranged(rows, order, n)
    spark = rows.sparkSession
    starts = spark.createDataFrame(ranges, "range int, first long, n long")
    out = held.join(F.broadcast(starts.select(F.col("range").alias("__range"), F.col("first").alias("__at"))), "__range")
    out = out.select(*rows.columns, (F.col("__at") + F.col("__row")).alias("place"), F.col("__range").alias("range"))
    out.write.mode("overwrite").partitionBy("range").parquet(path)
    starts.coalesce(1).write.mode("overwrite").parquet(f"{path}_ranges")


def page(spark: SparkSession, path: str, no: int, size: int) -> DataFrame:
    """Page ``no`` (from 0) of ``size`` rows of a listing that ``keep_listing`` wrote, with ``place``. Only the folders of its ranges are read; a page past the end is empty."""
    lo, hi = no * size, (no + 1) * size
    ranges = [r.range for r in spark.read.parquet(f"{path}_ranges").where((F.col("first") < hi) & (F.col("first") + F.col("n") > lo)).select("range").collect()]
    rows = spark.read.parquet(path).where(F.col("range").isin(ranges) if ranges else F.lit(False))
    return rows.where((F.col("place") >= lo) & (F.col("place") < hi)).drop("range")
