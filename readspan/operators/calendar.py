"""Totals by calendar: days, folds, streaks, spans, bands and the all-time board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import BANDS, band, intdiv, span_start


def daily_totals(sittings: DataFrame, start: str = "started_at", seconds: str = "seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Seconds and sittings by the day a sitting began."""
    return sittings.groupBy(*keys, F.to_date(start).alias("day")).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n_sittings"))


def fold(sittings: DataFrame, part: Column, size: int, first: int = 0, seconds: str = "seconds") -> DataFrame:
    """``bucket``, ``seconds`` and ``n_days`` for all ``size`` buckets from ``first`` on, empty ones too."""
    spine = sittings.sparkSession.range(first, first + size).select(F.col("id").cast("int").alias("bucket"))
    sums = sittings.groupBy(part.cast("int").alias("bucket")).agg(F.sum(seconds).alias("s"), F.countDistinct(F.to_date("started_at")).alias("d"))
    return spine.join(F.broadcast(sums), "bucket", "left").select(  # one row a bucket
        "bucket", F.coalesce("s", F.lit(0)).cast("long").alias("seconds"), F.coalesce("d", F.lit(0)).cast("long").alias("n_days")
    )


def fullest(folded: DataFrame) -> DataFrame:
    """The bucket with most seconds, the last of equals; no row if all are empty."""
    return folded.where("seconds > 0").agg(F.max_by("bucket", F.struct("seconds", "bucket")).alias("bucket"), F.max("seconds").alias("seconds")).where("bucket is not null")


def weekday_occurrences(days: DataFrame, day: str = "day") -> DataFrame:
    """How often each weekday (Monday 0) comes in the days from the first to the last."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("d")).groupBy(F.weekday("d").alias("bucket")).agg(F.count("*").alias("occurrences"))


def islands(days: DataFrame, keys: tuple[str, ...] = (), day: str = "day") -> DataFrame:
    """Runs of consecutive days: first_day, last_day, n_days."""
    distinct = days.select(*keys, F.col(day).alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")
    runs = distinct.withColumn("grp", F.date_sub("day", F.row_number().over(w)))
    return runs.groupBy(*keys, "grp").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("grp")


def streaks(days: DataFrame, today: Column, keys: tuple[str, ...] = (), day: str = "day") -> DataFrame:
    """Longest run and the current one, which counts if it ends on ``today`` or the day before."""
    runs = islands(days, keys, day)
    live = F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("n_days"))
    return runs.groupBy(*keys).agg(F.max("n_days").alias("longest"), F.coalesce(F.max(live), F.lit(0)).cast("long").alias("current"))


def week_runs(days: DataFrame, now: Column, keys: tuple[str, ...] = (), day: str = "day") -> DataFrame:
    """Weeks in a row with reading, back from now; an empty week that is still going on does not end the run."""
    weeks = days.select(*keys, F.datediff(span_start(F.col(day), "week"), F.lit("1970-01-05").cast("date")).alias("d"))
    weeks = weeks.select(*keys, intdiv(F.col("d"), 7).alias("week")).distinct()
    w = Window.partitionBy(*keys).orderBy("week") if keys else Window.partitionBy(F.lit(0)).orderBy("week")
    runs = weeks.withColumn("grp", F.col("week") - F.row_number().over(w)).groupBy(*keys, "grp").agg(F.max("week").alias("last"), F.count("*").alias("n"))
    this = intdiv(F.datediff(span_start(now, "week"), F.lit("1970-01-05").cast("date")), 7)
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("last") >= this - 1, F.col("n"))), F.lit(0)).cast("long").alias("weeks"))


def span_tally(sittings: DataFrame, span: str, item: str) -> DataFrame:
    """Seconds, days, sittings, items and seconds a day for each week, month or year."""
    day = F.to_date("started_at")
    out = sittings.groupBy(span_start(day, span).alias("span")).agg(
        F.sum("seconds").alias("seconds"), F.countDistinct(day).alias("n_days"), F.count("*").alias("n_sittings"), F.countDistinct(item).alias("n_items")
    )
    return out.withColumn("per_day", intdiv(F.col("seconds"), F.col("n_days")))


def bands(sittings: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Histogram of sitting lengths in five-minute bands, the last one open; every band has a row."""
    spine = sittings.sparkSession.range(BANDS).select(F.col("id").cast("int").alias("band"))
    counts = sittings.groupBy(band(F.col(seconds)).alias("band")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n_sittings"))


def board(sittings: DataFrame, item: str, today: Column) -> DataFrame:
    """The all-time figures, one row."""
    days = daily_totals(sittings)
    run = streaks(days, today)
    tops = days.agg(F.max_by("day", F.struct("seconds", "day")).alias("busiest_day"), F.max("seconds").alias("busiest_seconds"), F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    totals = sittings.agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n_sittings"), F.countDistinct(item).alias("n_items"), F.max("seconds").alias("longest_seconds"))
    one = totals.crossJoin(F.broadcast(tops)).crossJoin(F.broadcast(run))  # one row each
    return one.select("*", intdiv(F.col("seconds"), F.col("n_days")).alias("per_day"), intdiv(F.col("seconds"), F.col("n_sittings")).alias("per_sitting"))
