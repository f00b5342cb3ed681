"""Late data: clocks that step back, parses of a whole log over sittings held, and merges of two records' sittings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: seconds by which a clock must step back to move a watermark.
CLOCK_STEP = 60
#: Figures that a fuller parse restates whatever they were, and those that it only fills or changes where it states them.
RESTATED = ("seconds", "page_turns", "words", "measure", "timed_seconds", "timed_words", "awake_seconds", "paged_seconds", "paged_words", "covered")
FILLED = ("start_counter_ms", "end_counter_ms", "start_words", "end_words", "content_key", "progress", "time_left", "stated_wpm")
CLOSING = ("content_key", "progress", "time_left", "stated_wpm")


def follow_clock(state: DataFrame, clocks: DataFrame, device: str = "device") -> DataFrame:
    """``state`` (device, watermark, reset_at, clock_offset) on the clocks that ``clocks`` (device, offset) names.

    A clock that stepped back by CLOCK_STEP seconds or more takes the watermark and the reset floor back with it; a step
    forward moves neither. ``moved`` is the seconds they moved. Null stamps and devices without a clock stay as they are.
    """
    back = F.col("clock_offset") - F.col("offset")
    rows = state.join(clocks.groupBy(device).agg(F.max("offset").alias("offset")), device, "left").withColumn("moved", F.when(back >= CLOCK_STEP, back).otherwise(0))
    earlier = lambda c: (F.col(c) - F.make_dt_interval(secs=F.col("moved"))).cast("timestamp_ntz").alias(c)
    return rows.select(device, earlier("watermark"), earlier("reset_at"), F.coalesce("offset", "clock_offset").alias("clock_offset"), F.col("moved").cast("long").alias("moved"))


def _first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _remeasured(c: str, have: list[str]):
    h, f = F.col(f"h.{c}"), F.col(f"f.{c}")
    if c == "started_at":
        return F.least(h, f).alias(c)
    if c == "ended_at":
        return F.greatest(h, f).alias(c)
    if c in RESTATED:
        return F.when(F.col("f").isNotNull(), f).otherwise(h).alias(c)
    if c == "stretches":
        return F.when(F.size(f) > 0, f).otherwise(h).alias(c)
    return F.coalesce(f, h).alias(c) if c in FILLED else h.alias(c)


def heal(held: DataFrame, whole: DataFrame, device: str = "device") -> DataFrame:
    """``held`` sittings corrected by a parse of the whole log; ``change`` is same, healed or added.

    A fresh sitting corrects the held one of its book that starts with it, else the one that closes with it; other fresh
    ones are added, other held ones stay. Starts only move back and ends on, what the parse doesn't state is kept.
    """
    columns = held.columns
    keys = [device, "end_position"]
    h = held.select(*keys, F.struct(*columns).alias("h"), F.col("started_at").alias("s"), F.col("ended_at").alias("e"), F.monotonically_increasing_id().alias("no"))
    f = whole.select(*keys, F.struct(*[c for c in columns if c in whole.columns]).alias("f"), F.col("started_at").alias("s"), F.col("ended_at").alias("e"))
    by_start = _first_of(h, [*keys, "s"], "no").select(*keys, "s", F.col("no").alias("at_start"))
    by_end = _first_of(h, [*keys, "e"], "no").select(*keys, "e", F.col("no").alias("at_end"))
    f = f.join(by_start, [*keys, "s"], "left").join(by_end, [*keys, "e"], "left").withColumn("no", F.coalesce("at_start", "at_end"))
    corrections = _first_of(f.where("no is not null"), ["no"], F.col("at_start").isNull(), F.col("s")).select("no", "f")
    out = h.join(corrections, "no", "left").select("h", *(_remeasured(c, columns) for c in columns))
    same = F.struct(*columns).eqNullSafe(F.col("h"))
    kept = out.withColumn("change", F.when(same, "same").otherwise("healed")).drop("h")
    added = f.where("no is null").select("f.*").withColumn("change", F.lit("added"))
    return kept.unionByName(added, allowMissingColumns=True)


def rebuild(held: DataFrame, whole: DataFrame, device: str = "device") -> DataFrame:
    """``held`` with the rows that a parse of the whole log restates replaced by it; held rows that the log has no more stay."""
    keys = [device, "end_position", "ended_at"]
    starts = whole.groupBy(*keys).agg(F.min("started_at").alias("opened"))
    moved = held.join(starts, keys, "left").withColumn("started_at", F.least("started_at", "opened")).drop("opened")
    left = moved.join(whole.select(*keys, "started_at").distinct(), [*keys, "started_at"], "left_anti").select(held.columns)
    return merge_sittings(left, whole.select([c for c in held.columns if c in whole.columns]), device)


def merge_sittings(held: DataFrame, other: DataFrame, device: str = "device") -> DataFrame:
    """The sittings of two records: one a book and close, one a book and start.

    Of rows that close together, an earlier start restates the held figures and a later one only fills what the close
    leaves open; of rows that start together the last close stays.
    """
    columns = held.columns
    both = held.withColumn("__other", F.lit(0)).unionByName(other.select([c for c in columns if c in other.columns]).withColumn("__other", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(device, "end_position", "ended_at").orderBy("started_at", "__other")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({c: F.coalesce(F.col(c), F.first(c, True).over(whole)) for c in CLOSING if c in columns}).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return _first_of(both, [device, "end_position", "started_at"], F.desc("ended_at")).select(columns)
