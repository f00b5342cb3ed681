"""Sessions of ordered events: gap, back-step and midnight breaks, dwell credit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import GAP, broken, dwell, intdiv, micros_between


def numbered(events: DataFrame, gap_s: int = GAP, user: str = "user_id", ts: str = "ts", order: str = "event_id", midnight: bool = False) -> DataFrame:
    """``events`` with ``session_no`` (from 1 in each user) and ``credit``, the dwell until the session's next event.

    One shuffle by user serves the break flags, the running number and the look-ahead.
    """
    w = Window.partitionBy(user).orderBy(ts, order)
    before = F.lag(ts).over(w)
    gap = micros_between(before, F.col(ts)) / 1_000_000
    cut = before.isNull() | broken(gap, gap_s)
    if midnight:
        cut = cut | (F.to_date(before) != F.to_date(ts))
    flagged = events.withColumn("__cut", cut.cast("long"))
    flagged = flagged.withColumn("session_no", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = F.when(F.lead("session_no").over(w) == F.col("session_no"), F.lead(ts).over(w))
    seconds = intdiv(micros_between(F.col(ts), nxt), 1_000_000)
    return flagged.withColumn("credit", F.coalesce(dwell(seconds), F.lit(0)).cast("long")).drop("__cut")


def sessions(events: DataFrame, gap_s: int = GAP, user: str = "user_id", ts: str = "ts", order: str = "event_id", midnight: bool = False) -> DataFrame:
    """One row a session: user, session_no, started_at, ended_at, n_events, seconds."""
    rows = numbered(events, gap_s, user, ts, order, midnight)
    return rows.groupBy(user, "session_no").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n_events"), F.sum("credit").alias("seconds")
    )


def midnight_parts(sittings: DataFrame, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """Each row once for every day it touches: ``day``, ``part_seconds`` (whole seconds of the day's part)."""
    days = F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day")
    rows = sittings.select("*", days)
    low = F.greatest(F.col(start), F.col("day").cast("timestamp_ntz"))
    high = F.least(F.col(end), F.date_add("day", 1).cast("timestamp_ntz"))
    return rows.withColumn("part_seconds", intdiv(micros_between(low, high), 1_000_000))


def owed_shares(sittings: DataFrame, gain: str, weight: str, group: list[str], order: list[str]) -> DataFrame:
    """Deal a late counter's ``gain`` over a group's sittings by ``weight``: truncated shares, the last takes the rest."""
    w = Window.partitionBy(*group)
    total = F.sum(weight).over(w)
    part = F.when(total > 0, intdiv(F.col(gain) * F.col(weight), F.when(total > 0, total).otherwise(1))).otherwise(F.lit(0).cast("long"))
    rows = sittings.withColumn("__part", part).withColumn("__last", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order))) == 1)
    rest = F.col(gain) - F.sum(F.when(~F.col("__last"), F.col("__part")).otherwise(0)).over(w)
    return rows.withColumn("owed", F.when(F.col("__last"), rest).otherwise(F.col("__part")).cast("long")).drop("__part", "__last")
