"""The read model: figures of books, days and spans over sittings.

``sittings``: device and the columns of ``streaming.sittings``, with ``book`` (null if unidentified) and ``extent``. A sitting
belongs to the day it started on. Sittings under the ``floor`` make a book known but add nothing to any figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions import scores
from readspan.functions.dates import second_of_day
from readspan.functions.scores import intdiv


def credited(sittings: DataFrame, app: bool = False, floor: int = 60, unidentified: bool = True) -> DataFrame:
    """``sittings`` with ``day``, ``read`` and ``read_words`` (by device or by app); ``counts`` tells those that figures take."""
    rows = sittings.withColumns({"day": F.to_date("started_at"), "read": scores.sitting_seconds(app), "read_words": scores.sitting_words(app)})
    known = F.col("book").isNotNull() if not unidentified else F.lit(True)
    return rows.withColumn("counts", (F.col("read") >= floor) & known)


def book_figures(rows: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """One row a book of ``credited`` sittings: sums by measure, days, sittings, and what its last sitting states."""
    on = F.col("counts")
    total = lambda c: F.coalesce(F.sum(F.when(on, c)), F.lit(0)).cast("long")
    of = lambda m: total(F.when(F.col("measure") == m, F.col("seconds")))
    when = F.struct("day", "ended_at")
    last = lambda c: F.max_by(c, F.when(on & F.col(c).isNotNull(), when))
    read = F.when(on, F.col("day"))
    paged = F.when(F.col("covered") > 0, F.col("paged_seconds"))
    return rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        total(F.col("read")).alias("seconds"), total(F.col("seconds")).alias("counted_seconds"), total(F.col("read_words")).alias("words"),
        *(of(m).alias(f"{m}_of_measure") for m in ("counted", "timed", "paged", "awake")),
        F.countDistinct(read).alias("days"), F.count_if(on).alias("sittings"), total(F.col("page_turns")).alias("page_turns"), F.min(read).alias("first_day"), F.max(read).alias("last_day"),
        F.max(F.when(on, F.struct(F.col("day"), second_of_day(F.col("ended_at")).alias("s")))).alias("put_down"), F.coalesce(F.sum(F.when(on, F.col("covered"))), F.lit(0.0)).alias("covered"),
        total(paged).alias("covered_seconds"), (last("progress") * 100).alias("progress"), last("time_left").alias("stated_time_left"), last("stated_wpm").alias("stated_wpm"),
    )


def rates(books: DataFrame) -> DataFrame:
    """Book figures with ``per_day``, ``per_sitting``, ``span_days`` and ``wpm``."""
    over = lambda n: F.when(F.col(n) > 0, intdiv(F.col("seconds"), F.greatest(n, F.lit(1)))).otherwise(0)
    span = F.greatest(F.datediff("last_day", "first_day") + 1, F.lit(1))
    return books.withColumns({"per_day": over("days"), "per_sitting": over("sittings"), "span_days": span, "wpm": scores.words_a_minute(F.col("words"), F.col("seconds"))})


def unidentified(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row: how many books without a name were read in a span of days, and for how long."""
    mine = rows.where(F.col("book").isNull() & F.col("counts") & F.col("day").between(first, last))
    return mine.agg(F.countDistinct("extent").alias("n_books"), F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("seconds"))


def book_count(rows: DataFrame) -> DataFrame:
    """One row: named books and unnamed ones that were read."""
    read = rows.where("counts")
    return read.agg(F.countDistinct("book").alias("named"), F.countDistinct(F.when(F.col("book").isNull(), F.col("extent"))).alias("unnamed"))


def day_figures(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """By day: seconds, page turns, the longest sitting, and books read."""
    return rows.where("counts").groupBy(*keys, "day").agg(
        F.sum("read").alias("seconds"), F.sum("page_turns").alias("page_turns"), F.max("read").alias("longest"), F.countDistinct("book").alias("n_books")
    )


def books_on(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The books of each day with their seconds and place, longest first, then by name."""
    sums = rows.where("counts and book is not null").groupBy(*keys, "day", "book").agg(F.sum("read").alias("seconds"))
    order = Window.partitionBy(*keys, "day").orderBy(F.desc("seconds"), "book")
    return sums.withColumn("place", F.row_number().over(order))


# ---------------------------------------------------------------- hours

_HOURS = "array<struct<h:int,s:bigint>>"


def spread_over(seconds: Column, start: Column, end: Column) -> Column:
    """``array<struct<h,s>>``: seconds over the clock hours between two seconds of a day, by overlap; the first hour takes what is left over."""
    hour = lambda at: F.least(F.greatest(intdiv(at, 3600), F.lit(0)), F.lit(23)).cast("int")
    span = end - start
    hours = F.sequence(intdiv(start, 3600), F.greatest(intdiv(end - 1, 3600), intdiv(start, 3600)))
    part = lambda h: intdiv(seconds * F.greatest(F.least(end, (h + 1) * 3600) - F.greatest(start, h * 3600), F.lit(0)), F.greatest(span, F.lit(1)))
    parts = F.transform(hours, lambda h: F.struct(hour(h * 3600).alias("h"), part(h).alias("s")))
    given = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["s"])
    whole = F.transform(parts, lambda x, i: F.struct(x["h"].alias("h"), (x["s"] + F.when(i == 0, seconds - given).otherwise(0)).alias("s")))
    whole = F.filter(whole, lambda x: x["s"] > 0)
    one = F.array(F.struct(hour(start).alias("h"), seconds.cast("long").alias("s")))
    return F.when(seconds <= 0, F.expr(f"cast(array() as {_HOURS})")).when(span <= 0, one).otherwise(whole)


def busiest(hours: Column) -> Column:
    """The place, from 0, of the hour with most seconds, the last of equals."""
    top = F.array_max(F.transform(hours, lambda x: x["s"]))
    places = F.transform(hours, lambda x, i: F.when(x["s"] == top, i))
    return F.array_max(places)


def hours_at(hours: Column, target: Column, start: Column, end: Column) -> Column:
    """``hours`` in proportion, so that they add up to ``target``: the busiest hour takes what is left over.

    Without hours the target is spread over the span; hours that add up to nothing or to the target stay as they are.
    """
    total = F.aggregate(hours, F.lit(0).cast("long"), lambda a, x: a + x["s"])
    scaled = F.filter(F.transform(hours, lambda x: F.struct(x["h"].cast("int").alias("h"), intdiv(x["s"] * target, F.greatest(total, F.lit(1))).alias("s"))), lambda x: x["s"] > 0)
    given = F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x["s"])
    filled = F.transform(scaled, lambda x, i: F.struct(x["h"].alias("h"), (x["s"] + F.when(i == busiest(scaled), target - given).otherwise(0)).alias("s")))
    first = F.array(F.struct(F.try_element_at(hours, F.lit(1))["h"].cast("int").alias("h"), target.cast("long").alias("s")))
    same = F.transform(hours, lambda x: F.struct(x["h"].cast("int").alias("h"), x["s"].cast("long").alias("s")))
    return (
        F.when(F.size(hours) <= 0, spread_over(target, start, end)).when((total <= 0) | (total == target), same)
        .when(F.size(scaled) == 0, first).otherwise(filled)
    )


def day_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (started_at, ended_at, hours of h and s) as blocks ``(…, from_s, to_s)`` of the day: each hour's part, clipped to the sitting."""
    blocks = rows.withColumn("b", F.explode("hours")).withColumns({"__s": second_of_day(F.col("started_at")), "__e": second_of_day(F.col("ended_at"))})
    low, high = F.greatest(F.col("b.h") * 3600, F.col("__s")), F.least((F.col("b.h") + 1) * 3600, F.greatest("__e", F.col("__s") + 1))
    return blocks.withColumns({"from_s": low.cast("long"), "to_s": F.least(low + F.col("b.s"), F.greatest(high, low)).cast("long")}).drop("b", "__s", "__e", "hours")


def hour_sums(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Seconds by ``keys`` and clock hour of rows with ``hours``."""
    return rows.select(*keys, F.explode("hours").alias("x")).groupBy(*keys, F.col("x.h").alias("hour")).agg(F.sum("x.s").alias("seconds"))


def hour_peak(rows: DataFrame) -> DataFrame:
    """One row: the most seconds that a clock hour of a day holds (rows of day and hours)."""
    return hour_sums(rows, ("day",)).agg(F.coalesce(F.max("seconds"), F.lit(0)).cast("long").alias("seconds"))


# ---------------------------------------------------------------- strips


def binned(days: DataFrame, first: Column, last: Column, grain: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(…, bin, seconds)``: day sums of a span by day, week or month, bins without reading too."""
    start = scores.span_start(F.col("day"), grain) if grain != "day" else F.col("day")
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[grain]
    from_ = scores.span_start(first, grain) if grain != "day" else first
    own = days.where(F.col("day").between(first, last)).groupBy(*keys, start.alias("bin")).agg(F.sum("seconds").alias("s"))
    who = days.select(*keys).distinct() if keys else days.sparkSession.range(1).select()
    spine = who.select(*keys, F.explode(F.sequence(from_, last, F.expr(f"interval {step}"))).alias("bin"))
    return spine.join(own, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("s", F.lit(0)).cast("long").alias("seconds"))


def finest(columns: dict[str, DataFrame], most: int) -> tuple[str, DataFrame]:
    """The first of the grains (each a table of columns) that has ``most`` columns at most, else the last."""
    for grain, rows in columns.items():
        if rows.limit(most + 1).count() <= most:
            return grain, rows
    return grain, rows
