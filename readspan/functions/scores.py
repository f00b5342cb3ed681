"""Dates, durations, credits and shares as Column expressions. Integer division truncates, percentages round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page dwell floor and cap, break gap and clock step in seconds, band width and count, intensity steps.
PAGE_FLOOR, PAGE_CAP = 3, 120
GAP, BACK_STEP = 1800, 60
# Words a minute from which a page that the counter refused still counts.
RATE = 40
BAND, BANDS = 300, 25
INTENSITY = (0.15, 0.4, 0.66)


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def page_rate(words: Column, standing_ms: Column) -> Column:
    """Words a minute; null if the page didn't stand."""
    return F.try_divide(words * 60_000.0, standing_ms)


def credits(total_ms: Column, interval_ms: Column, interval_words: Column, refused: Column, closes: Column) -> Column:
    """``struct<counted_ms,counted_words,refused_ms>``: what the page that a line turned adds.

    The counter takes a page unless the line refuses it or closes the book; such a page counts apart if it was read at
    RATE or faster. Without a counter or an interval there is nothing.
    """
    words = F.greatest(F.coalesce(interval_words, F.lit(0)), F.lit(0)).cast("long")
    states = (F.coalesce(interval_ms, F.lit(0)) > 0) & total_ms.isNotNull()
    kept = F.coalesce(refused, F.lit(False)) | F.coalesce(closes, F.lit(False))
    zero = F.lit(0).cast("long")
    return F.struct(
        F.when(states & ~kept, interval_ms).otherwise(zero).alias("counted_ms"),
        F.when(states & ~kept, words).otherwise(zero).alias("counted_words"),
        F.when(states & kept & (page_rate(words, interval_ms) >= RATE), interval_ms).otherwise(zero).alias("refused_ms"),
    )


def timed_ms(credit: Column) -> Column:
    return credit["counted_ms"] + credit["refused_ms"]


def dwell(seconds: Column) -> Column:
    """A page's credit: nothing under the floor, the cap at most."""
    return F.when(seconds.isNull() | (seconds < PAGE_FLOOR), F.lit(0)).otherwise(F.least(seconds, F.lit(PAGE_CAP))).cast("long")


def broken(gap_s: Column, limit: int = GAP, back: int = BACK_STEP) -> Column:
    """The clock moved on by more than ``limit`` or back by more than ``back`` seconds."""
    return (gap_s > limit) | (gap_s < -back)


def intdiv(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), b.cast("long"))


def share(advance: Column, before: Column, elapsed: Column) -> Column:
    """The part of ``advance`` that ``before`` of ``elapsed`` takes, truncated; nothing if no time went by."""
    inside = F.least(F.greatest(before, F.lit(0)), elapsed)
    return F.when(elapsed > 0, intdiv(advance * inside, F.when(elapsed > 0, elapsed).otherwise(1))).otherwise(F.lit(0).cast("long"))


def even_part(total: Column, parts: Column, at: Column) -> Column:
    """The ``at``-th of ``parts`` whole parts of ``total``; the first ones take what is left over."""
    return intdiv(total, parts) + (at < total % parts).cast("long")


def whole_percent(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def intensity(value: Column, peak: Column) -> Column:
    """0 without value, else 1 to 4 by the share of the peak."""
    ratio = value / peak
    out = F.when(value <= 0, 0)
    for level, step in enumerate(INTENSITY, 1):
        out = out.when(ratio < step, level)
    return out.otherwise(len(INTENSITY) + 1)


def band(seconds: Column) -> Column:
    return F.least(F.greatest(intdiv(seconds, BAND), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def duration(seconds: Column) -> Column:
    """``2h 22m``, ``5m``, ``<1m`` or ``0m``, rounded to the minute."""
    minutes = intdiv(seconds + 30, 60)
    hours, rest = intdiv(minutes, 60), minutes % 60
    return (
        F.when(seconds == 0, "0m")
        .when(minutes == 0, "<1m")
        .when(hours == 0, F.concat(rest.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
    )


def span_start(day: Column, span: str) -> Column:
    """First day of the week (Monday), month or year that holds ``day``."""
    return F.date_sub(day, F.weekday(day)) if span == "week" else F.trunc(day, span)


def span_end(day: Column, span: str) -> Column:
    if span == "week":
        return F.date_add(span_start(day, span), 6)
    return F.last_day(day) if span == "month" else F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1)


def sunday_week(day: Column) -> tuple[Column, Column]:
    """Year and number of the week that starts on a Sunday; its fourth day gives the year, week 1 holds 4 January."""
    start = lambda d: F.date_sub(d, (F.weekday(d) + 1) % 7)
    first = start(day)
    year = F.year(F.date_add(first, 3))
    january = F.make_date(year, F.lit(1), F.lit(4))
    return year, intdiv(F.datediff(first, start(january)), 7).cast("int") + 1


# ---------------------------------------------------------------- figures of a sitting and a book

# Fixed value: per cent from which a book counts as read through.
READ_THROUGH = 99.5


def share_of(start: Column, end: Column, extent: Column) -> Column:
    """The part of a book that a page's own span covers; nothing where a place or the extent isn't stated."""
    sized = F.coalesce((extent > 0) & (start >= 0) & (end >= 0), F.lit(False))
    return F.when(sized, F.try_divide(F.abs(end - start).cast("double"), extent)).otherwise(0.0)


def reaches(measured: Column, counted: Column) -> Column:
    return (measured > 0) & (measured >= counted)


def by_pages(counted: Column, timed: Column, paged: Column, timed_seconds: Column, paged_seconds: Column, seconds: Column) -> Column:
    """``timed`` or ``paged``, the first whose seconds reach the counted ones, else ``counted``."""
    return F.when(reaches(timed_seconds, seconds), timed).when(reaches(paged_seconds, seconds), paged).otherwise(counted)


def sitting_seconds(app: bool) -> Column:
    """The seconds of a row of ``streaming.sittings``: what the device counted, or, for ``app``, what its pages state."""
    seconds, timed, paged = F.col("seconds"), F.col("timed_seconds"), F.col("paged_seconds")
    return by_pages(seconds, timed, paged, timed, paged, seconds) if app else seconds


def sitting_words(app: bool) -> Column:
    """The words beside ``sitting_seconds``, at least the counted ones."""
    words = F.col("words")
    if not app:
        return words
    return by_pages(words, F.greatest("timed_words", words), F.greatest("paged_words", words), F.col("timed_seconds"), F.col("paged_seconds"), F.col("seconds"))


def time_left(finished: Column, percent: Column, read: Column, covered: Column, stated: Column | None = None) -> Column:
    """Seconds left of a book: none if finished, what the device stated, else its rate over the share covered times the share ahead, truncated."""
    projects = (percent >= 0.5) & (percent < READ_THROUGH) & (covered > 0) & (read > 0)
    projected = F.when(projects, F.try_divide(read * ((100.0 - percent) / 100.0), covered).cast("long"))
    return F.when(finished, F.lit(0).cast("long")).otherwise(projected if stated is None else F.coalesce(stated, projected))


def words_a_minute(words: Column, seconds: Column, stated: Column | None = None) -> Column:
    """The stated rate, else words over seconds; null without both."""
    rate = F.when((words > 0) & (seconds > 0), intdiv(words * 60, F.greatest(seconds, F.lit(1))))
    return rate if stated is None else F.coalesce(stated, rate)


def times_finished(restarted_on: Column, finished: Column) -> Column:
    """Readings that were banked, and the one that stands."""
    return (F.coalesce(F.size(restarted_on), F.lit(0)) + F.coalesce(finished, F.lit(False)).cast("int")).cast("long")


def read_through(percent: Column) -> Column:
    return F.coalesce(percent >= READ_THROUGH, F.lit(False))


def can_restart(percent: Column, finished: Column) -> Column:
    return F.coalesce(finished | (whole_percent(percent) > 0), F.lit(False))


def through(start: Column, extent: Column) -> Column:
    """Where in a book a place is, 0 to 1; null if either isn't stated."""
    return F.when((start >= 0) & (extent > 0), F.try_divide(start.cast("double"), extent))
