"""Stamps, moments and durations as people write them. A stamp is a wall clock: no function reads the session's zone."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from readspan.functions.scores import intdiv

# Fixed value: the largest offset from UTC that a clock can have, in seconds.
FURTHEST = 14 * 3600


def iso(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def read_iso(text: Column) -> Column:
    """The moment an ISO stamp names; null if it names none. A text without a time is the start of its day."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)))
    time = F.when(text.rlike(r"^.{10}T\d{2}:\d{2}:\d{2}"), F.substring(text, 12, 8)).otherwise("00:00:00")
    return F.try_to_timestamp(F.concat(day, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def iso_of_log(stamp: Column) -> Column:
    """A log's ``YYMMDD:HHMMSS`` as an ISO stamp; null if it names no real moment."""
    shaped = F.when(stamp.rlike(r"^\d{6}:\d{6}$"), stamp)
    return iso(F.try_to_timestamp(F.concat(F.lit("20"), shaped), F.lit("yyyyMMdd:HHmmss")).cast("timestamp_ntz"))


def log_of_iso(text: Column) -> Column:
    """The inverse; null for a text that isn't shaped like an ISO stamp."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
    parts = F.concat(*(F.substring(text, at, 2) for at in (3, 6, 9)), F.lit(":"), *(F.substring(text, at, 2) for at in (12, 15, 18)))
    return F.when(shaped, parts)


def moved(ts: Column, seconds: Column) -> Column:
    """``ts`` on a clock that moved by ``seconds``."""
    return (ts + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz")


def second_of_day(ts: Column) -> Column:
    """Seconds since midnight; 0 for none."""
    return F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int"), F.lit(0)).cast("long")


def at_second(day: Column, seconds: Column) -> Column:
    """The moment ``seconds`` into a day."""
    return moved(day.cast("timestamp_ntz"), seconds)


def plausible(offset: Column) -> Column:
    """A whole number of minutes, 14 hours at most either way."""
    return (F.abs(offset) <= FURTHEST) & (offset % 60 == 0)


def _rounded(seconds: Column) -> tuple[Column, Column]:
    minutes = intdiv(seconds + 30, 60)
    return intdiv(minutes, 60), minutes % 60


def duration(seconds: Column) -> Column:
    """``2h 22m``, ``5m``, ``<1m`` under a minute, ``0m`` for nothing."""
    hours, minutes = _rounded(seconds)
    h, m = F.concat(hours.cast("string"), F.lit("h")), F.concat(minutes.cast("string"), F.lit("m"))
    return F.when(seconds <= 0, "0m").when(seconds < 60, "<1m").when(hours == 0, m).when(minutes == 0, h).otherwise(F.concat_ws(" ", h, m))


def duration_coarse(seconds: Column) -> Column:
    """Whole hours from a day on, else as ``duration``."""
    return F.when(seconds < 24 * 3600, duration(seconds)).otherwise(F.concat(intdiv(seconds + 1800, 3600).cast("string"), F.lit("h")))


def duration_tight(seconds: Column) -> Column:
    """``4h12``, ``37m``, a dot under a minute."""
    hours, minutes = _rounded(seconds)
    long = F.concat(hours.cast("string"), F.lit("h"), F.lpad(minutes.cast("string"), 2, "0"))
    return F.when(seconds < 60, "·").when(hours == 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(long)


def short_count(n: Column) -> Column:
    """``1.2M``, ``48k``, ``812``."""
    thousands = F.round(n / 1000).cast("long").cast("string")
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M"))).when(n >= 1000, F.concat(thousands, F.lit("k"))).otherwise(n.cast("string"))


def short_day(day: Column) -> Column:
    """``Aug 9``."""
    return F.date_format(day, "MMM d")


def year_day(day: Column) -> Column:
    """``Aug 9, 2026``."""
    return F.date_format(day, "MMM d, yyyy")


def long_day(day: Column) -> Column:
    """``Sun, 9 August 2026``."""
    return F.date_format(day, "EEE, d MMMM yyyy")


def month_name(day: Column) -> Column:
    """``August 2026``."""
    return F.date_format(day, "MMMM yyyy")


def numbered_day(day: Column) -> Column:
    """The form of languages that write year, month and day with their signs."""
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))


# Languages that dates are written in, and those of them that put the year first.
LANGUAGES, YEAR_FIRST = ("en", "de", "zh-CN", "zh-TW", "ja"), ("zh-CN", "zh-TW", "ja")


@cache
def _symbols(language: str) -> dict[str, list[str]]:
    """Names of months and days in ``language``, from the locale data of the JVM."""
    jvm = SparkSession.active()._jvm
    said = jvm.java.text.DateFormatSymbols.getInstance(jvm.java.util.Locale.forLanguageTag(language))
    return {"months": list(said.getMonths())[:12], "short": list(said.getShortMonths())[:12], "days": list(said.getShortWeekdays())[1:8]}


def day_in(day: Column, language: Column, form: str) -> Column:
    """A day in the ``language`` that each row names, null for others: ``short`` (Aug 9, 8月9日), ``year`` (Aug 9, 2026), ``long`` (Sun, 9 August 2026; 2026年8月9日 日) or ``month`` (August 2026)."""

    def one(code: str) -> Column:
        names = _symbols(code)
        of = lambda which, n: F.element_at(F.array(*map(F.lit, names[which])), n)
        month, short, d, y, weekday = of("months", F.month(day)), of("short", F.month(day)), F.dayofmonth(day).cast("string"), F.year(day).cast("string"), of("days", F.dayofweek(day))
        if code in YEAR_FIRST:
            written = {"short": ("{m}", "{d}日"), "year": ("{y}年", "{m}", "{d}日"), "long": ("{y}年", "{m}", "{d}日 ", "{w}"), "month": ("{y}年", "{m}")}[form]
            month = short
        else:
            written = {"short": ("{s} ", "{d}"), "year": ("{s} ", "{d}, ", "{y}"), "long": ("{w}, ", "{d} ", "{m} ", "{y}"), "month": ("{m} ", "{y}")}[form]
        value = {"m": month, "s": short, "d": d, "y": y, "w": weekday}
        return F.concat(*(F.concat(value[part[1]], F.lit(part[3:])) for part in written))

    out = F.lit(None).cast("string")
    for code in reversed(LANGUAGES):
        out = F.when(language == code, one(code)).otherwise(out)
    return out
