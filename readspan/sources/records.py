"""Tagged tab-separated records: one text file of rows of several kinds, read and written by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.functions.text import NONE, escaped, read_optional, unescaped

# The fields of the rows of each tag, in the order they stand: sittings, books, highlights, notes, corrections,
# metadata, links, cleared books, ends, keys, counters, files, gates, watermark, reset floor and clocks.
LAYOUTS = {
    "s": "started_at timestamp_ntz, ended_at timestamp_ntz, end_position long, seconds long, page_turns long, words long, measure string, asin string, progress double, hours hours, "
    "start_counter_ms long, end_counter_ms long, start_words long, end_words long, tz_offset_s long, time_left long, stated_wpm long, awake_seconds long, paged_seconds long, paged_words long, "
    "timed_seconds long, timed_words long, covered double, stretches stretches",
    "b": "extent long, cde_key string, title string, author string, thumbnail string, language string, percent double, on_device int, cover string, location string, finished int, restart double, "
    "read_state int, cde_type string, kept int, identified_by string, timer_ms long, timer_words long, timer_covered double, restarted_on days",
    "a": "extent long, title string, kind string, at timestamp_ntz, state string, start long, end long, location long, page string, colour string, body string",
    "w": "written timestamp_ntz, edited timestamp_ntz, extent long, key string, state string, at timestamp_ntz, kind string, title string, location long, start long, from long, to long, words string, text string",
    "r": "edited timestamp_ntz, at timestamp_ntz, kind string, title string, location long, start long, was optional, text optional",
    "d": "edited timestamp_ntz, key string, extent long, field string, value optional, was optional",
    "l": "edited timestamp_ntz, linked string, type optional, first string, names optional",
    "c": "extent long, key string, at timestamp_ntz",
    "e": "end_position long, extent long",
    "k": "extent long, key string",
    "t": "end_position long, total_ms long, words long",
    "ep": "extent long, file string",
    "n": "len long, mtime long, sidecars long, dirs long, rules long",
    "g": "vocab_len long, vocab_mtime long, clips_len long, clips_mtime long, sidecars long, dirs long, record long, rules long",
    "m": "watermark string, offset_s long",
    "f": "reset_at string",
    "z": "epoch long, offset_s long",
}
# Columns whose absence is written -1.
ABSENT = {"a": ("start", "end", "location"), "w": ("location", "start", "from", "to"), "r": ("location", "start")}


def _fields(tag: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in LAYOUTS[tag].split(", ")]


def _read(field: Column, kind: str) -> Column:
    if kind == "optional":
        return F.when(field != "", read_optional(field))
    said = F.nullif(unescaped(field), F.lit(""))
    if kind == "hours":
        return hours(F.coalesce(field, F.lit("")))
    if kind == "stretches":
        return stretches(F.coalesce(field, F.lit("")))
    if kind == "days":
        parts = F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda x: F.trim(x).try_cast("long"))
        return F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: F.date_from_unix_date(x.cast("int")))
    return said.try_cast(kind) if kind == "string" else F.trim(said).try_cast(kind)


def decode(lines: DataFrame, tag: str, line: str = "value") -> DataFrame:
    """Rows of ``tag``: short rows leave their last columns null, unreadable values are null, further fields are ignored.

    Columns that are written -1 where they are absent are null. Lists are empty where nothing is said.
    """
    parts = F.split(F.col(line), "\t", -1)
    rows = lines.where(F.get(parts, F.lit(0)) == tag)
    out = rows.select(*(_read(F.get(parts, F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(_fields(tag), 1)))
    return out.withColumns({name: F.when(F.col(name) != -1, F.col(name)) for name in ABSENT.get(tag, ())})


def encode(rows: DataFrame, tag: str) -> DataFrame:
    """``value``: the line of each row; null is the empty field, times are ISO, shares have six places. Missing columns are null."""

    def text(name: str, kind: str) -> Column:
        c = F.col(name) if name in rows.columns else F.lit(None)
        if kind == "optional":
            return F.coalesce(escaped(c.cast("string")), F.lit(NONE))
        if kind == "timestamp_ntz":
            shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "double":
            shown = F.format_string("%.6f", c.cast("double"))
        elif kind == "hours":
            shown = F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["h"], x["s"])), ";") if name in rows.columns else F.lit("")
        elif kind == "stretches":
            at = lambda x: F.round(x * 10_000).cast("long")
            shown = F.array_join(F.transform(c, lambda x: F.concat_ws("-", at(x["from"]), at(x["to"]))), ",") if name in rows.columns else F.lit("")
        elif kind == "days":
            shown = F.array_join(F.transform(c, lambda x: F.unix_date(x).cast("string")), ";") if name in rows.columns else F.lit("")
        else:
            shown = escaped(c.cast("string"))
        return F.when(c.isNotNull(), shown).otherwise("-1" if name in ABSENT.get(tag, ()) else "")

    return rows.select(F.concat_ws("\t", F.lit(tag), *(text(n, k) for n, k in _fields(tag))).alias("value"))


def tables(lines: DataFrame, line: str = "value") -> dict[str, DataFrame]:
    """Every table of a record by its tag; rows of unknown tags are in none."""
    return {tag: decode(lines, tag, line) for tag in LAYOUTS}


def stretches(column: Column) -> Column:
    """``500-800,1000-1200``, hundredths of a per cent, as an array of from and to."""
    pairs = F.filter(F.split(column, ","), lambda x: x.rlike(r"^-?\d+-\d+$"))
    ends = lambda x, i: F.regexp_extract(x, r"^(-?\d+)-(\d+)$", i).cast("double") / 10_000
    return F.transform(pairs, lambda x: F.struct(ends(x, 1).alias("from"), ends(x, 2).alias("to")))


def hours(column: Column) -> Column:
    """``h:s;h:s`` as an array of hour and seconds."""
    pairs = F.filter(F.split(column, ";"), lambda x: x.rlike(r"^\d+:\d+$"))
    return F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("h"), F.substring_index(x, ":", -1).cast("long").alias("s")))


def whole(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: whether the closing row ``end\\t<n>`` counts the others right."""
    closing = F.regexp_extract(F.col(line), r"^end\t(\d+)$", 1).try_cast("long")
    counted = lines.agg(F.count_if(closing.isNull()).alias("n_rows"), F.max(closing).alias("said"))
    return counted.select("n_rows", F.coalesce(F.col("said") == F.col("n_rows"), F.lit(False)).alias("whole"))
