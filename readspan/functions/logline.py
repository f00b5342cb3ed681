"""Fields of device log lines as Column expressions; what a line doesn't state is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark the three families of lines worth keeping.
TIMER = "ReadingTimerController"
METRICS = {
    "open": "SchemaName[ereader_open_book]",
    "close": "SchemaName[ereader_close_book]",
    "page": "SchemaName[ereader_book_consume_content]",
    "linear": "SchemaName[ereader_book_linear_page_actions]",
    "turn": "SchemaName[ereader_book_page_turn]",
    "latency": "SchemaName[ereader_reader_latency_ops]",
}
POWER_CHANGE = "SchemaName[ereader_powerd_state_change]"
POWER_ON = "lipc:evts:name=outOfScreenSaver, origin=com.lab126.powerd"
POWER_OFF = ("lipc:evts:name=goingToScreenSaver, origin=com.lab126.powerd", "lipc:evts:name=suspending, origin=com.lab126.powerd")
#: Lines are cut at so many characters.
LINE_CAP = 65_536

#: A position's value runs up to a comma or semicolon; it is the last number in it, which stands first or after a colon or blank.
_POSITION = r"[^:,;]*Position:(?:[^,;]*[: ])?(\d+)[^\d,;]*(?=[,;]|$)"


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stamp(line: Column) -> Column:
    """``YYMMDD:HHMMSS`` at the start of a line as a timestamp; null if it names no real time."""
    text = F.when(line.rlike(r"^\d{6}:\d{6}"), F.left(line, F.lit(13)))
    return F.try_to_timestamp(F.concat(F.lit("20"), text), F.lit("yyyyMMdd:HHmmss")).cast("timestamp_ntz")


def log_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyMMdd:HHmmss")


def family(line: Column) -> Column:
    """``timer``, ``power``, ``metric`` or null."""
    power = line.contains(POWER_CHANGE) | line.contains(POWER_ON)
    for mark in POWER_OFF:
        power = power | line.contains(mark)
    metric = F.lit(False)
    for mark in METRICS.values():
        metric = metric | line.contains(mark)
    return F.when(line.contains(TIMER), "timer").when(power, "power").when(metric, "metric")


def number(payload: Column, name: str) -> Column:
    """An integer field ``name:`` that starts a payload or follows a comma or colon."""
    return F.regexp_extract(payload, rf"(?:^|[,:]){name}:(\d+)", 1).try_cast("long")


def ahead(payload: Column) -> Column:
    """What stands before the chapter group."""
    return F.substring_index(payload, "NextTOCEntry", 1)


def share_left(payload: Column) -> Column:
    """The share of the book that lies ahead, 0 to 1: the first that the payload states."""
    left = F.regexp_extract(payload, r"%Left:([0-9.-]+)", 1).try_cast("double")
    return F.when(left.between(0, 1), left)


def seconds_left(payload: Column) -> Column:
    """The book's own time left; the one inside the chapter group is the chapter's."""
    return number(ahead(payload), "NewTimeLeft")


def words_a_minute(payload: Column) -> Column:
    rate = number(payload, "TotalWPM")
    return F.when(rate > 0, rate)


def payloads(line: Column) -> Column:
    """The non-empty parts, ended by semicolons, after ``Information::``."""
    return F.filter(F.split(F.regexp_extract(line, r"(?s)Information::(.*)", 1), ";"), lambda x: F.trim(x) != "")


def last_event(payload: Column) -> Column:
    """The payload from its last ``PageStartPos`` on: the tail of an earlier event isn't this one's."""
    last = F.regexp_extract(payload, r"(?s)^.*(?:^|[,:])(PageStartPos:.*)$", 1)
    return F.when(last != "", last).otherwise(payload)


def end_position(payload: Column) -> Column:
    """The book's end: the last ``EndPos`` ahead of the chapter group, or the first if there is no such group."""
    ends = F.regexp_extract_all(ahead(payload), F.lit(r"(?:^|[,:])EndPos:" + _POSITION), F.lit(1))
    return F.when(payload.contains("NextTOCEntry"), F.try_element_at(ends, F.lit(-1))).otherwise(F.try_element_at(ends, F.lit(1))).try_cast("long")


def chapter_positions(payload: Column) -> Column:
    """Every place that a payload names as a next chapter."""
    found = F.regexp_extract_all(payload, F.lit(r"NextTOCEntryPosition:" + _POSITION), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("long"))


def from_book(line: Column) -> Column:
    """The book's extent that an opened book states; a position of the ``HTML`` kind is one less than the extent."""
    kind = F.regexp_extract(line, r"BookEndPosition\.FromBook:([^:,;]*Position):", 1)
    at = F.regexp_extract(line, r"BookEndPosition\.FromBook:" + _POSITION, 1).try_cast("long")
    return at + (kind == "HTMLPosition").cast("long")


def names(line: Column, event: str) -> Column:
    return line.rlike(rf"[:;]{event}(?:[,;]|$)")


def quoted(line: Column, name: str) -> Column:
    return _none_if_empty(F.regexp_extract(line, rf'"{name}" : "([^"]*)"', 1))


def quoted_number(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf'"{name}" : (-?\d+)', 1).try_cast("long")


def opened_at(line: Column) -> Column:
    """Counter in ms that an opened book states; a stored ``null`` is zero."""
    said = F.regexp_replace(F.regexp_extract(line, r"StoredBookData:TimeRead:([\d,]+)", 1), ",", "").try_cast("long")
    return F.when(line.contains("StoredBookData:null"), F.lit(0).cast("long")).otherwise(said * 1000)


def wakes(line: Column) -> Column:
    """Reading resumed for a reason that has bit 2 or 8."""
    reason = F.regexp_extract(line, r"Reading_Resumed,Reason:(\d+)", 1).try_cast("long")
    return F.coalesce(reason.bitwiseAND(10) != 0, F.lit(False))


def metric(line: Column) -> Column:
    """``struct<kind,words,start,end>`` of a page, forward, back or close metric."""
    action = quoted(line, "action_id")
    acts = line.contains(METRICS["linear"]) | line.contains(METRICS["turn"])
    kind = (
        F.when(line.contains(METRICS["page"]), "page").when(line.contains(METRICS["close"]), "close")
        .when(acts & action.startswith("Next"), "forward").when(acts & action.startswith("Prev"), "back")
    )
    return F.struct(kind.alias("kind"), F.coalesce(quoted_number(line, "words_count"), F.lit(0)).alias("words"), quoted_number(line, "start_position").alias("start"), quoted_number(line, "end_position").alias("end"))


def content_key(line: Column) -> Column:
    return F.nullif(quoted(line, "cde_key"), F.lit("N/A"))


def power(line: Column) -> Column:
    """``active`` or ``idle`` after a power line."""
    on, off = quoted(line, "curr_state") == "ACTIVE", quoted(line, "prev_state") == "ACTIVE"
    asleep = line.contains(POWER_OFF[0]) | line.contains(POWER_OFF[1])
    return F.when(line.contains(POWER_CHANGE), F.when(on, "active").when(off, "idle")).when(line.contains(POWER_ON), "active").when(asleep, "idle")
