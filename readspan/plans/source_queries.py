"""Queries that write the tables as log lines, clippings and records and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.functions import logline
from readspan.sources import clippings, logs, records
from readspan.streaming import sittings as stream
from readspan.plans.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as page-turn lines: a user is a device, the book is 1000 plus the kind's first letter, the counter is the clock."""
    book = (F.ascii("event_type") + 1000).cast("string")
    secs = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    line = F.concat(
        logline.log_stamp(F.col("ts")), F.lit(" cvm[1]: I ReadingTimerController:Information::NextPage,Verdict:Processed,IntervalTime:785,TotalTime:"), (secs % 100000 * 1000).cast("string"),
        F.lit(",TotalWords:"), F.col("event_id").cast("string"), F.lit(",EndPos:HTMLPosition:"), book, F.lit(",%Left:0.25;"),
    )
    return table(spark, d, "events").select(F.col("user_id").alias("device"), line.alias("line"))


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return logs.observations(logs.kept(_lines(spark, d))).select("device", "ts", "position", "total_ms", "words", "interval_ms", "page_turn", "left_share")


def log_sittings(spark: SparkSession, d: str) -> DataFrame:
    return stream.sittings(logs.observations(_lines(spark, d))).select("device", "started_at", "ended_at", "end_position", "seconds", "page_turns", "measure")


def clippings_parse(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    block = F.concat(
        F.lit("Book "), F.col("conv_id").cast("string"), F.lit(" (A. Writer)\n- Your "), F.when(F.col("role") == "user", "Highlight").otherwise("Note"), F.lit(" on page "), (F.col("turn") + 1).cast("string"),
        F.lit(" | Location "), (F.col("turn") * 10 + 3).cast("string"), F.lit("-"), (F.col("turn") * 10 + 9).cast("string"), F.lit(" | Added on Wednesday, June 24, 2026 10:15:01 PM\n\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n"),
    )
    return clippings.parse_blocks(turns.select("conv_id", "turn", block.alias("block"))).select("conv_id", "turn", "title", "author", "kind", "page", "start", "end", "at", "body")


def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("extent"), F.col("p_brand").alias("cde_key"), F.concat("p_name", F.lit("\tx\\")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit("").alias("thumbnail"),
        F.col("p_type").alias("language"), F.bround(F.col("p_retailprice") / 100, 6).alias("percent"), (F.col("p_size") % 2).alias("on_device"),
    )
    return records.decode(records.encode(rows, "b"), "b").select("extent", "cde_key", "title", "author", "language", "on_device", F.bround("percent", 3).alias("percent"))


QUERIES = {f.__name__: f for f in (log_parse, log_sittings, clippings_parse, record_round_trip)}

_OBS = """o as (select user_id as device, date_trunc('second', ts) as ts, cast(1000 + ascii(event_type) as bigint) as position, cast(epoch(date_trunc('second', ts)) as bigint) % 100000 * 1000 as total_ms, event_id as words,
  strftime(ts, '%y%m%d:%H%M%S') || event_id as ord from events)"""
ORACLES = {
    "log_parse": f"with {_OBS} select device, ts, position, total_ms, words, cast(785 as bigint) as interval_ms, true as page_turn, cast(0.25 as double) as left_share from o",
    "log_sittings": f"""with {_OBS}, n as (select *, lag(ts) over w as pts, lag(position) over w as pb, lag(total_ms) over w as pt from o window w as (partition by device order by ord)),
      h as (select *, case when pts is null or pb <> position or epoch(ts) - epoch(pts) > 1800 then 'line' when cast(ts as date) <> cast(pts as date) then 'midnight' end as how, epoch(ts) - epoch(pts) as el, epoch(date_trunc('day', ts)) - epoch(pts) as be from n),
      k as (select *, cast(sum(case when how is null then 0 else 1 end) over (partition by device order by ord rows unbounded preceding) as bigint) as no, case when how = 'line' then 0 else 785 end as credit,
        case when how = 'midnight' then pt + case when total_ms > pt then (total_ms - pt) * cast(be as bigint) // cast(el as bigint) else 0 end end as cut, case when how = 'midnight' then 785 * cast(be as bigint) // cast(el as bigint) end as cut_t from h),
      s as (select device, no, any_value(position) as end_position, any_value(how) as how, min(ts) as a, max(ts) as b, count(*) as page_turns, min(total_ms) as lo, max(total_ms) as hi, max(cut) as cut, max(cut_t) as cut_t, sum(credit) as credit from k group by device, no),
      t as (select *, lead(how) over v as nh, lead(cut) over v as nc, lead(cut_t) over v as nt from s window v as (partition by device order by no)),
      u as (select *, (greatest(hi, case when nh = 'midnight' then nc end) - least(lo, case when how = 'midnight' then cut end)) // 1000 as counted, cast((credit - coalesce(case when how = 'midnight' then cut_t end, 0) + coalesce(case when nh = 'midnight' then nt end, 0)) as bigint) // 1000 as timed from t)
      select device, case when how = 'midnight' then date_trunc('day', a) else a end as started_at, case when nh = 'midnight' then date_trunc('day', b) + interval 1 day - interval 1 second else b end as ended_at, end_position,
        cast(case when counted > 0 then counted else timed end as bigint) as seconds, page_turns, case when counted > 0 then 'counted' else 'timed' end as measure from u where counted > 0 or timed > 0""",
    "clippings_parse": """select conv_id, turn, 'Book ' || conv_id as title, 'A. Writer' as author, case when role = 'user' then 'highlight' else 'note' end as kind, cast(turn + 1 as varchar) as page, turn * 10 + 3 as start, turn * 10 + 9 as "end",
        timestamp '2026-06-24 22:15:01' as at, trim(replace(text, chr(10), ' ')) as body from conversations""",
    "record_round_trip": r"select p_partkey as extent, p_brand as cde_key, p_name || chr(9) || 'x\' as title, cast(null as varchar) as author, p_type as language, cast(p_size % 2 as int) as on_device, round_even(p_retailprice / 100, 3) as percent from part",
}
