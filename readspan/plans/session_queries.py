"""Queries over sessions of ``events``: a user reads, an event is a page, ``props.k`` its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readspan.functions.scores import intdiv, intensity
from readspan.operators import calendar, intervals, sessions
from readspan.plans.tables import table

TODAY = "2024-01-30"
SIX_HOURS, DAY = 6 * 3600, 24 * 3600


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


def _sittings(spark: SparkSession, d: str, gap: int = DAY) -> DataFrame:
    return sessions.sessions(_events(spark, d), gap)


def _today() -> Column:
    return F.lit(TODAY).cast("date")


# The sessioniser in SQL: break flags by lag, running number by sum, credit by lead.
def _numbered_sql(gap: int, midnight: bool = False) -> str:
    cut = " or cast(ts as date) <> cast(p as date)" if midnight else ""
    return f"""
      a as (select event_id, ts, user_id, event_type, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
      b as (select *, case when p is null or epoch_us(ts) - epoch_us(p) > {gap}000000 or epoch_us(ts) - epoch_us(p) < -60000000{cut} then 1 else 0 end as c from a),
      n as (select *, cast(sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session_no from b),
      l as (select *, case when lead(session_no) over w = session_no then (epoch_us(lead(ts) over w) - epoch_us(ts)) // 1000000 end as s
            from n window w as (partition by user_id order by ts, event_id)),
      k as (select *, cast(case when s is null or s < 3 then 0 else least(s, 120) end as bigint) as credit from l),
      sit as (select user_id, session_no, min(ts) as started_at, max(ts) as ended_at, count(*) as n_events, cast(sum(credit) as bigint) as seconds from k group by 1, 2)"""


_SIT = "with " + _numbered_sql(DAY)


def sessions_gap(spark: SparkSession, d: str) -> DataFrame:
    return _sittings(spark, d, 1800)


def sessions_gap_6h(spark: SparkSession, d: str) -> DataFrame:
    return _sittings(spark, d, SIX_HOURS)


def sessions_midnight_cut(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(_events(spark, d), DAY, midnight=True)


def midnight_parts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.midnight_parts(_sittings(spark, d)).select("user_id", "session_no", "day", "part_seconds")


def session_window_counts(spark: SparkSession, d: str) -> DataFrame:
    w = F.session_window("ts", "6 hours")
    out = table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("started_at"), "n_events")


def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    return calendar.daily_totals(_sittings(spark, d))


def busiest_day(spark: SparkSession, d: str) -> DataFrame:
    return daily_totals(spark, d).orderBy(F.desc("seconds"), F.desc("day")).limit(1).select("day", "seconds")


def longest_session(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d)
    return rows.orderBy(F.desc("seconds"), F.desc("started_at"), "user_id").limit(1).select("user_id", "started_at", "seconds")


def span_tally_month(spark: SparkSession, d: str) -> DataFrame:
    return calendar.span_tally(_sittings(spark, d), "month", "user_id")


def span_tally_week(spark: SparkSession, d: str) -> DataFrame:
    return calendar.span_tally(_sittings(spark, d), "week", "user_id")


def hours_fold(spark: SparkSession, d: str) -> DataFrame:
    return calendar.fold(_sittings(spark, d), F.hour("started_at"), 24)


def weekday_fold(spark: SparkSession, d: str) -> DataFrame:
    return calendar.fold(_sittings(spark, d), F.weekday("started_at"), 7)


def month_fold(spark: SparkSession, d: str) -> DataFrame:
    return calendar.fold(_sittings(spark, d), F.month("started_at"), 12, 1)


def fullest_hour(spark: SparkSession, d: str) -> DataFrame:
    return calendar.fullest(hours_fold(spark, d))


def average_day(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d)
    days = rows.agg(F.countDistinct(F.to_date("started_at")).alias("n"))
    folded = calendar.fold(rows, F.hour("started_at"), 24)
    return folded.crossJoin(F.broadcast(days)).select("bucket", intdiv(F.col("seconds"), F.col("n")).alias("average"))  # one row


def average_week(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d)
    often = calendar.weekday_occurrences(rows.select(F.to_date("started_at").alias("day")))
    folded = calendar.fold(rows, F.weekday("started_at"), 7)
    return folded.join(often, "bucket").select("bucket", intdiv(F.col("seconds"), F.col("occurrences")).alias("average"))


def sitting_bands(spark: SparkSession, d: str) -> DataFrame:
    return calendar.bands(_sittings(spark, d))


def user_streaks(spark: SparkSession, d: str) -> DataFrame:
    days = _events(spark, d).select("user_id", F.to_date("ts").alias("day"))
    return calendar.streaks(days, _today(), ("user_id",))


def weeks_running(spark: SparkSession, d: str) -> DataFrame:
    days = _events(spark, d).where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return calendar.week_runs(days, _today(), ("user_id",))


def streak_without(spark: SparkSession, d: str) -> DataFrame:
    """Each user's streaks without the days that only one kind of event carried."""
    days = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("kinds")).where("kinds > 1")
    return calendar.streaks(days, _today(), ("user_id",))


def day_islands(spark: SparkSession, d: str) -> DataFrame:
    return calendar.islands(_events(spark, d).select("user_id", F.to_date("ts").alias("day")), ("user_id",))


def day_intensity(spark: SparkSession, d: str) -> DataFrame:
    days = daily_totals(spark, d)
    peak = days.agg(F.max("seconds").alias("peak"))
    return days.crossJoin(F.broadcast(peak)).select("day", intensity(F.col("seconds"), F.col("peak")).cast("int").alias("level"))  # one row


def alltime_board(spark: SparkSession, d: str) -> DataFrame:
    return calendar.board(_sittings(spark, d), "user_id", _today())


def hour_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d, SIX_HOURS).where("seconds > 0").withColumn("sid", F.concat_ws("-", "user_id", "session_no"))
    return intervals.hour_split(rows, "sid", "seconds")


def exact_sum_rounding(spark: SparkSession, d: str) -> DataFrame:
    ms = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 1000).cast("long").alias("ms"))
    return intervals.exact_seconds(ms, "user_id", "event_id", "ms").select("event_id", "user_id", "seconds")


def state_to_spans(spark: SparkSession, d: str) -> DataFrame:
    """A user is awake from a view or click until an error or signup."""
    state = F.when(F.col("event_type").isin("view", "click"), "on").otherwise("off")
    return intervals.state_spans(_events(spark, d).withColumn("state", state), "user_id", "ts", "state", "on", "event_id")


def awake_bound(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d).withColumn("sid", F.concat_ws("-", "user_id", "session_no"))
    return intervals.overlap_seconds(rows, state_to_spans(spark, d), "user_id", "sid").select("sid", "overlap")


def locf_progress(spark: SparkSession, d: str) -> DataFrame:
    """A purchase states progress; every other event carries the last one on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    stated = F.when(F.col("event_type") == "purchase", F.bround("value", 0))
    return table(spark, d, "events").select("event_id", F.last(stated, True).over(w).cast("long").alias("progress"))


def running_counters(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.max(k).over(w).alias("highest"), F.last(k, True).over(w).alias("latest"))


def readings_split(spark: SparkSession, d: str) -> DataFrame:
    """A signup starts a new reading; each has its first and last day."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, d).withColumn("reading", F.sum((F.col("event_type") == "signup").cast("long")).over(w))
    return rows.groupBy("user_id", "reading").agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"), F.count("*").alias("n_events"))


def progress_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of positions that don't step back, of two events or more."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = rows.withColumn("seg", F.coalesce((F.col("k") < F.lag("k").over(w)).cast("long"), F.lit(0)))
    rows = rows.withColumn("seg", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("user_id", "seg").agg(F.min("k").alias("from_k"), F.max("k").alias("to_k"), F.count("*").alias("n"))
    return out.where("n > 1")


def zero_run_compress(spark: SparkSession, d: str) -> DataFrame:
    """Signups a day of each user over all days, runs of empty days between them as one row."""
    ev = _events(spark, d)
    ends = ev.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    spine = ev.select("user_id").distinct().crossJoin(F.broadcast(ends)).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))  # one row
    held = ev.where("event_type = 'signup'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    daily = spine.join(held, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("c", F.lit(0)).alias("value"))
    return intervals.zero_runs(daily, "user_id", "day", "value")


def first_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The first purchase after each signup, if it comes before the next signup."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, d).withColumn("open_no", F.sum((F.col("event_type") == "signup").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bought = rows.where("open_no > 0 and event_type = 'purchase'")
    return bought.groupBy("user_id", "open_no").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def owed_shares(spark: SparkSession, d: str) -> DataFrame:
    """A gain of 1000 seconds dealt over each user's sessions by their events."""
    rows = _sittings(spark, d).withColumn("gain", F.lit(1000).cast("long"))
    return sessions.owed_shares(rows, "gain", "n_events", ["user_id"], ["session_no"]).select("user_id", "session_no", "owed")


def user_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's figures, and the kind of event stated last."""
    rows = sessions.numbered(_events(spark, d), DAY)
    return rows.groupBy("user_id").agg(
        F.sum("credit").alias("seconds"), F.countDistinct("session_no").alias("n_sessions"), F.countDistinct(F.to_date("ts")).alias("n_days"),
        F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


def wake_starts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that begin within 30 minutes after an awake span of the same user does."""
    rows = _sittings(spark, d).select("user_id", "session_no", "started_at")
    spans = state_to_spans(spark, d).select("user_id", "from_at", (F.col("from_at") + F.expr("interval 30 minutes")).alias("until"))
    return intervals.covering(rows, spans, "started_at", "from_at", "until", ("user_id",)).groupBy("user_id", "session_no").agg(F.count("*").alias("n_wakes"))


QUERIES = {f.__name__: f for f in (
    sessions_gap, sessions_gap_6h, sessions_midnight_cut, midnight_parts, session_window_counts, daily_totals, busiest_day, longest_session, span_tally_month, span_tally_week,
    hours_fold, weekday_fold, month_fold, fullest_hour, average_day, average_week, sitting_bands, weeks_running, streak_without, day_islands, day_intensity, alltime_board,
    hour_split, exact_sum_rounding, state_to_spans, awake_bound, locf_progress, running_counters, readings_split, progress_segments, zero_run_compress, first_pairing, owed_shares,
    user_totals, wake_starts,
)} | {"streaks": user_streaks}

_FOLD = lambda part, lo, hi: _SIT + f"""  , f as (select cast({part} as int) as bucket, sum(seconds) as s, count(distinct cast(started_at as date)) as d from sit group by 1)
    select cast(r.range as int) as bucket, cast(coalesce(s, 0) as bigint) as seconds, coalesce(d, 0) as n_days from range({lo}, {hi}) r left join f on f.bucket = r.range"""  # noqa: E731
_ISLANDS = lambda days: f"""i as (select user_id, day, cast(day as date) - cast(row_number() over (partition by user_id order by day) as int) as g from ({days})),
    r as (select user_id, min(day) as first_day, max(day) as last_day, count(*) as n_days from i group by user_id, g)"""  # noqa: E731
_STREAK = f"select user_id, max(n_days) as longest, cast(coalesce(max(case when last_day >= date '{TODAY}' - 1 then n_days end), 0) as bigint) as current from r group by 1"
_SPANS = """st as (select user_id, ts, event_id, case when event_type in ('view', 'click') then 'on' else 'off' end as state from events),
    sp as (select *, lag(state) over (partition by user_id order by ts, event_id) as p from st),
    sk as (select *, lead(ts) over (partition by user_id order by ts, event_id) as to_at from sp where p is null or p <> state),
    spans as (select user_id, ts as from_at, to_at from sk where state = 'on' and to_at is not null)"""
_DAYS = _SIT + ", days as (select cast(started_at as date) as day, cast(sum(seconds) as bigint) as seconds, count(*) as n_sittings from sit group by 1)"
_TALLY = lambda unit: _SIT + f""" select cast(date_trunc('{unit}', started_at) as date) as span, cast(sum(seconds) as bigint) as seconds, count(distinct cast(started_at as date)) as n_days,
    count(*) as n_sittings, count(distinct user_id) as n_items, cast(sum(seconds) // count(distinct cast(started_at as date)) as bigint) as per_day from sit group by 1"""  # noqa: E731

ORACLES = {
    "sessions_gap": "with " + _numbered_sql(1800) + " select * from sit",
    "sessions_gap_6h": "with " + _numbered_sql(SIX_HOURS) + " select * from sit",
    "sessions_midnight_cut": "with " + _numbered_sql(DAY, True) + " select * from sit",
    "midnight_parts": _SIT + """, u as (select *, unnest(generate_series(date_trunc('day', started_at), date_trunc('day', ended_at), interval 1 day)) as dd from sit)
        select user_id, session_no, cast(dd as date) as day, (epoch_us(least(ended_at, dd + interval 1 day)) - epoch_us(greatest(started_at, dd))) // 1000000 as part_seconds from u""",
    "session_window_counts": """with a as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events),
        b as (select *, sum(case when p is null or epoch_us(ts) - epoch_us(p) > 21600000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from a)
        select user_id, min(ts) as started_at, count(*) as n_events from b group by user_id, n""",
    "daily_totals": _DAYS + " select * from days",
    "busiest_day": _DAYS + " select day, seconds from days order by seconds desc, day desc limit 1",
    "longest_session": _SIT + " select user_id, started_at, seconds from sit order by seconds desc, started_at desc, user_id limit 1",
    "span_tally_month": _TALLY("month"),
    "span_tally_week": _TALLY("week"),
    "hours_fold": _FOLD("hour(started_at)", 0, 24),
    "weekday_fold": _FOLD("isodow(started_at) - 1", 0, 7),
    "month_fold": _FOLD("month(started_at)", 1, 13),
    "fullest_hour": f"select bucket, seconds from ({_FOLD('hour(started_at)', 0, 24)}) where seconds > 0 order by seconds desc, bucket desc limit 1",
    "average_day": f"select bucket, seconds // (select count(distinct day) from ({_DAYS} select day from days)) as average from ({_FOLD('hour(started_at)', 0, 24)})",
    "average_week": _DAYS + f""", o as (select isodow(x) - 1 as w, count(*) as n from (select unnest(generate_series(min(day), max(day), interval 1 day)) as x from days) group by 1)
        select bucket, seconds // n as average from ({_FOLD('isodow(started_at) - 1', 0, 7)}) join o on o.w = bucket""",
    "sitting_bands": _SIT + """, f as (select least(greatest(seconds // 300, 0), 24) as b, count(*) as n from sit group by 1)
        select cast(r.range as int) as band, coalesce(n, 0) as n_sittings from range(25) r left join f on f.b = r.range""",
    "streaks": "with " + _ISLANDS("select distinct user_id, cast(ts as date) as day from events") + _STREAK.replace("select", " select", 1),
    "streak_without": "with " + _ISLANDS("select user_id, cast(ts as date) as day from events group by 1, 2 having count(distinct event_type) > 1") + " " + _STREAK,
    "day_islands": "with " + _ISLANDS("select distinct user_id, cast(ts as date) as day from events") + " select * from r",
    "weeks_running": f"""with w as (select distinct user_id, date_diff('day', date '1970-01-05', cast(date_trunc('week', ts) as date)) // 7 as week from events where event_type = 'purchase'),
        g as (select user_id, week, week - row_number() over (partition by user_id order by week) as g from w),
        r as (select user_id, max(week) as last, count(*) as n from g group by user_id, g)
        select user_id, cast(coalesce(max(case when last >= date_diff('day', date '1970-01-05', cast(date_trunc('week', date '{TODAY}') as date)) // 7 - 1 then n end), 0) as bigint) as weeks from r group by 1""",
    "day_intensity": _DAYS + """, p as (select max(seconds) as peak from days)
        select day, cast(case when seconds <= 0 then 0 when seconds / peak < 0.15 then 1 when seconds / peak < 0.4 then 2 when seconds / peak < 0.66 then 3 else 4 end as int) as level from days, p""",
    "alltime_board": _DAYS + f""", i as (select day, day - cast(row_number() over (order by day) as int) as g from days), r as (select max(day) as last_day, count(*) as n from i group by g)
        select (select cast(sum(seconds) as bigint) from sit) as seconds, (select count(*) from sit) as n_sittings, (select count(distinct user_id) from sit) as n_items, (select max(seconds) from sit) as longest_seconds,
          (select day from days order by seconds desc, day desc limit 1) as busiest_day, (select max(seconds) from days) as busiest_seconds, (select count(*) from days) as n_days, (select min(day) from days) as first_day,
          (select max(day) from days) as last_day, (select max(n) from r) as longest, (select cast(coalesce(max(case when last_day >= date '{TODAY}' - 1 then n end), 0) as bigint) from r) as current,
          (select cast(sum(seconds) // (select count(*) from days) as bigint) from sit) as per_day, (select cast(sum(seconds) // count(*) as bigint) from sit) as per_sitting""",
    "hour_split": "with " + _numbered_sql(SIX_HOURS) + """, x as (select user_id || '-' || session_no as sid, * from sit where seconds > 0),
        u as (select *, unnest(generate_series(date_trunc('hour', started_at), date_trunc('hour', ended_at), interval 1 hour)) as hour_at from x),
        p as (select *, case when ended_at > started_at then cast(floor(seconds * (epoch_us(least(ended_at, hour_at + interval 1 hour)) - epoch_us(greatest(started_at, hour_at))) / (epoch_us(ended_at) - epoch_us(started_at))) as bigint) else 0 end as p from u)
        select sid, hour_at, cast(p + case when hour_at = min(hour_at) over (partition by sid) then seconds - sum(p) over (partition by sid) else 0 end as bigint) as part from p""",
    "exact_sum_rounding": """with m as (select event_id, user_id, cast(floor(value * 1000) as bigint) as ms from events),
        r as (select *, sum(ms) over (partition by user_id order by event_id rows unbounded preceding) // 1000 as run from m)
        select event_id, user_id, cast(run - coalesce(lag(run) over (partition by user_id order by event_id), 0) as bigint) as seconds from r""",
    "state_to_spans": "with " + _SPANS + " select * from spans",
    "awake_bound": _SIT + ", " + _SPANS + """, o as (select s.user_id, s.session_no, sum(greatest(epoch_us(least(s.ended_at, p.to_at)) - epoch_us(greatest(s.started_at, p.from_at)), 0)) as us
          from sit s join spans p on s.user_id = p.user_id and p.from_at <= s.ended_at and p.to_at >= s.started_at group by 1, 2)
        select s.user_id || '-' || s.session_no as sid, cast(coalesce(us, 0) // 1000000 as bigint) as overlap from sit s left join o using (user_id, session_no)""",
    "locf_progress": """select event_id, cast(last_value(case when event_type = 'purchase' then round_even(value, 0) end ignore nulls)
          over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as progress from events""",
    "running_counters": """with e as (select *, cast(props::json->>'k' as bigint) as k from events)
        select event_id, max(k) over w as highest, last_value(k ignore nulls) over w as latest from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "readings_split": """with r as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as reading from events)
        select user_id, cast(reading as bigint) as reading, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, count(*) as n_events from r group by 1, 2""",
    "progress_segments": """with e as (select *, cast(props::json->>'k' as bigint) as k from events), j as (select *, case when k < lag(k) over (partition by user_id order by ts, event_id) then 1 else 0 end as j from e),
        s as (select *, sum(j) over (partition by user_id order by ts, event_id rows unbounded preceding) as seg from j)
        select user_id, cast(seg as bigint) as seg, min(k) as from_k, max(k) as to_k, count(*) as n from s group by 1, 2 having count(*) > 1""",
    "zero_run_compress": """with spine as (select user_id, cast(x as date) as day from (select distinct user_id from events), (select unnest(generate_series(min(cast(ts as date)), max(cast(ts as date)), interval 1 day)) as x from events)),
        h as (select user_id, cast(ts as date) as day, count(*) as c from events where event_type = 'signup' group by 1, 2),
        v as (select s.user_id, s.day, coalesce(c, 0) as value from spine s left join h using (user_id, day)),
        f as (select *, min(case when value > 0 then day end) over (partition by user_id) as lo, max(case when value > 0 then day end) over (partition by user_id) as hi,
              row_number() over (partition by user_id order by day) - row_number() over (partition by user_id, value = 0 order by day) as g from v),
        k as (select *, coalesce(value = 0 and day > lo and day < hi, false) as inner_zero from f)
        select user_id, min(day) as day, cast(sum(value) as bigint) as value, count(*) as n from k group by user_id, case when inner_zero then g end, case when not inner_zero then day end""",
    "first_pairing": """with r as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as o from events),
        p as (select *, row_number() over (partition by user_id, o order by ts, event_id) as n from r where o > 0 and event_type = 'purchase')
        select user_id, cast(o as bigint) as open_no, event_id from p where n = 1""",
    "owed_shares": _SIT + """, p as (select user_id, session_no, cast(1000 * n_events // sum(n_events) over (partition by user_id) as bigint) as part,
          row_number() over (partition by user_id order by session_no desc) = 1 as last from sit)
        select user_id, session_no, cast(case when last then 1000 - sum(case when last then 0 else part end) over (partition by user_id) else part end as bigint) as owed from p""",
    "user_totals": "with " + _numbered_sql(DAY) + """ select user_id, cast(sum(credit) as bigint) as seconds, count(distinct session_no) as n_sessions, count(distinct cast(ts as date)) as n_days,
        min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, last(event_type order by ts, event_id) as last_type from k group by 1""",
    "wake_starts": _SIT + ", " + _SPANS + """ select s.user_id, s.session_no, count(*) as n_wakes from sit s join spans p on s.user_id = p.user_id
        and s.started_at >= p.from_at and s.started_at <= p.from_at + interval 30 minute group by 1, 2""",
}
