"""Queries over the star tables: orders are sittings, customers books, lineitem pages, documents passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readspan.functions import scores, text
from readspan.functions.scores import intdiv
from readspan.operators import breakdown, intervals, matching, merge
from readspan.plans.tables import table


def _secs() -> Column:
    return F.floor("o_totalprice").cast("long")


# ---------------------------------------------------------------- sorts and top-k


def books_by_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(_secs()).alias("seconds"), F.count("*").alias("n_sittings"))


def books_recent(spark: SparkSession, d: str) -> DataFrame:
    """The 25 books put down last."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.sum(_secs()).alias("seconds"))
    return rows.orderBy(F.desc("last_at"), F.desc("seconds"), "o_custkey").limit(25)


def top10(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bars = bars.groupBy(F.col("p_brand").alias("value")).agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("seconds"))
    return breakdown.top(bars, 10)


def book_figures(spark: SparkSession, d: str) -> DataFrame:
    """Sums, days, last status and pace of each book."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum(_secs()).alias("seconds"), F.countDistinct(F.to_date("o_orderdate")).alias("n_days"), F.count("*").alias("n_sittings"),
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"),
        F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"),
    )
    return rows.withColumns({"per_day": intdiv(F.col("seconds"), F.col("n_days")), "per_sitting": intdiv(F.col("seconds"), F.col("n_sittings")), "span_days": (F.datediff("last_day", "first_day") + 1).cast("long")})


def counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"))


def finished_books(spark: SparkSession, d: str) -> DataFrame:
    """Books all of whose orders are finished: how many, and their seconds on average."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("finished"), F.sum(_secs()).alias("seconds"))
    return rows.where("finished").agg(F.count("*").alias("n_finished"), intdiv(F.sum("seconds"), F.count("*")).alias("average"))


def progress_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The status of each book's last order up to the middle of 1997."""
    rows = table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1997-07-01").cast("timestamp_ntz"))
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


# ---------------------------------------------------------------- joins


def interval_witness(spark: SparkSession, d: str) -> DataFrame:
    """Orders name the user's session they fall in; a session that two customers' orders fall in is left out."""
    from readspan.plans.session_queries import DAY, _sittings

    spans = _sittings(spark, d, DAY).select("user_id", "session_no", "started_at", "ended_at", "seconds")
    points = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("ts").alias("at"), "user_id", F.floor("value").cast("long").alias("name"))
    met = intervals.covering(points, spans, "at", "started_at", "ended_at", ("user_id",))
    claims = met.select(F.concat_ws("-", "user_id", "session_no").alias("sid"), "name", "seconds")
    return matching.unanimous(claims, "sid", "name", "seconds")


def asof_offset(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the value of its user's last signup, or of the first one before that."""
    ev = table(spark, d, "events")
    changes = ev.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("since")).agg(F.max("value").alias("offset"))
    return intervals.as_of(ev.select("event_id", "user_id", "ts"), changes, "ts", "since", "offset", ("user_id",)).select("event_id", "offset")


def band_offsets(spark: SparkSession, d: str) -> DataFrame:
    """How often a click and a purchase of one user are parted by so many seconds, within an hour."""
    ev = table(spark, d, "events")
    pick = lambda kind: ev.where(F.col("event_type") == kind).select("user_id", "ts")
    return matching.offsets_seen(pick("click"), pick("purchase"), "user_id", "ts", "ts", 1, 3600, 1)


def narrowest_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of the awake spans and sessions that hold a purchase the shortest."""
    from readspan.plans.session_queries import SIX_HOURS, _sittings, state_to_spans

    spans = state_to_spans(spark, d).select("user_id", F.col("from_at").alias("a"), F.col("to_at").alias("b"), F.lit("awake").alias("kind"))
    spans = spans.unionByName(_sittings(spark, d, SIX_HOURS).select("user_id", F.col("started_at").alias("a"), F.col("ended_at").alias("b"), F.lit("session").alias("kind")))
    points = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return matching.narrowest(intervals.covering(points, spans, "ts", "a", "b", ("user_id",)), ["event_id"], "a", "b", "kind").select("event_id", "kind", "a", "b")


def positional_pairing(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    left = ev.where("event_type = 'click'").select("user_id", "day", F.col("event_id").alias("click_id"))
    right = ev.where("event_type = 'view'").select("user_id", "day", F.col("event_id").alias("view_id"))
    return matching.pair_in_order(left, right, ["user_id", "day"], "click_id", "view_id").withColumn("pos", F.col("pos").cast("long"))


def unique_counter_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of one nation whose balance, in hundreds, stands once on either side."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("counter"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).cast("long").alias("counter"))
    return matching.unique_pairs(c, s, ["nation", "counter"], "c_custkey", "s_suppkey")


def coalesced_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A name for each line: of its supplier if known to be in debt, else of its part's brand, if that has one type only."""
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    p = matching.only(table(spark, d, "part").withColumn("l_partkey", F.col("p_partkey")), ["l_partkey"], "p_type").withColumnRenamed("p_type", "name")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return matching.coalesced_lookup(rows, [(s, "l_suppkey"), (p, "l_partkey")], "name").select("l_orderkey", "l_linenumber", "name")


def single_type_brands(spark: SparkSession, d: str) -> DataFrame:
    return matching.only(table(spark, d, "part"), ["p_brand", "p_size"], "p_type")


def ranked_claims(spark: SparkSession, d: str) -> DataFrame:
    """The priority that each customer's best-ranked orders agree on."""
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("rank"))
    return matching.ranked_claims(rows, "o_custkey", "name", "rank")


def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain the first sentence of a benchmark item, of those with five words as its SQL has it."""
    needles = table(spark, d, "benchmark").select("item_id", F.substring_index(F.substring_index("text", "\n", 1), ". ", 1).alias("needle"))
    needles = needles.where(F.col("needle").rlike(r"^\S+[ \n]+\S+[ \n]+\S+[ \n]+\S+[ \n]"))
    return matching.contained(needles, table(spark, d, "documents").select("doc_id", "text"), "needle", "text").select("item_id", "doc_id")


def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents on one word, by plain or folded text."""
    return table(spark, d, "documents").where(text.holds(F.col("text"), "License")).select("doc_id")


def nested_notes(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns under the user turn before them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("passage", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w))
    return rows.where("role = 'assistant'").groupBy("conv_id", "passage").agg(F.count("*").alias("n_notes"), F.sum(F.length("text")).alias("n_chars"))


# ---------------------------------------------------------------- merges


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    held = p.where("p_partkey % 3 <> 0").select("p_partkey", "p_brand", F.lit(10).alias("edited"), F.col("p_size"))
    new = p.where("p_partkey % 2 = 0").select("p_partkey", F.concat("p_brand", F.lit("*")).alias("p_brand"), (F.col("p_partkey") % 20).cast("int").alias("edited"), (F.col("p_size") + F.col("p_partkey").cast("int") % 2 + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("p_size"))
    return held, new


def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.take(*_held(spark, d), ["p_partkey"], "edited")


def upsert_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_held(spark, d), "p_partkey", ["p_size"])


def nested_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One order a customer and month start, then one a month and end."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("start"), F.to_date("o_orderdate").alias("close"))
    rows = rows.groupBy("o_custkey", "start", "close").agg(F.min("o_orderkey").alias("o_orderkey"))
    return merge.one_per_close(rows, ["o_custkey", "start"], "close", "close", ["o_custkey"], "start")


def tombstone_filter(spark: SparkSession, d: str) -> DataFrame:
    cleared = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderdate").alias("at"))
    return merge.live(table(spark, d, "orders"), cleared, "o_custkey", "o_orderdate", "at").select("o_orderkey")


def containment_check(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").select("doc_id")
    return merge.contains_all(a, table(spark, d, "documents"), ["doc_id"])


def replace_tail(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lit("held").alias("origin"))
    new = o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("parsed"))
    return merge.replace_tail(o, new, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "origin")


def device_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return merge.together({"left": c, "right": s})


def labels_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels over defaults, and labels without a document."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "full")
    return rows.select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def pivoted_fields(spark: SparkSession, d: str) -> DataFrame:
    """The latest price of each priority, one row a customer."""
    rows = table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '5-LOW')")
    pick = lambda p: F.max_by("o_orderkey", F.when(F.col("o_orderpriority") == p, F.struct("o_orderdate", "o_orderkey")))
    return rows.groupBy("o_custkey").agg(pick("1-URGENT").alias("urgent"), pick("5-LOW").alias("low"))


# ---------------------------------------------------------------- breakdowns


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with the roles that speak in them, and their characters."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.sum(F.length("text")).cast("long").alias("seconds"))
    return rows


def breakdown_ranked(spark: SparkSession, d: str) -> DataFrame:
    return breakdown.ranked(_items(spark, d), "conv_id", "roles", "seconds")


def language_even_split(spark: SparkSession, d: str) -> DataFrame:
    return breakdown.even_split(_items(spark, d), "conv_id", "roles", "seconds")


def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """Whole percentages of the five priorities in each order status."""
    rows = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return intervals.largest_remainder(rows, ["o_orderstatus"], "n", ["o_orderpriority"])


def source_language_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id"))
    return rows.select("source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("de", "en", "es", "fr")))


def values_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language, by source and in all, in one pass."""
    rows = table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rows.select("lang", "source", "n", "chars")


# ---------------------------------------------------------------- functions


def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).alias("raw"))


def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.normalised(F.col("text")).alias("clean"), text.bounded(F.col("text"), 100).alias("short"), text.escaped(F.col("text")).alias("escaped"))


def escape_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", (text.unescaped(text.escaped(F.col("text"))) == F.col("text")).alias("same"))


def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """Calendar parts of every order day, weeks by Monday and by Sunday."""
    day = F.to_date("o_orderdate")
    year, week = scores.sunday_week(day)
    rows = table(spark, d, "orders").select(day.alias("day")).distinct()
    day = F.col("day")
    year, week = scores.sunday_week(day)
    return rows.select(
        "day", F.unix_date(day).cast("long").alias("number"), F.weekday(day).alias("weekday"), F.weekofyear(day).alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"),
        year.alias("sun_year"), week.alias("sun_week"), F.day(F.last_day(day)).alias("month_days"), F.add_months(day, -1).alias("month_before"),
        scores.span_start(day, "week").alias("week_start"), scores.span_end(day, "month").alias("month_end"), scores.span_end(day, "year").alias("year_end"),
    )


def durations(spark: SparkSession, d: str) -> DataFrame:
    secs = F.col("o_orderkey") % 20000
    return table(spark, d, "orders").select("o_orderkey", scores.duration(secs).alias("said"), scores.whole_percent(F.col("o_totalprice") / 1000).alias("percent"), scores.band(secs).alias("band"))


def prorata_shares(spark: SparkSession, d: str) -> DataFrame:
    """An advance cut by the part of its time that had passed, and even parts of three."""
    a, b = F.floor("l_extendedprice").cast("long"), F.floor("l_quantity").cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.share(a, b - 10, F.lit(30).cast("long")).alias("share"), scores.even_part(a, F.lit(3).cast("long"), F.col("l_linenumber") % 3).alias("part"))


def page_dwell(spark: SparkSession, d: str) -> DataFrame:
    secs = F.floor(F.col("value")).cast("long")
    return table(spark, d, "events").select("event_id", scores.dwell(secs).alias("credit"), scores.broken(F.col("value") * 10 - 80, 1800, 60).alias("broken"))


def route_keys(spark: SparkSession, d: str) -> DataFrame:
    """A page's key: its path if it has one, else its number."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("e"), F.col("page_id").cast("string"))).alias("key"), F.regexp_extract("url", r"://([^/]+)", 1).alias("host"))


def month_spine(spark: SparkSession, d: str) -> DataFrame:
    """Orders of every month from the first to the last, empty ones too."""
    o = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"))
    ends = o.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    held = o.groupBy("month").agg(F.count("*").alias("c"))
    return spine.join(held, "month", "left").select("month", F.coalesce("c", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (
    books_by_time, books_recent, top10, book_figures, counts_by_kind, finished_books, progress_as_of, interval_witness, asof_offset, band_offsets, narrowest_cover, positional_pairing,
    unique_counter_match, coalesced_lookup, single_type_brands, ranked_claims, containment_pairs, search_documents, nested_notes, lww_merge, upsert_full_outer, nested_dedup, tombstone_filter,
    containment_check, replace_tail, device_union, labels_overlay, pivoted_fields, breakdown_ranked, language_even_split, largest_remainder, source_language_matrix, values_by_sets,
    json_field_extract, text_normalise, escape_round_trip, date_parts, durations, prorata_shares, page_dwell, route_keys, month_spine,
)}

from readspan.plans.session_queries import _SIT, _SPANS, SIX_HOURS, _numbered_sql  # noqa: E402

_SECS = "cast(floor(o_totalprice) as bigint)"
_HELD = """h as (select p_partkey, p_brand, 10 as edited, p_size from part where p_partkey % 3 <> 0),
  n as (select p_partkey, p_brand || '*' as p_brand, cast(p_partkey % 20 as int) as edited, cast(p_size + p_partkey % 2 + case when p_partkey % 5 = 0 then 1 else 0 end as int) as p_size from part where p_partkey % 2 = 0)"""
_ITEMS = "it as (select conv_id, list_sort(list(distinct role)) as roles, cast(sum(length(text)) as bigint) as seconds from conversations group by 1)"

ORACLES = {
    "books_by_time": f"select o_custkey, cast(sum({_SECS}) as bigint) as seconds, count(*) as n_sittings from orders group by 1",
    "books_recent": f"select o_custkey, max(o_orderdate) as last_at, cast(sum({_SECS}) as bigint) as seconds from orders group by 1 order by 2 desc, 3 desc, 1 limit 25",
    "top10": """with b as (select p_brand as value, cast(sum(floor(l_extendedprice)) as bigint) as seconds from lineitem join part on l_partkey = p_partkey group by 1 order by 2 desc, 1 limit 10)
        select value, seconds, cast(row_number() over (order by seconds desc, value) as int) as place from b""",
    "book_figures": f"""with b as (select o_custkey, cast(sum({_SECS}) as bigint) as seconds, count(distinct cast(o_orderdate as date)) as n_days, count(*) as n_sittings,
        last(o_orderstatus order by o_orderdate, o_orderkey) as last_status, min(cast(o_orderdate as date)) as first_day, max(cast(o_orderdate as date)) as last_day from orders group by 1)
        select *, seconds // n_days as per_day, seconds // n_sittings as per_sitting, cast(last_day - first_day + 1 as bigint) as span_days from b""",
    "counts_by_kind": "select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as n_finished from orders group by 1",
    "finished_books": f"with b as (select bool_and(o_orderstatus = 'F') as f, sum({_SECS}) as s from orders group by o_custkey) select count(*) as n_finished, cast(sum(s) // count(*) as bigint) as average from b where f",
    "progress_as_of": "select o_custkey, last(o_orderstatus order by o_orderdate, o_orderkey) as status from orders where o_orderdate <= timestamp '1997-07-01' group by 1",
    "interval_witness": _SIT + """ , c as (select s.user_id || '-' || s.session_no as sid, cast(floor(e.value) as bigint) as name, s.seconds from events e join sit s on e.user_id = s.user_id
        and e.ts >= s.started_at and e.ts <= s.ended_at where e.event_type = 'purchase') select sid, min(name) as name, max(seconds) as seconds, count(*) as n_claims from c group by 1 having count(distinct name) = 1""",
    "asof_offset": """with c as (select user_id, ts, max(value) as v from events where event_type = 'signup' group by 1, 2), f as (select user_id, first(v order by ts) as v from c group by 1)
        select e.event_id, coalesce(c.v, f.v) as "offset" from events e asof left join c on e.user_id = c.user_id and e.ts >= c.ts left join f on e.user_id = f.user_id""",
    "band_offsets": """with x as (select user_id, epoch_us(ts) // 1000000 as s, event_type from events),
        p as (select a.user_id, b.s - a.s as g from x a join x b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' where abs(b.s - a.s) <= 3600)
        select user_id, g as "offset", count(*) as support from p group by 1, 2""",
    "narrowest_cover": "with " + _numbered_sql(SIX_HOURS) + ", " + _SPANS + """, al as (select user_id, from_at as a, to_at as b, 'awake' as kind from spans union all select user_id, started_at, ended_at, 'session' from sit),
        m as (select e.event_id, kind, a, b, row_number() over (partition by e.event_id order by epoch_us(b) - epoch_us(a), kind) as n from events e join al on e.user_id = al.user_id and e.ts >= a and e.ts <= b where e.event_type = 'purchase')
        select event_id, kind, a, b from m where n = 1""",
    "positional_pairing": """with x as (select user_id, cast(ts as date) as day, event_id, event_type, row_number() over w as pos, count(*) over (partition by user_id, cast(ts as date), event_type) as n
        from events where event_type in ('click', 'view') window w as (partition by user_id, cast(ts as date), event_type order by event_id))
        select a.user_id, a.day, a.pos, a.event_id as click_id, b.event_id as view_id from x a join x b using (user_id, day, pos, n) where a.event_type = 'click' and b.event_type = 'view'""",
    "unique_counter_match": """with c as (select c_custkey, c_nationkey as nation, cast(floor(c_acctbal / 100) as bigint) as counter, count(*) over (partition by c_nationkey, floor(c_acctbal / 100)) as n from customer),
        s as (select s_suppkey, s_nationkey as nation, cast(floor(s_acctbal / 100) as bigint) as counter, count(*) over (partition by s_nationkey, floor(s_acctbal / 100)) as n from supplier)
        select nation, counter, c_custkey, s_suppkey from c join s using (nation, counter) where c.n = 1 and s.n = 1""",
    "coalesced_lookup": """select l_orderkey, l_linenumber, coalesce(s_name, p_type) as name from lineitem left join (select * from supplier where s_acctbal < 0) on l_suppkey = s_suppkey left join part on l_partkey = p_partkey""",
    "single_type_brands": "select p_brand, p_size, min(p_type) as p_type from part group by 1, 2 having count(distinct p_type) = 1",
    "ranked_claims": """with r as (select o_custkey, o_orderpriority as name, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as rank from orders),
        b as (select *, min(rank) over (partition by o_custkey) as m from r) select o_custkey, rank, min(name) as name from b where rank = m group by 1, 2 having count(distinct name) = 1""",
    "containment_pairs": r"""with n as (select item_id, split_part(split_part(text, chr(10), 1), '. ', 1) as needle from benchmark)
        select item_id, doc_id from n join documents d on contains(d.text, needle) where regexp_matches(needle, '^\S+[ \n]+\S+[ \n]+\S+[ \n]+\S+[ \n]')""",
    "search_documents": "select doc_id from documents where contains(lower(text), 'license')",
    "nested_notes": """with p as (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as passage from conversations)
        select conv_id, passage, count(*) as n_notes, cast(sum(length(text)) as bigint) as n_chars from p where role = 'assistant' group by 1, 2""",
    "lww_merge": f"with {_HELD}, u as (select *, 1 as o from h union all select *, 2 from n), r as (select *, row_number() over (partition by p_partkey order by edited desc, o) as k from u) select p_partkey, p_brand, edited, p_size from r where k = 1",
    "upsert_full_outer": f"""with {_HELD} select coalesce(h.p_partkey, n.p_partkey) as p_partkey, coalesce(n.p_size, h.p_size) as p_size,
        case when h.p_partkey is null then 'added' when n.p_partkey is null then 'gone' when n.p_size = h.p_size then 'same' else 'changed' end as change from h full join n on h.p_partkey = n.p_partkey""",
    "nested_dedup": """with a as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as start, cast(o_orderdate as date) as close, min(o_orderkey) as o_orderkey from orders group by 1, 2, 3),
        b as (select *, row_number() over (partition by o_custkey, start order by close desc) as n from a), c as (select *, row_number() over (partition by o_custkey, close order by start) as m from b where n = 1)
        select o_custkey, start, close, o_orderkey from c where m = 1""",
    "tombstone_filter": "with c as (select o_custkey, max(o_orderdate) as at from orders where o_orderstatus = 'P' group by 1) select o_orderkey from orders o left join c on o.o_custkey = c.o_custkey where c.at is null or o.o_orderdate >= c.at",
    "containment_check": "select count(*) as n_missing, count(*) = 0 as contained from (select distinct doc_id from labels) l where not exists (select 1 from documents d where d.doc_id = l.doc_id)",
    "replace_tail": """select o_orderkey, 'held' as origin from orders where o_orderdate < timestamp '1998-01-01' union all select o_orderkey, 'parsed' from orders where o_orderdate >= timestamp '1998-01-01' and o_orderkey % 2 = 0""",
    "device_union": "select c_custkey as key, c_acctbal as value, 'left' as device from customer union all select s_suppkey, s_acctbal, 'right' from supplier",
    "labels_overlay": "select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(lang, '?') as lang, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from documents d full join labels l on d.doc_id = l.doc_id",
    "pivoted_fields": """select o_custkey, last(o_orderkey order by o_orderdate, o_orderkey) filter (where o_orderpriority = '1-URGENT') as urgent, last(o_orderkey order by o_orderdate, o_orderkey) filter (where o_orderpriority = '5-LOW') as low
        from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1""",
    "breakdown_ranked": f"with {_ITEMS} select value, cast(sum(seconds) as bigint) as seconds, count(distinct conv_id) as n_items from (select conv_id, seconds, unnest(roles) as value from it) group by 1",
    "language_even_split": f"""with {_ITEMS}, u as (select seconds, len(roles) as k, unnest(range(len(roles))) as i, unnest(roles) as value from it)
        select value, cast(sum(seconds // k + case when i < seconds % k then 1 else 0 end) as bigint) as seconds from u group by 1""",
    "largest_remainder": """with c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2), t as (select *, sum(n) over (partition by o_orderstatus) as t from c),
        f as (select *, n * 100 // t as f, n * 100 % t as r from t), k as (select *, row_number() over (partition by o_orderstatus order by r desc, o_orderpriority) as k, 100 - sum(f) over (partition by o_orderstatus) as short from f)
        select o_orderstatus, o_orderpriority, n, cast(f + case when k <= short then 1 else 0 end as bigint) as share from k""",
    "source_language_matrix": """select source, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr from documents group by 1""",
    "values_by_sets": "select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by grouping sets ((lang), (source), ())",
    "json_field_extract": r"""select event_id, cast(props::json->>'k' as bigint) as k, regexp_extract(props, '"k"\s*:\s*(\d+)', 1) as raw from events""",
    "text_normalise": r"""select item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as clean, case when length(text) > 100 then left(text, 100) || '…' else text end as short,
        replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') as escaped from benchmark""",
    "escape_round_trip": "select conv_id, turn, true as same from conversations",
    "date_parts": """with d as (select distinct cast(o_orderdate as date) as day from orders), f as (select day, cast(day - cast(dayofweek(day) as int) as date) as s from d), y as (select *, year(s + 3) as y from f)
        select day, cast(day - date '1970-01-01' as bigint) as number, cast(isodow(day) - 1 as int) as weekday, cast(week(day) as int) as iso_week, cast(isoyear(day) as int) as iso_year, cast(y as int) as sun_year,
          cast((s - cast(make_date(y, 1, 4) - cast(dayofweek(make_date(y, 1, 4)) as int) as date)) // 7 + 1 as int) as sun_week, cast(day(last_day(day)) as int) as month_days,
          cast(day - interval 1 month as date) as month_before, cast(date_trunc('week', day) as date) as week_start, last_day(day) as month_end, make_date(cast(year(day) as bigint), 12, 31) as year_end from y""",
    "durations": """with s as (select o_orderkey, o_totalprice, o_orderkey % 20000 as s, (o_orderkey % 20000 + 30) // 60 as m from orders)
        select o_orderkey, case when s = 0 then '0m' when m = 0 then '<1m' when m // 60 = 0 then (m % 60) || 'm' when m % 60 = 0 then (m // 60) || 'h' else (m // 60) || 'h ' || (m % 60) || 'm' end as said,
          cast(round_even(o_totalprice / 1000, 0) as bigint) as percent, cast(least(greatest(s // 300, 0), 24) as int) as band from s""",
    "prorata_shares": """with x as (select l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint) as a, cast(floor(l_quantity) as bigint) - 10 as b from lineitem)
        select l_orderkey, l_linenumber, a * least(greatest(b, 0), 30) // 30 as share, a // 3 + case when l_linenumber % 3 < a % 3 then 1 else 0 end as part from x""",
    "page_dwell": "select event_id, cast(case when floor(value) < 3 then 0 else least(floor(value), 120) end as bigint) as credit, value * 10 - 80 > 1800 or value * 10 - 80 < -60 as broken from events",
    "route_keys": r"""select page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), ''), 'e' || page_id) as key, regexp_extract(url, '://([^/]+)', 1) as host from pages""",
    "month_spine": """with o as (select date_trunc('month', o_orderdate) as m from orders), s as (select unnest(generate_series(min(m), max(m), interval 1 month)) as m from o)
        select cast(s.m as date) as month, count(o.m) as n from s left join o on o.m = s.m group by 1""",
}
