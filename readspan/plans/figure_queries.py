"""Queries of the read model, identification, values and typed sources over the tables, and the SQL that states the same.

``orders`` stand in for sittings (a customer is a book, the order's key gives hour and figures), ``lineitem`` for witnesses and
marks, ``part`` for the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.functions import dates, languages, text
from readspan.operators import breakdown, figures, highlights, identify, links, matching, zones
from readspan.plans.tables import table
from readspan.sources import catalog, records
from readspan.streaming import late

FIRST, LAST = "1995-01-01", "1996-12-31"


def _day(text_: str):
    return F.lit(text_).cast("date")


def _sittings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sittings of all four measures; every seventh customer is a book without a name."""
    o, key, cents = table(spark, d, "orders"), F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    at = dates.at_second(F.to_date("o_orderdate"), key * 37 % 80_000)
    secs = cents % 4000
    measure = F.element_at(F.array(*map(F.lit, ("counted", "timed", "paged", "awake"))), (key % 4 + 1).cast("int"))
    return o.select(
        F.lit("d").alias("device"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("book"), F.col("o_custkey").alias("extent"), at.alias("started_at"),
        dates.moved(at, secs).alias("ended_at"), secs.alias("seconds"), (cents % 3500).alias("timed_seconds"), (cents % 4500).alias("paged_seconds"), (key % 900).alias("words"), (key % 1000).alias("timed_words"),
        (key % 1100).alias("paged_words"), (key % 50).alias("page_turns"), measure.alias("measure"), ((key % 100) / 1000.0).alias("covered"), (key % 1000 / 1000.0).alias("progress"),
        F.when(key % 3 == 0, key % 5000).alias("time_left"), F.when(key % 5 == 0, key % 400).alias("stated_wpm"), key.alias("id"),
    )


_SIT = """s0 as (select *, cast(round(o_totalprice * 100) as bigint) as cents, o_orderkey as k from orders),
  s1 as (select case when o_custkey % 7 <> 0 then o_custkey end as book, o_custkey as extent, cast(o_orderdate as date) as day, k * 37 % 80000 as from_s, cents % 4000 as seconds, cents % 3500 as timed_seconds,
    cents % 4500 as paged_seconds, k % 900 as words, k % 1000 as timed_words, k % 1100 as paged_words, k % 50 as page_turns, ['counted','timed','paged','awake'][k % 4 + 1] as measure, (k % 100) / 1000.0::double as covered,
    (k % 1000) / 1000.0::double as progress, case when k % 3 = 0 then k % 5000 end as time_left, case when k % 5 = 0 then k % 400 end as stated_wpm, k as id from s0),
  s2 as (select *, cast(day as timestamp) + to_seconds(from_s) as started_at, cast(day as timestamp) + to_seconds(from_s + seconds) as ended_at,
    case when timed_seconds > 0 and timed_seconds >= seconds then timed_seconds when paged_seconds > 0 and paged_seconds >= seconds then paged_seconds else seconds end as app_read,
    case when timed_seconds > 0 and timed_seconds >= seconds then greatest(timed_words, words) when paged_seconds > 0 and paged_seconds >= seconds then greatest(paged_words, words) else words end as app_words from s1)"""


def figures_by_book(spark: SparkSession, d: str) -> DataFrame:
    """Per book what the app's measure says: sums, days and what the last sitting states."""
    rows = figures.credited(_sittings(spark, d), app=True)
    out = figures.rates(figures.book_figures(rows))
    shown = "book seconds counted_seconds words days sittings page_turns first_day last_day covered_seconds stated_time_left stated_wpm per_day per_sitting span_days wpm counted_of_measure awake_of_measure".split()
    return out.select(*shown, F.round("covered", 6).alias("covered"), F.round("progress", 6).alias("progress"))


def figures_by_day(spark: SparkSession, d: str) -> DataFrame:
    return figures.day_figures(figures.credited(_sittings(spark, d)))


def books_of_days(spark: SparkSession, d: str) -> DataFrame:
    return figures.books_on(figures.credited(_sittings(spark, d), unidentified=False))


def unidentified_span(spark: SparkSession, d: str) -> DataFrame:
    return figures.unidentified(figures.credited(_sittings(spark, d)), _day(FIRST), _day(LAST))


def books_counted(spark: SparkSession, d: str) -> DataFrame:
    return figures.book_count(figures.credited(_sittings(spark, d)))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d).withColumns({"from_s": dates.second_of_day(F.col("started_at")), "day": F.to_date("started_at")})
    return rows.withColumn("hours", figures.spread_over(F.col("seconds"), F.col("from_s"), F.least(F.col("from_s") + F.col("seconds") * 3, F.lit(86_400))))


def hours_spread(spark: SparkSession, d: str) -> DataFrame:
    """Seconds over the clock hours of three times as long a span."""
    return _hours(spark, d).select("id", F.explode("hours").alias("x")).select("id", F.col("x.h").alias("hour"), F.col("x.s").alias("seconds"))


def hours_rescaled(spark: SparkSession, d: str) -> DataFrame:
    """The hours of each sitting in proportion to its timed seconds, the busiest taking the rest."""
    hours = figures.hours_at(F.col("hours"), F.col("timed_seconds"), F.col("from_s"), F.col("from_s") + F.col("seconds"))
    out = _hours(spark, d).where("seconds > 0").select("id", "timed_seconds", hours.alias("h"))
    return out.select("id", F.size("h").cast("long").alias("n_hours"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("seconds"), F.element_at("h", (figures.busiest(F.col("h")) + 1).cast("int"))["h"].alias("busiest"))


def hour_peak(spark: SparkSession, d: str) -> DataFrame:
    return figures.hour_peak(_hours(spark, d))


def binned_weeks(spark: SparkSession, d: str) -> DataFrame:
    days = figures.day_figures(figures.credited(_sittings(spark, d)))
    return figures.binned(days, _day(FIRST), _day(LAST), "week")


def finest_grain(spark: SparkSession, d: str) -> DataFrame:
    days = figures.day_figures(figures.credited(_sittings(spark, d)))
    grain, rows = figures.finest({g: figures.binned(days, _day(FIRST), _day(LAST), g) for g in ("day", "week", "month")}, 110)
    return rows.withColumn("grain", F.lit(grain))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return _sittings(spark, d).withColumn("key", F.when(F.col("id") % 4 == 0, F.concat(F.lit("K"), F.col("extent").cast("string"))))


def _witnesses(spark: SparkSession, d: str) -> DataFrame:
    at = dates.at_second(F.to_date("l_shipdate"), (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11) * 37 % 80_000)
    title = F.concat(F.lit("Title "), F.col("l_suppkey") % 3)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("wid"), at.alias("at"), title.alias("title"), F.lit("A").alias("author"), F.lit("").alias("key"), F.col("l_partkey").alias("pos"))


def witnesses_around(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses that sittings of one book alone span."""
    return identify.around(_witnesses(spark, d), _spans(spark, d)).select("wid", "extent", "seconds")


def witness_claims(spark: SparkSession, d: str) -> DataFrame:
    """Books that all witnesses name alike; contested ones are left out."""
    spans, witnesses = _spans(spark, d), _witnesses(spark, d)
    none = spans.select("extent").limit(0)
    named, _ = identify.settled(identify.claims(witnesses, spans, spans.select("extent").distinct(), none))
    return named.select("extent", "name")


_AROUND = f"""w as (select l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as wid, cast(cast(l_shipdate as date) as timestamp) + to_seconds((l_orderkey * 7 + l_linenumber * 11) * 37 % 80000) as at, 'title ' || l_suppkey % 3 as name, l_partkey as pos from lineitem),
  m as (select wid, name, pos, extent, seconds from w join s2 on w.at between s2.started_at and s2.ended_at),
  a as (select wid, min(extent) as extent, max(seconds) as seconds, any_value(name) as name, any_value(pos) as pos from m group by wid having count(distinct extent) = 1)"""


def file_keys(spark: SparkSession, d: str) -> DataFrame:
    """Files whose name holds the key of one book alone: parts and clerks' order papers."""
    books = table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cde_key"), F.lit(0).cast("long").alias("extent"))
    files = table(spark, d, "lineitem").select(F.concat(F.lit("paper_"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.lit("_"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("file"))
    return identify.named_in(files, books)


def containment_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every whole benchmark item in every document, whatever its length."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    return matching.contained(items, table(spark, d, "documents").select("doc_id", "text"), "needle", "text").select("item_id", "doc_id")


def settled_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose words no later turn of the conversation holds, from the middle of a word too."""
    rows = table(spark, d, "conversations").withColumns({"id": F.col("conv_id") * 1000 + F.col("turn"), "body": F.when(F.col("turn") % 2 == 0, F.substring("text", 4, 25)).otherwise(F.col("text"))})
    both = rows.select("conv_id", "id", "body", F.col("turn").alias("at")).unionByName(rows.select("conv_id", (F.col("id") + 500).alias("id"), F.col("text").alias("body"), (F.col("turn") + 100).alias("at")))
    return highlights.settle_words(both, ["conv_id"], "id", "body", "at").select("conv_id", "id")


def alias_chain(spark: SparkSession, d: str) -> DataFrame:
    """Nations joined in chains, each to the one five further on."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    later = n.select((F.col("n_nationkey") - 5).alias("n_nationkey"), F.col("n_name").alias("other"))
    return breakdown.alias_classes(n.join(later, "n_nationkey"), "n_name", "other")


def _values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nothing = F.lit("")
    segments = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("book"), F.lit("publisher").alias("field"), nothing.alias("type"), F.col("c_mktsegment").alias("name"))
    return segments.union(c.select("c_custkey", F.lit("tag"), F.lit("place"), "n_name"))


def ranked_fields(spark: SparkSession, d: str) -> DataFrame:
    """Bars of two fields; two segments are one by a link."""
    held = _values(spark, d)
    joins = spark.createDataFrame([("publisher", "", "BUILDING", ["MACHINERY"], "2024-01-01")], "field string, type string, first string, names array<string>, edited string")
    read = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("book")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("seconds"))
    return breakdown.ranked_by_field(read, held, breakdown.value_names(joins, held)).select("field", "type", "value", "seconds", "n_books", "first_book", "place")


def monthly_split(spark: SparkSession, d: str) -> DataFrame:
    """Each order's price in whole parts over its lines' return flags, by month."""
    read = table(spark, d, "orders").select(F.col("o_orderkey").alias("book"), F.trunc("o_orderdate", "MM").alias("month"), F.floor("o_totalprice").cast("long").alias("seconds"))
    held = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("value"))
    return breakdown.monthly_split(read, held)


def merged_sittings(spark: SparkSession, d: str) -> DataFrame:
    """Two records of the same reading: the other one has later starts of some and ends others elsewhere."""
    a = _sittings(spark, d).select("device", "started_at", "ended_at", F.col("extent").alias("end_position"), "seconds", "time_left", "id")
    later = dates.moved(F.col("started_at"), F.col("id") % 3)
    b = a.select("device", later.alias("started_at"), "ended_at", "end_position", (F.col("seconds") + 1).alias("seconds"), F.lit(7).cast("long").alias("time_left"), "id")
    return late.merge_sittings(a, b).groupBy("end_position").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.sum("time_left").alias("time_left"))


def clock_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes of a clock per device, out of every event's offset."""
    seen = table(spark, d, "events").select("user_id", F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("epoch"), ((F.dayofmonth("ts") % 4) * 3600 + F.when(F.col("user_id") % 5 == 0, 30).otherwise(0)).cast("long").alias("offset"))
    return zones.observed(seen.limit(0), seen, ("user_id",))


def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    secs = F.col("o_orderkey") * 7 % 200_000
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.duration_coarse(secs).alias("coarse"), dates.duration_tight(secs).alias("tight"), dates.short_day(day).alias("short_day"), dates.year_day(day).alias("year_day"),
        dates.long_day(day).alias("long_day"), dates.month_name(day).alias("month_name"), dates.numbered_day(day).alias("numbered_day"), dates.log_of_iso(dates.iso(dates.at_second(day, secs % 86_400))).alias("log_stamp"),
        dates.iso_of_log(dates.log_of_iso(dates.iso(dates.at_second(day, secs % 86_400)))).alias("iso"),
    )


_TAGS = ["en-US", "EN", "eng", "zh-TW", "zh_Hant_HK", "zh-CN", "zh", "zho-Hans", "jpn", " ger ", "", "tlh", "-", "pt_BR", "sr-Latn"]
_CODES = ["en", "en", "en", "zh-Hant", "zh-Hant", "zh-Hans", "zh", "zh-Hans", "ja", "de", "", "tlh", "", "pt", "sr"]


def language_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language with each of some regions and scripts, as one code."""
    tags = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.col("lang"), *map(F.lit, _TAGS))).alias("tag"))
    return tags.select("doc_id", "tag", languages.canonical(F.col("tag")).alias("code"))


def author_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names as authors: flipped, joined and with suffixes."""
    line = F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("c_name"), F.lit(" & "), F.col("c_name"), F.lit(", Jr.&& 春野一郎, 秋山次郎"))
    return table(spark, d, "customer").select("c_custkey", text.joined_names(text.authors(line)).alias("shown"), text.joined_names(text.split_names(line)).alias("stored"))


def match_runs(spark: SparkSession, d: str) -> DataFrame:
    """Where a word stands in each turn, folded."""
    runs = F.explode(text.runs_in(F.col("text"), F.lit("The")))
    return table(spark, d, "conversations").select("conv_id", "turn", runs.alias("r")).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("r.from").cast("long").alias("first"), F.max("r.to").cast("long").alias("last"))


def catalog_books(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of a catalogue."""
    key = F.col("p_partkey")
    entries = table(spark, d, "part").select(
        F.when(key % 5 != 0, key * 10).alias("p_contentSize"), F.when(key % 13 != 0, F.concat(F.lit("B"), key.cast("string"))).alias("p_cdeKey"), F.when(key % 3 == 0, "AUDI").when(key % 3 == 1, "EBOK").alias("p_cdeType"),
        F.col("p_name").alias("p_titles_0_nominal"), F.when(key % 2 == 0, F.concat(F.lit("***"), F.col("p_brand"))).otherwise(F.col("p_brand")).alias("p_credits_0_name_collation"),
        F.when(key % 4 == 0, key % 100).otherwise(-1).alias("p_percentFinished"), F.lit(None).cast("string").alias("p_thumbnail"), key.alias("p_lastAccess"), F.lit("en").alias("p_languages_0"),
        F.when(key % 6 == 1, F.concat(F.lit('[{"kind":"a","display":"Q \\"'), key.cast("string"), F.lit('\\" R"}]'))).alias("j_credits"), F.when(key % 5 != 0, F.concat(F.lit("/d/b"), key.cast("string"), F.lit(".v1.kfx"))).alias("p_location"),
        (key % 8).alias("p_readState"),
    )
    out = catalog.books(entries)
    return out.select("extent", "cde_key", "title", "author", "percent", "on_device", catalog.says_read(F.col("read_state")).alias("says_read"), catalog.stem_of(F.col("location")).alias("stem"))


def record_sittings(spark: SparkSession, d: str) -> DataFrame:
    """Sittings written as rows of a record and read back, hours and stretches too."""
    h = F.array(F.struct(F.lit(7).alias("h"), F.col("seconds").alias("s")), F.struct(F.lit(23).alias("h"), F.lit(5).cast("long").alias("s")))
    path = F.array(F.struct(F.col("progress").alias("from"), (F.col("progress") / 2).alias("to")))
    rows = _sittings(spark, d).withColumns({"end_position": F.col("extent"), "asin": F.when(F.col("id") % 2 == 0, F.concat(F.lit("K\t"), F.col("id").cast("string"))), "hours": h, "stretches": path})
    back = records.decode(records.encode(rows, "s"), "s")
    return back.select("started_at", "ended_at", "end_position", "seconds", "measure", "asin", F.round("progress", 4).alias("progress"), "time_left", F.element_at("hours", 1)["s"].alias("first_hour"), F.round(F.element_at("stretches", 1)["to"], 4).alias("upto"))


def spelled_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags and how most books spell each: names and their capitals."""
    c = table(spark, d, "customer").select("c_custkey", F.array(F.struct(F.lit("Place").alias("type"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("tag"))).alias("tags"))
    return links.spelled(c, "c_custkey", "tags").select("type", "tag", "n_books", F.col("spelling.tag").alias("spelling"))


QUERIES = {
    f.__name__: f
    for f in (
        figures_by_book, figures_by_day, books_of_days, unidentified_span, books_counted, hours_spread, hours_rescaled, hour_peak, binned_weeks, finest_grain, witnesses_around, witness_claims, file_keys,
        containment_whole, settled_bodies, alias_chain, ranked_fields, monthly_split, merged_sittings, clock_changes, duration_texts, language_codes, author_lines, match_runs, catalog_books, record_sittings, spelled_tags,
    )
}

_READ = f"{_SIT}, r as (select * from s2 where seconds >= 60)"
_SPREAD = f"""{_SIT}, e as (select *, least(from_s + seconds * 3, 86400) as to_s from s2 where seconds > 0),
  p as (select id, seconds, timed_seconds, day, from_s, to_s, cast(h as int) as h, case when to_s > from_s then seconds * greatest(least(to_s, (h + 1) * 3600) - greatest(from_s, h * 3600), 0) // (to_s - from_s) else 0 end as part
    from e, unnest(generate_series(from_s // 3600, greatest((to_s - 1) // 3600, from_s // 3600))) as t(h)),
  x as (select id, timed_seconds, day, h as hour, cast(part + case when h = from_s // 3600 then seconds - sum(part) over (partition by id) else 0 end as bigint) as seconds from p)"""
_BINS = """days as (select day, sum(seconds) as s from r group by 1)"""
_DUR = """case when s < 24 * 3600 then case when s <= 0 then '0m' when s < 60 then '<1m' when (s + 30) // 3600 = 0 then (s + 30) // 60 || 'm' when (s + 30) // 60 % 60 = 0 then (s + 30) // 3600 || 'h'
  else (s + 30) // 3600 || 'h ' || (s + 30) // 60 % 60 || 'm' end else (s + 1800) // 3600 || 'h' end"""
ORACLES = {
    "figures_by_book": f"""with {_SIT}, r as (select *, app_read >= 60 as c from s2)
      select book, seconds, counted_seconds, words, days, sittings, page_turns, first_day, last_day, covered_seconds, stated_time_left, stated_wpm, case when days > 0 then seconds // days else 0 end as per_day,
        case when sittings > 0 then seconds // sittings else 0 end as per_sitting, greatest(datediff('day', first_day, last_day) + 1, 1) as span_days, case when words > 0 and seconds > 0 then words * 60 // seconds end as wpm, counted_of_measure, awake_of_measure, covered, progress
      from (select book, cast(coalesce(sum(app_read) filter (where c), 0) as bigint) as seconds, cast(coalesce(sum(seconds) filter (where c), 0) as bigint) as counted_seconds, cast(coalesce(sum(app_words) filter (where c), 0) as bigint) as words,
        count(distinct day) filter (where c) as days, count(*) filter (where c) as sittings, cast(coalesce(sum(page_turns) filter (where c), 0) as bigint) as page_turns, min(day) filter (where c) as first_day, max(day) filter (where c) as last_day,
        cast(coalesce(sum(paged_seconds) filter (where c and covered > 0), 0) as bigint) as covered_seconds, arg_max(time_left, ended_at) filter (where c and time_left is not null) as stated_time_left,
        arg_max(stated_wpm, ended_at) filter (where c and stated_wpm is not null) as stated_wpm, cast(coalesce(sum(seconds) filter (where c and measure = 'counted'), 0) as bigint) as counted_of_measure,
        cast(coalesce(sum(seconds) filter (where c and measure = 'awake'), 0) as bigint) as awake_of_measure, round(coalesce(sum(covered) filter (where c), 0), 6) as covered, round(arg_max(progress, ended_at) filter (where c) * 100, 6) as progress
      from r where book is not null group by book)""",
    "figures_by_day": f"with {_READ} select day, cast(sum(seconds) as bigint) as seconds, cast(sum(page_turns) as bigint) as page_turns, max(seconds) as longest, count(distinct book) as n_books from r group by day",
    "books_of_days": f"""with {_READ} select day, book, cast(s as bigint) as seconds, cast(row_number() over (partition by day order by s desc, book) as int) as place
      from (select day, book, sum(seconds) as s from r where book is not null group by 1, 2)""",
    "unidentified_span": f"with {_READ} select count(distinct extent) as n_books, cast(coalesce(sum(seconds), 0) as bigint) as seconds from r where book is null and day between date '{FIRST}' and date '{LAST}'",
    "books_counted": f"with {_READ} select count(distinct book) as named, count(distinct case when book is null then extent end) as unnamed from r",
    "hours_spread": f"with {_SPREAD} select id, hour, seconds from x where seconds > 0",
    "hours_rescaled": f"""with {_SPREAD}, y as (select id, timed_seconds as target, hour, seconds, sum(seconds) over (partition by id) as total from x where seconds > 0),
      z as (select *, case when total = target then seconds else seconds * target // total end as s from y), g as (select * from z where s > 0 or total = target),
      n as (select id, count(*) as n_hours, any_value(target) as target, arg_max(hour, s * 100 + hour) as busiest from g group by id),
      f as (select id, any_value(target) as target, arg_min(hour, hour) as first_hour from y group by id)
      select f.id, coalesce(n_hours, 1) as n_hours, cast(f.target as bigint) as seconds, coalesce(busiest, first_hour) as busiest from f left join n on n.id = f.id""",
    "hour_peak": f"with {_SPREAD} select cast(max(s) as bigint) as seconds from (select day, hour, sum(seconds) as s from x group by 1, 2)",
    "binned_weeks": f"""with {_READ}, {_BINS} select cast(b as date) as bin, cast(coalesce(sum(s), 0) as bigint) as seconds
      from generate_series(date_trunc('week', date '{FIRST}')::timestamp, timestamp '{LAST}', interval 7 day) as t(b) left join days on day between date '{FIRST}' and date '{LAST}' and date_trunc('week', day) = b group by 1""",
    "finest_grain": f"""with {_READ}, {_BINS} select cast(b as date) as bin, cast(coalesce(sum(s), 0) as bigint) as seconds, 'week' as grain
      from generate_series(date_trunc('week', date '{FIRST}')::timestamp, timestamp '{LAST}', interval 7 day) as t(b) left join days on day between date '{FIRST}' and date '{LAST}' and date_trunc('week', day) = b group by 1""",
    "witnesses_around": f"with {_SIT}, {_AROUND} select wid, extent, seconds from a",
    "witness_claims": f"with {_SIT}, {_AROUND} select extent, min(name) as name from a where seconds >= 60 and pos <= extent group by extent having count(distinct name) = 1",
    "file_keys": """with f as (select distinct 'paper_' || lpad(l_partkey::varchar, 10, '0') || '_' || lpad(l_suppkey::varchar, 9, '0') as file from lineitem), b as (select lpad(p_partkey::varchar, 10, '0') as cde_key from part)
      select file, min(cde_key) as cde_key from f join b on contains(file, cde_key) group by file having count(distinct cde_key) = 1""",
    "containment_whole": "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''",
    "settled_bodies": r"""with r as (select conv_id, conv_id * 1000 + turn as id, case when turn % 2 = 0 then substring(text, 4, 25) else text end as body, turn as at from conversations union all select conv_id, conv_id * 1000 + turn + 500, text, turn + 100 from conversations),
      c as (select *, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) as b from r)
      select conv_id, id from c where not exists (select 1 from c o where o.conv_id = c.conv_id and o.id <> c.id and (o.at > c.at or o.at = c.at and o.id > c.id) and c.b <> '' and contains(o.b, c.b))""",
    "alias_chain": "select lower(n_name) as name, min(lower(n_name)) over (partition by n_nationkey % 5) as class from nation",
    "ranked_fields": """with h as (select c_custkey as book, 'publisher' as field, '' as type, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'BM' else c_mktsegment end as value, c_mktsegment as name from customer where c_custkey % 11 <> 0
        union all select c_custkey, 'tag', 'place', n_name, n_name from customer join nation on c_nationkey = n_nationkey),
      n as (select field, type, value, name, count(distinct book) as c from h group by all), b as (select field, type, value, first(name order by c desc, name) as shown from n group by all),
      r as (select o_custkey as book, sum(cast(floor(o_totalprice) as bigint)) as seconds from orders group by 1 having sum(floor(o_totalprice)) > 0), f as (select distinct field, type from h),
      j as (select r.book, r.seconds, f.field, f.type, b.shown as value from r cross join f left join h on h.book = r.book and h.field = f.field and h.type = f.type left join b on b.field = h.field and b.type = h.type and b.value = h.value),
      g as (select field, type, value, sum(seconds) as s, count(distinct book) as n_books, min(book) as first_book from j group by all)
      select field, type, value, cast(s as bigint) as seconds, n_books, first_book, cast(row_number() over (partition by field, type order by s desc, value nulls last) as int) as place from g""",
    "monthly_split": """with v as (select l_orderkey as book, l_returnflag as value, min(l_linenumber) as no from lineitem group by 1, 2), k as (select book, value, row_number() over (partition by book order by no, value) - 1 as place, count(*) over (partition by book) as k from v)
      select cast(date_trunc('month', o_orderdate) as date) as month, value, cast(sum(cast(floor(o_totalprice) as bigint) // k + case when place < cast(floor(o_totalprice) as bigint) % k then 1 else 0 end) as bigint) as seconds
      from orders join k on book = o_orderkey group by 1, 2""",
    "merged_sittings": f"""with {_SIT}, u as (select extent, started_at, ended_at, seconds, time_left, 0 as o from s2 union all select extent, started_at + to_seconds(id % 3), ended_at, seconds + 1, 7, 1 from s2),
      c as (select *, row_number() over w as n, coalesce(time_left, first_value(time_left ignore nulls) over (partition by extent, ended_at order by started_at, o rows between unbounded preceding and unbounded following)) as t from u window w as (partition by extent, ended_at order by started_at, o)),
      s as (select *, row_number() over (partition by extent, started_at order by ended_at desc) as m from c where n = 1)
      select extent as end_position, count(*) as n, cast(sum(seconds) as bigint) as seconds, cast(sum(t) as bigint) as time_left from s where m = 1 group by extent""",
    "clock_changes": """with e as (select user_id, cast(epoch(date_trunc('hour', ts)) as bigint) as epoch, min(day(ts) % 4 * 3600) as o from events where user_id % 5 <> 0 group by 1, 2), l as (select *, lag(o) over (partition by user_id order by epoch) as p from e)
      select user_id, epoch, cast(o as bigint) as "offset" from l where p is null or p <> o""",
    "duration_texts": f"""with q as (select o_orderkey, o_orderkey * 7 % 200000 as s, cast(o_orderdate as date) as d from orders)
      select o_orderkey, {_DUR} as coarse, case when s < 60 then '·' when (s + 30) // 3600 = 0 then (s + 30) // 60 || 'm' else (s + 30) // 3600 || 'h' || lpad(((s + 30) // 60 % 60)::varchar, 2, '0') end as tight,
        strftime(d, '%b %-d') as short_day, strftime(d, '%b %-d, %Y') as year_day, strftime(d, '%a, %-d %B %Y') as long_day, strftime(d, '%B %Y') as month_name, strftime(d, '%Y年%-m月%-d日') as numbered_day,
        strftime(cast(d as timestamp) + to_seconds(s % 86400), '%y%m%d:%H%M%S') as log_stamp, strftime(cast(d as timestamp) + to_seconds(s % 86400), '20%y-%m-%dT%H:%M:%S') as iso from q""",
    "language_codes": f"""with t as (select unnest({_TAGS!r}) as tag, unnest({_CODES!r}) as code) select doc_id, lang as tag, lang as code from documents union all select doc_id, tag, code from documents, t""",
    "author_lines": """select c_custkey, c_name || ' ' || c_mktsegment || ' & ' || c_name || ', Jr. & 春野一郎 & 秋山次郎' as shown, c_mktsegment || ', ' || c_name || ' & ' || c_name || ', Jr. & 春野一郎 & 秋山次郎' as stored from customer""",
    "match_runs": "with p as (select conv_id, turn, string_split(lower(text), 'the') as p, length(text) as n from conversations) select conv_id, turn, len(p) - 1 as n, length(p[1]) as first, n - length(p[-1]) as last from p where len(p) > 1",
    "catalog_books": r"""select case when p_partkey % 5 <> 0 then p_partkey * 10 else 0 end as extent, 'B' || p_partkey as cde_key, p_name as title, case when p_partkey % 6 = 1 then 'Q "' || p_partkey || '" R' else p_brand end as author,
        case when p_partkey % 4 = 0 then cast(p_partkey % 100 as double) end as percent, p_partkey % 5 <> 0 as on_device, case when p_partkey % 8 in (1, 2, 4) then true when p_partkey % 8 in (3, 5, 6) then false end as says_read,
        case when p_partkey % 5 <> 0 then 'b' || p_partkey || '.v1' else '' end as stem from part where p_partkey % 13 <> 0 and p_partkey % 3 <> 0""",
    "record_sittings": f"""with {_SIT} select started_at, ended_at, extent as end_position, seconds, measure, case when id % 2 = 0 then 'K' || chr(9) || id end as asin, round(progress, 4) as progress, time_left, seconds as first_hour, round(round(progress / 2 * 10000) / 10000, 4) as upto from s2""",
    "spelled_tags": """with t as (select c_custkey as b, case when c_custkey % 3 = 0 then upper(c_mktsegment) else upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) end as tag from customer), n as (select 'Place' as type, tag, count(distinct b) as n_books from t group by tag)
      select type, tag, n_books, first_value(tag) over (partition by lower(tag) order by n_books desc, tag) as spelling from n""",
}
