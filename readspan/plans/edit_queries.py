"""Queries over edits and highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.operators import edits, highlights
from readspan.plans.tables import table


def _books(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("percent"), (F.col("p_size") > 45).alias("finished"), F.array(F.col("p_size")).alias("restarted_on"), F.when(F.col("p_size") % 7 == 0, 20.0).alias("restart"))


def bank_reading(spark: SparkSession, d: str) -> DataFrame:
    out = edits.bank_reading(_books(spark, d), F.col("finished"), F.lit(99))
    return out.select("p_partkey", "percent", "finished", F.size("restarted_on").alias("readings"), F.element_at("restarted_on", -1).alias("last"))


def set_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = _books(spark, d).withColumn("told", F.col("percent") * 2.2)
    return edits.set_progress(rows, "told").select("p_partkey", F.bround("percent", 3).alias("percent"), "finished")


def clear_books(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    keys = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    none = o.select("o_custkey", F.lit("held").alias("at")).limit(0)
    left, stones = edits.clear(o, none, keys, "o_custkey", F.lit("now"))
    return left.groupBy(F.lit("left").alias("what")).agg(F.count("*").alias("n")).unionByName(stones.groupBy(F.lit("tombstones").alias("what")).agg(F.count("*").alias("n")))


def _patches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return rows, rows.where("s_suppkey % 4 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 8 == 0, F.concat("s_name", F.lit("!"))).alias("s_name"), F.when(F.col("s_nationkey") > 5, F.lit(5)).alias("s_nationkey"))


def patch_books(spark: SparkSession, d: str) -> DataFrame:
    return edits.patch(*_patches(spark, d), "s_suppkey", ["s_name", "s_nationkey"])[0]


def patch_undo(spark: SparkSession, d: str) -> DataFrame:
    return edits.patch(*_patches(spark, d), "s_suppkey", ["s_name", "s_nationkey"])[1]


def rename_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return edits.rename_value(rows, "roles", "system", "user").select("conv_id", F.array_join(F.array_sort("roles"), ",").alias("roles"))


def edit_stamps(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", edits.edit_stamp(F.col("o_orderdate"), now).alias("edited"))


def settle_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return highlights.settle_exact(rows, "l_orderkey", "l_suppkey", "l_suppkey", "l_shipdate", F.desc("l_linenumber"))


def settle_words(spark: SparkSession, d: str) -> DataFrame:
    """First sentences of documents, dropped where a later document of the language holds them in its own."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.substring_index("text", ".", 1).alias("body"))
    return highlights.settle_words(rows, ["lang"], "doc_id", "body", "doc_id", whole_words=True).select("doc_id")


def match_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as clips and views as notes of a user, over the offsets of no, one and two hours."""
    ev = table(spark, d, "events").withColumn("minute", F.date_trunc("minute", F.col("ts").cast("timestamp")))
    clips = ev.where("event_type = 'click'").select("user_id", "minute", F.col("event_id").alias("clip_id"))
    notes = ev.where("event_type = 'view'").select("user_id", "minute", F.col("event_id").alias("note_id"))
    offsets = spark.range(3).select((F.col("id") * 3600).alias("offset_s"), F.col("id").cast("int").alias("rank"))
    return highlights.match_offsets(clips, notes, "user_id", "minute", "minute", offsets)


def journal_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return highlights.journal(rows, "o_orderdate", "o_custkey", "o_orderkey").select("o_orderkey", "newest", "day_place")


QUERIES = {f.__name__: f for f in (bank_reading, set_progress, clear_books, patch_books, patch_undo, rename_value, edit_stamps, settle_exact, settle_words, match_offsets, journal_places)}

_PATCH = """p as (select s_suppkey, case when s_suppkey % 8 = 0 then s_name || '!' end as n, case when s_nationkey > 5 then 5 end as k from supplier where s_suppkey % 4 = 0),
  b as (select s.*, p.n, p.k from supplier s left join p using (s_suppkey))"""
ORACLES = {
    "bank_reading": """select p_partkey, case when p_size > 45 then 0 else cast(p_size as double) end as percent, false as finished, cast(case when p_size > 45 then 2 else 1 end as int) as readings,
        cast(case when p_size > 45 then 99 else p_size end as int) as last from part""",
    "set_progress": """with t as (select p_partkey, p_size, greatest(cast(p_size as double) * 2.2, case when p_size % 7 = 0 then 20.0 else 0.0 end) as p from part)
        select p_partkey, round_even(cast(p as double), 3) as percent, p_size > 45 or p >= 99.5 as finished from t""",
    "clear_books": """with k as (select c_custkey from customer where c_acctbal < 0) select 'left' as what, count(*) as n from orders where o_custkey not in (select c_custkey from k) union all select 'tombstones', count(*) from k""",
    "patch_books": f"with {_PATCH} select s_suppkey, coalesce(n, s_name) as s_name, coalesce(k, s_nationkey) as s_nationkey from b",
    "patch_undo": f"with {_PATCH} select s_suppkey, s_name, s_nationkey from b where (n is not null and n <> s_name) or (k is not null and k <> s_nationkey)",
    "rename_value": "select conv_id, string_agg(distinct case when role = 'system' then 'user' else role end, ',' order by case when role = 'system' then 'user' else role end) as roles from conversations group by 1",
    "edit_stamps": "select o_orderkey, greatest(timestamp '1996-01-01', o_orderdate + interval 1 second) as edited from orders",
    "settle_exact": """with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() over (partition by l_orderkey, l_suppkey order by l_shipdate desc, l_linenumber desc) as n from lineitem)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from r where n = 1""",
    "settle_words": r"""with b as (select doc_id, lang, lower(trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g'))) as b from documents)
        select doc_id from b x where not exists (select 1 from b y where y.lang = x.lang and y.doc_id > x.doc_id and x.b <> '' and contains(y.b, x.b) and list_contains(string_split(y.b, ' '), split_part(x.b, ' ', 1)))""",
    "match_offsets": """with e as (select event_id, user_id, event_type, epoch(date_trunc('minute', ts)) as t from events),
        m as (select c.event_id as clip_id, n.event_id as note_id, o.range as rank from e c join e n on c.user_id = n.user_id and c.event_type = 'click' and n.event_type = 'view' join range(3) o on c.t = n.t + o.range * 3600),
        r as (select *, row_number() over (partition by clip_id order by rank, note_id) as a, row_number() over (partition by note_id order by rank, clip_id) as b from m), p as (select clip_id, note_id, rank from r where a = 1 and b = 1)
        select c.event_id as clip_id, n.event_id as note_id, cast(p.rank as int) as rank, case when c.event_id is null then 'wordless' when n.event_id is null then 'unconfirmed' else 'live' end as state
        from (select * from e where event_type = 'click') c left join p on p.clip_id = c.event_id full join (select * from e where event_type = 'view') n on n.event_id = p.note_id""",
    "journal_places": """select o_orderkey, max(o_orderdate) over (partition by o_custkey) as newest, row_number() over (partition by cast(o_orderdate as date) order by o_orderdate desc, o_orderkey) as day_place from orders""",
}
