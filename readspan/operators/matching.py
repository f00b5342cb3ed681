"""Ranked evidence: unique matches, unanimous witnesses, coalesced lookups, pairings and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import intdiv, micros_between
from readspan.operators.grams import least_words, listed_words


def only(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` with their single distinct value; keys with several are left out rather than guessed."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("__n"), F.first(value, ignorenulls=True).alias(value)).where("__n = 1").drop("__n")


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str], l_value: str, r_value: str) -> DataFrame:
    """Equi-join of the keys that stand once on both sides."""
    return only_once(left, keys).select(*keys, l_value).join(only_once(right, keys).select(*keys, r_value), keys)


def only_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def unanimous(claims: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Keys whose claims all name one value, with the greatest weight; contested keys are left out."""
    out = claims.groupBy(key).agg(F.countDistinct(value).alias("__n"), F.min(value).alias(value), F.max(weight).alias(weight), F.count("*").alias("n_claims"))
    return out.where("__n = 1").drop("__n")


def ranked_claims(claims: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """The value of each key's strongest rank; a key is contested, and left out, if that rank names several."""
    best = claims.withColumn("__b", F.min(rank).over(Window.partitionBy(key))).where(F.col(rank) == F.col("__b")).drop("__b")
    return only(best, [key, rank], value)


def coalesced_lookup(rows: DataFrame, lookups: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """``value`` from the first of ``lookups`` (table with key and value, key) that knows the row; null if none does."""
    found: list[Column] = []
    for i, (table, key) in enumerate(lookups):
        rows = rows.join(table.select(F.col(key), F.col(value).alias(f"__v{i}")), key, "left")
        found.append(F.col(f"__v{i}"))
    return rows.withColumn(value, F.coalesce(*found)).drop(*(f"__v{i}" for i in range(len(lookups))))


def pair_in_order(left: DataFrame, right: DataFrame, group: list[str], l_order: str, r_order: str) -> DataFrame:
    """The n-th of one side with the n-th of the other, in groups where both sides have as many rows."""

    def placed(rows: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy(*group)
        return rows.withColumns({"pos": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)})

    return placed(left, l_order).join(placed(right, r_order), [*group, "__n", "pos"]).drop("__n")


def offsets_seen(left: DataFrame, right: DataFrame, kind: str, l_at: str, r_at: str, unit_s: int, reach_s: int, least: int = 2) -> DataFrame:
    """Band join: how often each whole ``unit_s`` offset within ``reach_s`` parts rows of one kind, most supported first.

    Times are cut into buckets as wide as the reach and each left row looks into its own and the two beside it,
    so the join is by equality on kind and bucket.
    """
    secs = lambda c: intdiv(F.unix_micros(F.col(c).cast("timestamp")), 1_000_000)
    a = left.select(kind, secs(l_at).alias("a")).withColumn("bucket", F.explode(F.array(*(intdiv(F.col("a"), reach_s) + d for d in (-1, 0, 1)))))
    b = right.select(kind, secs(r_at).alias("b")).withColumn("bucket", intdiv(F.col("b"), reach_s))
    gap = F.col("b") - F.col("a")
    near = a.join(b, [kind, "bucket"]).where((F.abs(gap) <= reach_s) & (gap % unit_s == 0))
    return near.groupBy(kind, intdiv(gap, unit_s).alias("offset")).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def narrowest(met: DataFrame, point: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Of the spans that hold a point the narrowest, the earliest ``tie`` of equals."""
    w = Window.partitionBy(*point).orderBy(F.col(end) - F.col(start), tie) if start == end else Window.partitionBy(*point).orderBy(micros_between(F.col(start), F.col(end)), tie)
    return met.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Short needles up to which they are broadcast to the texts.
SHORT_NEEDLES = 10_000


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Pairs whose text contains the needle, any that isn't empty.

    Needles of five words and more meet by an equi-join on three of their inner words in a row, those of the smallest
    hash, which are whole words of any text that contains the needle. Each text is named by its hash and length once,
    below the step that lists its words in threes; names are joined, and texts fetched for what met. Others (shorter, or with
    other white space) have no such key and are looked for in every text, by a broadcast while they are few.
    """
    inner = F.regexp_extract(needle, r"(?s)^\S+[ \n]+(.*\S)[ \n]+\S+\s*$", 1)
    plain = ~F.col(needle).rlike(r"^\s|[\t\r\f\x0B]")
    needles = needles.where(F.col(needle) != "").withColumn("__k", least_words(F.when(plain, inner).otherwise("")))
    named = texts.withColumns({"__h": F.xxhash64(F.col(text)), "__n": F.length(text)})
    keys = listed_words(named, ["__h", "__n"], text)
    long = needles.where("__k is not null")
    hits = keys.join(long.select(F.col(needle).alias("__w"), "__k").distinct(), "__k").select("__w", "__h", "__n").distinct()
    met = hits.join(named, ["__h", "__n"]).where(F.col(text).contains(F.col("__w"))).drop("__h", "__n")
    found = long.drop("__k").join(met, F.col(needle) == F.col("__w")).drop("__w")
    short = needles.where("__k is null").drop("__k")
    few = short.limit(SHORT_NEEDLES + 1).count() <= SHORT_NEEDLES
    rest = (F.broadcast(short) if few else short).join(texts, F.col(text).contains(F.col(needle)))
    return found.unionByName(rest)
