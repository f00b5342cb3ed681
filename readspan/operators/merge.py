"""Merges of several sources: last writer wins, upserts, tombstones, incremental tails and device unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer(rows: DataFrame, keys: list[str], edited: str, *ties: Column) -> DataFrame:
    """One row a key: the latest ``edited``, and by ``ties`` of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(edited).desc(), *ties)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def take(held: DataFrame, new: DataFrame, keys: list[str], edited: str) -> DataFrame:
    """``new`` over ``held``: a row is replaced only by a later one, so an equal stamp keeps what is held."""
    both = held.withColumn("__new", F.lit(1)).unionByName(new.withColumn("__new", F.lit(2)))
    return last_writer(both, keys, edited, F.col("__new").asc()).drop("__new")


def upsert(held: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge: new values where stated, else the held ones; ``change`` is added, changed, same or gone."""
    h = held.select(key, F.lit(True).alias("__h"), *(F.col(c).alias(f"__h_{c}") for c in columns))
    n = new.select(key, F.lit(True).alias("__n"), *(F.col(c).alias(f"__n_{c}") for c in columns))
    both = h.join(n, key, "full")
    same = reduce(lambda a, b: a & b, (F.col(f"__n_{c}").isNull() | F.col(f"__n_{c}").eqNullSafe(F.col(f"__h_{c}")) for c in columns))
    change = F.when(F.col("__h").isNull(), "added").when(F.col("__n").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select(key, *(F.coalesce(f"__n_{c}", f"__h_{c}").alias(c) for c in columns), change.alias("change"))


def live(rows: DataFrame, cleared: DataFrame, key: str, at: str, cleared_at: str) -> DataFrame:
    """Rows at or after their key's clear stamp, and rows of keys without one."""
    stamps = cleared.groupBy(key).agg(F.max(cleared_at).alias("__c"))
    return rows.join(stamps, key, "left").where(F.col("__c").isNull() | (F.col(at) >= F.col("__c"))).drop("__c")


def one_per_close(rows: DataFrame, start_key: list[str], close: str, end: str, end_key: list[str], start: str) -> DataFrame:
    """One row a start, the latest close; then one a close, the earliest start."""
    first = last_writer(rows, start_key, close)
    w = Window.partitionBy(*end_key, end).orderBy(F.col(start).asc())
    return first.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def contains_all(part: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows of ``part`` are missing in ``whole``, and whether none is."""
    missing = part.select(columns).distinct().join(whole.select(columns).distinct(), columns, "left_anti")
    return missing.agg(F.count("*").alias("n_missing")).withColumn("contained", F.col("n_missing") == 0)


def together(sources: dict[str, DataFrame], column: str = "device") -> DataFrame:
    """The union of several devices' rows, each tagged with its device."""
    parts = [df.withColumn(column, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def replace_tail(held: DataFrame, parsed: DataFrame, start: str, cut: Column) -> DataFrame:
    """Incremental batch: what began before ``cut`` stays, everything later comes from the new parse."""
    return held.where(F.col(start) < cut).unionByName(parsed.where(F.col(start) >= cut))
