"""Time zones as change tables: offsets in force, next changes, local times of epochs."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readspan.functions.dates import plausible


def read_tzif(spark: SparkSession, path: str) -> DataFrame:
    """``(since, offset_s, dst)`` of a compiled zone file; the row without ``since`` holds before the first change.

    A zone is some hundred changes, decoded where the file is opened; the 64-bit part is read if there is one.
    """
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    if data[:4] != b"TZif":
        raise ValueError("no zone file")

    def part(at: int, wide: bool) -> tuple[list[tuple], int]:
        isut, isstd, leap, times, kinds, chars = struct.unpack_from(">6I", data, at + 20)
        size, at = (8 if wide else 4), at + 44
        changes = struct.unpack_from(f">{times}{'q' if wide else 'i'}", data, at)
        index = data[at + times * size : at + times * (size + 1)]
        at += times * (size + 1)
        info = [struct.unpack_from(">iBB", data, at + 6 * i) for i in range(kinds)]
        end = at + 6 * kinds + chars + leap * (size + 4) + isstd + isut
        if list(changes) != sorted(changes) or any(i >= kinds for i in index):
            raise ValueError("malformed zone file")
        first = next((k for k in info if not k[1]), info[0])
        return [(None, first[0], bool(first[1])), *((t, info[i][0], bool(info[i][1])) for t, i in zip(changes, index, strict=True))], end

    rows, end = part(0, False)
    if data[4:5] >= b"2":
        rows, _ = part(end, True)
    return spark.createDataFrame(rows, "since long, offset_s int, dst boolean")


def local_time(epoch: Column, offset: Column) -> Column:
    """Wall clock of an epoch second; null outside the years 1900 to 9999."""
    secs = epoch + offset
    inside = secs.between(-2208988800, 253402300799)
    return F.when(inside, F.timestamp_seconds(F.when(inside, secs)).cast("timestamp_ntz"))


#: Changes of a zone: some hundred by nature; a table of more is no zone.
CHANGES = 10_000


def localised(rows: DataFrame, zone: DataFrame, epoch: str) -> DataFrame:
    """``rows`` with ``offset_s`` in force at ``epoch`` and the ``local`` wall clock.

    A zone is one array of changes, sorted by time and sent to every task; the first offset holds before the first change.
    """
    changes = zone.select(F.struct(F.coalesce("since", F.lit(-(2**62))).alias("since"), "offset_s").alias("c"))
    whole = changes.limit(CHANGES + 1).agg(F.sort_array(F.collect_list("c")).alias("__z"), F.count("*").alias("__n"))
    whole = whole.select(F.when(F.col("__n") <= CHANGES, F.col("__z")).otherwise(F.raise_error(F.lit("more changes than a zone has"))).alias("__z"))
    joined = rows.join(F.broadcast(whole), F.lit(True))  # one row
    past = F.filter("__z", lambda z: z["since"] <= F.col(epoch))
    offset = F.coalesce(F.try_element_at(past, F.lit(-1))["offset_s"], F.try_element_at("__z", F.lit(1))["offset_s"])
    return joined.withColumn("offset_s", offset).drop("__z").withColumn("local", local_time(F.col(epoch), F.col("offset_s")))


def next_change(rows: DataFrame, zone: DataFrame, epoch: str) -> DataFrame:
    """``rows`` with ``changes_at``, the first change after ``epoch``; null after the last. Raises if ``zone`` has more changes than CHANGES."""
    whole = zone.where("since is not null").select("since").limit(CHANGES + 1).agg(F.sort_array(F.collect_list("since")).alias("__z"), F.count("*").alias("__n"))
    whole = whole.select(F.when(F.col("__n") <= CHANGES, F.col("__z")).otherwise(F.raise_error(F.lit("more changes than a zone has"))).alias("__z"))
    after = F.filter("__z", lambda z: z > F.col(epoch))
    return rows.join(F.broadcast(whole), F.lit(True)).withColumn("changes_at", F.try_element_at(after, F.lit(1))).drop("__z")  # one row


def offset_text(offset: Column) -> Column:
    """``+02:00``."""
    return F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(F.abs(offset) / 3600), F.floor(F.abs(offset) / 60) % 60)


def rle(changes: DataFrame, since: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Changes that change something: the first of each run of equal values, by ``keys`` (without any, a table of CHANGES rows at most)."""
    before = F.lag(value).over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(since))
    return changes.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def observed(held: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A clock (epoch, offset) after more was seen: plausible offsets only, one an epoch (the held one), and only changes."""
    both = held.withColumn("__new", F.lit(0)).unionByName(seen.withColumn("__new", F.lit(1))).where(plausible(F.col("offset")))
    w = Window.partitionBy(*keys, "epoch").orderBy("__new", "offset")
    once = both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")
    return rle(once, "epoch", "offset", keys)


def offsets(clock: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The offsets of a clock, each once, with the epoch from which it was first in force."""
    return clock.groupBy(*keys, "offset").agg(F.min("epoch").alias("first"))
