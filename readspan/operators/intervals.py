"""Interval joins, as-of joins, overlaps and exact proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import intdiv, micros_between


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def covering(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every span that holds it (both ends count), by an equi-join on keys and hour.

    A span is repeated once for each hour it touches, so work goes with points and hours of spans, not with
    their product; a span-point pair meets in exactly one hour.
    """
    p = points.withColumn("__h", hour_of(F.col(at)))
    s = spans.withColumn("__h", F.explode(F.sequence(hour_of(F.col(start)), hour_of(F.col(end)), F.expr("interval 1 hour"))))
    return p.join(s, ["__h", *keys]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__h")


def as_of(points: DataFrame, changes: DataFrame, at: str, since: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with the ``value`` in force at ``at``; before the first change the first value holds.

    Points and changes are one sorted sequence by key, in which each point takes the last change before it: one
    shuffle and no range join. A change at the same instant is in force. Raises without keys: the sequence would be one task's.
    """
    if not keys:
        raise ValueError("as_of needs a key that parts its rows")
    p = points.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__v": F.lit(None).cast(changes.schema[value].dataType)})
    c = changes.select(*keys, F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    both = p.unionByName(c, allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(last, first)).where("__kind = 1").drop("__at", "__kind", "__v")


def spans_inside(sittings: DataFrame, spans: DataFrame, key: str, id_col: str, start: str = "started_at", end: str = "ended_at", s_start: str = "from_at", s_end: str = "to_at", n: int | None = None) -> DataFrame:
    """``sittings`` with ``inside``: the parts of its key's spans within each, in order, as array<struct<a,b>> of epoch seconds.

    Sittings and spans meet by key and day, and a pair counts on the first day that both have; spans of a key don't
    overlap, so the array is as long as the changes during one sitting. From it wall time is mapped to span time and back.
    With ``n`` rows meet in as many tasks, and if there are no spans they aren't moved.
    """
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    if n and spans.isEmpty():
        return sittings.withColumn("inside", none)
    dealt = lambda df, *keys: df.repartition(n, *keys) if n else df
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    left = sittings.select(id_col, key, F.col(start).alias("__s"), F.col(end).alias("__e"), days(start, end).alias("__d"))
    right = spans.select(key, F.col(s_start).alias("__a"), F.col(s_end).alias("__b"), days(s_start, s_end).alias("__d"))
    low, high = F.greatest("__s", "__a"), F.least("__e", "__b")
    met = dealt(left, key, "__d").join(dealt(right, key, "__d"), [key, "__d"]).where((low < high) & (F.col("__d") == F.to_date(low)))
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    part = F.struct(secs(low).alias("a"), secs(high).alias("b"))
    found = dealt(met, id_col).groupBy(id_col).agg(F.sort_array(F.collect_list(part)).alias("inside"))
    return dealt(sittings, id_col).join(found, id_col, "left").withColumn("inside", F.coalesce("inside", none))


def seconds_in(spans: Column, start: Column, end: Column) -> Column:
    """Seconds of ``spans`` (array of a and b) between two epoch seconds."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.least(x["b"], end) - F.greatest(x["a"], start), F.lit(0)))


def shared_over(spans: Column, start: Column, end: Column, amount: Column) -> Column:
    """``array<struct<a,b,ms>>``: ``amount`` over the parts of ``spans`` between two epoch seconds by their length, truncated; the first part's start takes the rest. Without such parts all of it goes to the whole."""
    piece = lambda a, b, ms: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ms.cast("long").alias("ms"))
    total = seconds_in(spans, start, end)
    parts = F.filter(F.transform(spans, lambda x: F.struct(F.greatest(x["a"], start).alias("a"), F.least(x["b"], end).alias("b"))), lambda x: x["b"] > x["a"])
    shared = F.transform(parts, lambda x: piece(x["a"], x["b"], intdiv(amount * (x["b"] - x["a"]), F.greatest(total, F.lit(1)))))
    given = F.aggregate(shared, F.lit(0).cast("long"), lambda acc, x: acc + x["ms"])
    first = F.try_element_at(parts, F.lit(1))["a"]
    return F.when(total <= 0, F.array(piece(start, end, amount))).otherwise(F.concat(shared, F.array(piece(first, first, amount - given))))


def overlap_seconds(sittings: DataFrame, spans: DataFrame, key: str, id_col: str, start: str = "started_at", end: str = "ended_at", s_start: str = "from_at", s_end: str = "to_at") -> DataFrame:
    """``sittings`` with ``overlap``: whole seconds of each that spans of its key cover (spans of a key don't overlap)."""
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    left = sittings.select(id_col, key, F.col(start).alias("__s"), F.col(end).alias("__e"), days(start, end).alias("__d"))
    right = spans.select(key, F.col(s_start).alias("__a"), F.col(s_end).alias("__b"), days(s_start, s_end).alias("__d"))
    met = left.join(right, [key, "__d"])
    low = F.greatest("__s", "__a", F.col("__d").cast("timestamp_ntz"))
    high = F.least("__e", "__b", F.date_add("__d", 1).cast("timestamp_ntz"))
    inside = met.groupBy(id_col).agg(F.sum(F.greatest(micros_between(low, high), F.lit(0))).alias("__us"))
    return sittings.join(inside, id_col, "left").withColumn("overlap", intdiv(F.coalesce("__us", F.lit(0)), 1_000_000)).drop("__us")


def state_spans(changes: DataFrame, key: str, at: str, state: str, on: str, order: str) -> DataFrame:
    """``(key, from_at, to_at)`` for each time the state was ``on``: repeats are dropped, an open last span too."""
    w = Window.partitionBy(key).orderBy(at, order)
    kept = changes.withColumn("__p", F.lag(state).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(state)))
    out = kept.withColumn("to_at", F.lead(at).over(w)).where((F.col(state) == on) & F.col("to_at").isNotNull())
    return out.select(key, F.col(at).alias("from_at"), "to_at")


def hour_split(sittings: DataFrame, id_col: str, amount: str, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """``(id, hour_at, part)``: ``amount`` over the clock hours by overlap, truncated; the first hour takes the rest."""
    hours = F.explode(F.sequence(hour_of(F.col(start)), hour_of(F.col(end)), F.expr("interval 1 hour"))).alias("hour_at")
    rows = sittings.select(id_col, amount, start, end, hours)
    length = micros_between(F.col(start), F.col(end))
    inside = micros_between(F.greatest(F.col(start), F.col("hour_at")), F.least(F.col(end), F.col("hour_at") + F.expr("interval 1 hour")))
    rows = rows.withColumn("p", F.when(length > 0, F.floor(F.col(amount) * inside / F.when(length > 0, length).otherwise(1)).cast("long")).otherwise(F.lit(0).cast("long")))
    w = Window.partitionBy(id_col)
    rest = F.col(amount) - F.sum("p").over(w)
    return rows.select(id_col, "hour_at", (F.col("p") + F.when(F.col("hour_at") == F.min("hour_at").over(w), rest).otherwise(0)).cast("long").alias("part"))


def exact_seconds(parts: DataFrame, id_col: str, order: str, ms: str) -> DataFrame:
    """Milliseconds as whole seconds whose running sum is the truncated running sum, so that totals agree."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = intdiv(F.sum(ms).over(w), 1000)
    rows = parts.withColumn("__run", run)
    return rows.withColumn("seconds", F.col("__run") - F.coalesce(F.lag("__run").over(Window.partitionBy(id_col).orderBy(order)), F.lit(0))).drop("__run")


def largest_remainder(parts: DataFrame, group: list[str], value: str, order: list[str], total: int = 100) -> DataFrame:
    """``share``: whole parts of ``total`` that add up to it, the largest remainders rounded up, earlier rows first on ties."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    whole = F.sum(value).over(w)
    rows = parts.withColumns({"__f": intdiv(F.col(value) * total, F.when(whole > 0, whole).otherwise(1)), "__r": (F.col(value) * total) % F.when(whole > 0, whole).otherwise(1), "__w": whole})
    rank = F.row_number().over(w.orderBy(F.col("__r").desc(), *order))
    short = F.when(F.col("__w") > 0, F.lit(total) - F.sum("__f").over(w)).otherwise(0)
    return rows.withColumns({"__n": rank, "__s": short}).withColumn("share", (F.col("__f") + (F.col("__n") <= F.col("__s")).cast("long")).cast("long")).drop("__f", "__r", "__w", "__n", "__s")


def zero_runs(series: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``series`` with every run of zeros between values as one row: ``n`` rows, the run's first place. Zeros at the ends stay single."""
    w = Window.partitionBy(group).orderBy(order)
    zero = F.col(value) == 0
    rows = series.withColumn("__new", (F.coalesce(F.lag(value).over(w) == 0, F.lit(False)) != zero) | ~zero)
    rows = rows.withColumn("__run", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = Window.partitionBy(group)
    hi = F.max(F.when(~zero, F.col(order))).over(edge)
    lo = F.min(F.when(~zero, F.col(order))).over(edge)
    rows = rows.withColumn("__inner", zero & (F.col(order) > lo) & (F.col(order) < hi))
    key = F.when(F.col("__inner"), F.col("__run")).otherwise(F.lit(None))
    single = F.when(~F.coalesce(F.col("__inner"), F.lit(False)), F.col(order))
    return rows.groupBy(group, key.alias("__k"), single.alias("__o")).agg(F.min(order).alias(order), F.sum(value).alias(value), F.count("*").alias("n")).drop("__k", "__o")
