"""Breakdowns over values that books hold: ranked bars, alias classes and even splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import even_part
from readspan.functions.text import folded
from readspan.operators.lineage import few, pinned


def ranked(items: DataFrame, item: str, values: str, seconds: str) -> DataFrame:
    """Seconds and items for each value; a value counts once an item, items without values are the null bar."""
    rows = items.select(item, seconds, F.explode_outer(F.array_distinct(F.col(values))).alias("value"))
    return rows.groupBy("value").agg(F.sum(seconds).alias("seconds"), F.countDistinct(item).alias("n_items"))


def top(bars: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` bars with their place, most seconds first, then by name."""
    order = [F.col("seconds").desc(), F.col("value").asc_nulls_last()]
    return bars.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def even_split(items: DataFrame, item: str, values: str, seconds: str) -> DataFrame:
    """An item's seconds in whole parts over its distinct values, the first ones taking what is left over."""
    rows = items.select(item, seconds, F.array_distinct(F.col(values)).alias("v")).where(F.size("v") > 0)
    parts = rows.select(item, seconds, F.size("v").alias("k"), F.posexplode("v").alias("at", "value"))
    return parts.groupBy("value").agg(F.sum(even_part(F.col(seconds), F.col("k"), F.col("at"))).alias("seconds"))


def alias_classes(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(name, class)``: names joined by links, directly or through others; folded equal names are one, the least names the class.

    Every round each name takes the smallest class of its neighbours and then its class's class, so that a chain of any
    length is joined in rounds of about its length's logarithm; it ends when nothing changes. Rounds are checkpointed
    where the session has a checkpoint folder. Links are the hand-made alias table, small beside the facts.
    """
    pairs = links.select(folded(F.col(a)).alias("a"), folded(F.col(b)).alias("b"))
    both = pinned(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pinned(both.select(F.col("a").alias("name")).distinct().withColumn("class", F.col("name")))
    while True:
        near = both.join(labels.select(F.col("name").alias("b"), "class"), "b").groupBy(F.col("a").alias("name")).agg(F.min("class").alias("c"))
        hooked = pinned(labels.join(near, "name", "left").select("name", F.col("class").alias("was"), F.least("class", "c").alias("class")))
        up = hooked.select(F.col("name").alias("class"), F.col("class").alias("up"))
        step = pinned(hooked.join(up, "class", "left").select("name", F.least("class", "up").alias("class"), "was"))
        labels = step.select("name", "class")
        if step.where("class <> was").isEmpty():
            return labels


def value_names(links: DataFrame, held: DataFrame) -> DataFrame:
    """``(field, type, name, class, shown, n_books)``: every name that is held or linked, the value it belongs to and how that is shown.

    ``links`` (field, type, first, names, edited): the latest row of a field, type and first name joins its names; one
    whose names are null parts them again. ``held`` (book, field, type, name) are the values of books. Names are one by
    folding too. A value is shown by the name that most books hold, the least of equals.
    """
    w = Window.partitionBy("field", "type", folded(F.col("first"))).orderBy(F.desc("edited"), F.col("names").cast("string"))
    live = links.withColumn("__n", F.row_number().over(w)).where("__n = 1 and names is not null")
    key = lambda c: F.concat_ws("\u0001", "field", F.coalesce("type", F.lit("")), folded(c))
    joined = live.select("field", "type", "first", F.explode("names").alias("other"))
    edges = joined.select(key(F.col("first")).alias("a"), key(F.col("other")).alias("b"))
    own = held.select(key(F.col("name")).alias("a")).withColumn("b", F.col("a"))
    classes = alias_classes(edges.unionByName(own), "a", "b").withColumnRenamed("name", "__k")
    counts = held.groupBy("field", "type", "name").agg(F.countDistinct("book").alias("n_books"))
    said = joined.select("field", "type", F.explode(F.array("first", "other")).alias("name")).distinct().join(counts, ["field", "type", "name"], "left_anti").withColumn("n_books", F.lit(0).cast("long"))
    names = counts.unionByName(said).withColumn("__k", folded(key(F.col("name")))).join(classes, "__k", "left").drop("__k")
    best = Window.partitionBy("field", "type", "class").orderBy(F.desc("n_books"), "name")
    return names.withColumn("shown", F.first("name").over(best))


def ranked_by_field(read: DataFrame, held: DataFrame, names: DataFrame) -> DataFrame:
    """``(field, type, value, seconds, n_books, first_book, place)``: bars of every field and tag type, most seconds first, then by name.

    ``read`` (book, seconds): a book counts once for a value however many of its names it holds, and books that hold no
    value of a field are the null bar of that field. Books without seconds are left out.
    """
    books = read.where("seconds > 0")
    shown = held.join(names.select("field", "type", "name", "shown"), ["field", "type", "name"]).select("book", "field", "type", F.col("shown").alias("value")).distinct()
    fields = held.select("field", "type").distinct()
    every = books.join(few(fields), F.lit(True))  # fields and types of tags, as a reader makes them
    rows = every.join(shown, ["book", "field", "type"], "left")
    bars = rows.groupBy("field", "type", "value").agg(F.sum("seconds").alias("seconds"), F.countDistinct("book").alias("n_books"), F.min("book").alias("first_book"))
    order = Window.partitionBy("field", "type").orderBy(F.desc("seconds"), F.col("value").asc_nulls_last())
    return bars.withColumn("place", F.row_number().over(order))


def monthly_split(read: DataFrame, held: DataFrame) -> DataFrame:
    """``(month, value, seconds)``: a book's seconds of each month in whole parts over its distinct values (book, value), in their order.

    ``read``: book, month, seconds. The first parts take what is left over.
    """
    values = held.groupBy("book").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"])).alias("v"))
    rows = read.join(values, "book").select("month", "seconds", F.size("v").alias("k"), F.posexplode("v").alias("at", "value"))
    return rows.groupBy("month", "value").agg(F.sum(even_part(F.col("seconds"), F.col("k"), F.col("at"))).alias("seconds"))
