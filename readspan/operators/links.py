"""Links between names of one value, and values respelled everywhere: inserts and tombstones that a last writer decides.

``links``: field, type, first, names (array, null once parted), edited. ``tags`` are arrays of struct<type,tag> in rows of books.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.text import folded
from readspan.operators.edits import edit_stamp

_KEY = ["field", "type", "first"]


def standing(links: DataFrame) -> DataFrame:
    """The links in force: the latest row of a field, type and first name, if it still joins names."""
    w = Window.partitionBy("field", "type", folded(F.col("first"))).orderBy(F.desc("edited"), F.col("names").cast("string"))
    return links.withColumn("__n", F.row_number().over(w)).where("__n = 1 and names is not null").drop("__n")


def refused(asked: DataFrame) -> DataFrame:
    """The requests that can't be: links of languages, whose names a dictionary joins, and of a single name."""
    several = F.size(F.array_distinct(F.transform(F.concat(F.array("first"), "names"), lambda x: folded(x)))) > 1
    return asked.where((F.col("field") == "language") | ~several)


def put(links: DataFrame, fresh: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``links`` with ``fresh`` rows (field, type, first, names) over those of their key, stamped later than them; also the rows as they were.

    A fresh row without names parts its key's names: it stays as a tombstone.
    """
    held = links.groupBy(*_KEY).agg(F.max_by(F.struct("names", "edited"), "edited").alias("__h"))
    new = fresh.join(held, _KEY, "left").withColumn("edited", F.coalesce(edit_stamp(F.col("__h.edited"), now), now))
    before = new.select(*_KEY, F.col("__h.names").alias("names"))
    left = links.join(fresh.select(_KEY), _KEY, "left_anti")
    return left.select(links.columns).unionByName(new.select(links.columns)), before


def link(links: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Join the names of each request: links in force that share a name with it become one with it, and give up their own key.

    Requests are a reader's clicks; each meets the links of its field and type over folded names.
    """
    fold = lambda c: F.transform(c, lambda x: folded(x))
    live = standing(links).select("field", "type", F.col("first").alias("__f"), F.concat(F.array("first"), "names").alias("__all"))
    met = asked.withColumn("__k", F.explode(fold(F.concat(F.array("first"), "names")))).join(live.withColumn("__k", F.explode(fold("__all"))), ["field", "type", "__k"])
    more = met.groupBy(*_KEY).agg(F.flatten(F.collect_set("__all")).alias("__more"), F.collect_set("__f").alias("__gone"))
    rows = asked.join(more, _KEY, "left")
    others = F.filter(F.array_distinct(F.concat("names", F.coalesce("__more", F.array().cast("array<string>")))), lambda x: folded(x) != folded(F.col("first")))
    joined = rows.select(*_KEY, F.array_sort(others).alias("names"))
    gone = rows.select("field", "type", "first", F.explode("__gone").alias("__g")).where(folded(F.col("__g")) != folded(F.col("first")))
    parted = gone.select("field", "type", F.col("__g").alias("first"), F.lit(None).cast("array<string>").alias("names")).distinct()
    return put(links, joined.unionByName(parted), now)


def separate(links: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Take the link of each request (field, type, first) back."""
    return put(links, asked.select(*_KEY, F.lit(None).cast("array<string>").alias("names")), now)


def renamed(links: DataFrame, field: str, kind: str, old: str, new: str) -> DataFrame:
    """``links`` with a name respelled wherever a link has it; a link that is left with one name is parted."""
    mine = (F.col("field") == field) & F.equal_null(F.coalesce("type", F.lit("")), F.lit(kind))
    is_old = lambda c: folded(c) == folded(F.lit(old))
    first = F.when(is_old(F.col("first")), F.lit(new)).otherwise(F.col("first"))
    names = F.array_distinct(F.transform("names", lambda x: F.when(is_old(x), F.lit(new)).otherwise(x)))
    rest = F.filter(names, lambda x: folded(x) != folded(first))
    changed = F.when(F.size(rest) > 0, rest)
    return links.withColumns({"__f": F.when(mine, first).otherwise(F.col("first")), "names": F.when(mine & F.col("names").isNotNull(), changed).otherwise(F.col("names"))}).withColumn("first", F.col("__f")).drop("__f")


def refiled(links: DataFrame, old: str, new: str) -> DataFrame:
    """Links of tags under a renamed type."""
    return links.withColumn("type", F.when((F.col("field") == "tag") & (folded(F.col("type")) == folded(F.lit(old))), F.lit(new)).otherwise(F.col("type")))


def retag(rows: DataFrame, tags: str, old: tuple[str, str], new: tuple[str, str] | None) -> DataFrame:
    """A tag replaced wherever a book has it, folding aside, and kept once; without ``new`` it is removed."""
    hit = lambda x: (folded(x["type"]) == folded(F.lit(old[0]))) & (folded(x["tag"]) == folded(F.lit(old[1])))
    if new is None:
        return rows.withColumn(tags, F.filter(tags, lambda x: ~hit(x)))
    to = F.struct(F.lit(new[0]).alias("type"), F.lit(new[1]).alias("tag"))
    return rows.withColumn(tags, F.array_distinct(F.transform(tags, lambda x: F.when(hit(x), to).otherwise(F.struct(x["type"].alias("type"), x["tag"].alias("tag"))))))


def rename_type(rows: DataFrame, tags: str, old: str, new: str) -> DataFrame:
    """A tag type renamed wherever it stands, folding aside."""
    kind = lambda x: F.when(folded(x["type"]) == folded(F.lit(old)), F.lit(new)).otherwise(x["type"])
    return rows.withColumn(tags, F.array_distinct(F.transform(tags, lambda x: F.struct(kind(x).alias("type"), x["tag"].alias("tag")))))


def spelled(rows: DataFrame, book: str, tags: str) -> DataFrame:
    """``(type, tag, n_books, spelling)``: every tag with the books that hold it; ``spelling`` is the one most books have of those that fold alike."""
    flat = rows.select(F.col(book).alias("b"), F.explode(tags).alias("x")).select("b", "x.type", "x.tag")
    counts = flat.groupBy("type", "tag").agg(F.countDistinct("b").alias("n_books"))
    w = Window.partitionBy(folded(F.col("type")), folded(F.col("tag"))).orderBy(F.desc("n_books"), "type", "tag")
    return counts.withColumn("spelling", F.first(F.struct("type", "tag")).over(w))


def spell(typed: DataFrame, spellings: DataFrame) -> DataFrame:
    """``typed`` (type, tag) with ``spelt``: how the books spell it, else as typed."""
    known = spellings.select(folded(F.col("type")).alias("__a"), folded(F.col("tag")).alias("__b"), "spelling").groupBy("__a", "__b").agg(F.min("spelling").alias("__s"))
    rows = typed.withColumns({"__a": folded(F.col("type")), "__b": folded(F.col("tag"))}).join(known, ["__a", "__b"], "left")
    return rows.withColumn("spelt", F.coalesce("__s", F.struct("type", "tag"))).drop("__a", "__b", "__s")


def respelled(rows: DataFrame, tags: str, spellings: DataFrame) -> DataFrame:
    """``rows`` with every tag as most books spell it; only rows that change keep ``changed`` true.

    Tags are joined by what they fold to, one row a tag, and gathered again in their order.
    """
    numbered = rows.withColumn("__id", F.monotonically_increasing_id())
    flat = numbered.select("__id", F.posexplode(tags).alias("__p", "x")).select("__id", "__p", "x.type", "x.tag")
    spelt = spell(flat, spellings).groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "spelt"))), lambda x: x["spelt"]).alias("__t"))
    out = numbered.join(spelt, "__id", "left").withColumn("__t", F.array_distinct(F.coalesce("__t", tags)))
    return out.withColumns({"changed": ~F.equal_null("__t", tags), tags: F.col("__t")}).drop("__t", "__id")
