"""The page of a book: its highlights as the reader left them, notes under their passages, listed and searched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.text import folded, holds, normalised
from readspan.operators.highlights import COLUMNS, PASSAGES, blocks, corrected, identity, with_notes
from readspan.operators.lineage import pinned
from readspan.operators.ordered import placed

_LISTED = [*COLUMNS, "own", "on"]


def covering(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every point with every span of whole numbers that holds it, both ends counted.

    A span lies in one or two blocks as long as itself or less than twice so; a point looks into one block for each length of
    span that its keys have, of which there are some dozens at most. So spans of any length meet points by equality.
    """
    level = F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    s = spans.where(F.col(end) >= F.col(start)).withColumn("__l", level)
    s = s.withColumn("__b", F.explode(F.array_distinct(F.array(F.expr(f"shiftright(`{start}`, __l)"), F.expr(f"shiftright(`{end}`, __l)")))))
    levels = s.select(*keys, "__l").distinct()
    p = points.join(levels, keys).withColumn("__b", F.expr(f"shiftright(`{at}`, __l)"))
    return p.join(s, [*keys, "__l", "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__l", "__b")


def held_by(rows: DataFrame, books: DataFrame) -> DataFrame:
    """``rows`` with ``book``: of ``books`` (book, extent, title, order: the order they stand in) the first of its extent, else the first of its title; null for none."""
    first = lambda key: books.select(key.alias("__k"), "book", "order").where("__k is not null").groupBy("__k").agg(F.min_by("book", "order").alias("__v"))
    by_extent = first(F.when(F.col("extent") != 0, F.col("extent"))).select(F.col("__k").alias("__e"), F.col("__v").alias("__x"))
    by_title = first(normalised(F.coalesce("title", F.lit("")))).select(F.col("__k").alias("__t"), F.col("__v").alias("__y"))
    out = rows.withColumns({"__e": F.when(F.col("extent") != 0, F.col("extent")), "__t": normalised(F.coalesce("title", F.lit("")))})
    return out.join(by_extent, "__e", "left").join(by_title, "__t", "left").withColumn("book", F.coalesce("__x", "__y")).drop("__e", "__t", "__x", "__y")


def _nearest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``(__no, __under)``: of the spans (extent, s, e, made, over) that hold a point (extent, p, said, __no) the shortest, of equals the one made nearest to it in time, then the latest, then the first by ``over``.

    Ranges are cut into blocks by powers of two, of which a point lies in one a level, so the least length at a place is that of the
    blocks it lies in. Spans of that length and points of a block are then one sequence by time, in which a point takes the span
    before it and the one after: work goes with spans and points, however many spans hold a place and notes stand there.
    """
    level = lambda n: F.ceil(F.log2((n + 1).cast("double"))).cast("int")
    ranges = spans.where("e >= s").select("extent", "s", "e", (F.col("e") - F.col("s")).alias("n")).distinct()
    cut = ranges.select("*", F.explode(blocks(F.col("s"), F.col("e") + 1, level(F.col("n")) + 1)).alias("b")).select("extent", "s", "e", "n", "b.*")
    cut = pinned(cut)
    least = cut.groupBy("extent", "level", "no").agg(F.min("n").alias("n"))
    places = points.select("extent", "p").distinct().join(cut.select("extent", "level").distinct(), "extent").withColumn("no", F.expr("shiftright(p, level)"))
    asked = places.join(least, ["extent", "level", "no"]).groupBy("extent", "p").agg(F.min("n").alias("n"))
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(0), level(F.col("n"))))).withColumn("no", F.expr("shiftright(p, level)"))
    block = ["extent", "n", "level", "no"]
    asked = pinned(asked.join(cut.select(*block).distinct(), block, "left_semi"))
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    made = F.unix_micros(F.col("made").cast("timestamp"))
    givers = spans.join(cut.join(asked.select(*block).distinct(), block, "left_semi"), ["extent", "s", "e"])
    givers = givers.select(*block, secs("made").alias("t"), made.alias("us"), "over", F.lit(0).alias("point"))
    takers = points.join(asked, ["extent", "p"]).select(*block, secs("said").alias("t"), "__no", F.lit(1).alias("point"))
    rows = givers.unionByName(takers, allowMissingColumns=True)
    # spans without a time come first, points without one last
    rows = rows.withColumn("o", F.coalesce("t", F.when(F.col("point") == 1, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))))
    by = lambda *order: Window.partitionBy(*block).orderBy(*order, "point", F.col("us").asc_nulls_first(), F.desc("over")).rowsBetween(Window.unboundedPreceding, 0)
    span = F.when((F.col("point") == 0) & F.col("t").isNotNull(), F.struct("t", "us", "over"))
    timeless = F.min(F.when((F.col("point") == 0) & F.col("t").isNull(), F.col("over"))).over(by("o"))
    rows = rows.withColumns({"z": timeless, "a": F.last(span, True).over(by("o"))}).withColumn("b", F.last(span, True).over(by(F.desc("o")))).where("point = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("g"), (-F.col(f"{c}.us")).alias("m"), F.col(f"{c}.over").alias("over")))
    none = F.lit(None).cast("bigint")
    best = F.least(near("a"), near("b"), F.when(F.col("z").isNotNull(), F.struct(none.alias("g"), none.alias("m"), F.col("z").alias("over"))))
    return rows.where("a is not null or b is not null or z is not null").groupBy("__no").agg(F.min(best)["over"].alias("__under"))


def paired(rows: DataFrame) -> DataFrame:
    """``rows`` (COLUMNS, own, on) with ``notes``, the notes under each passage, latest first; a note under a passage is no row of its own.

    A note goes under the passage that it names (``on``), the latest if several have that name; else under the one of its book
    whose range holds its place: the shortest, of equals the one made nearest to it in time, then the latest.
    """
    rows = pinned(rows.select(*_LISTED).withColumn("__no", F.monotonically_increasing_id()))
    is_note = F.coalesce(F.col("kind") == "note", F.lit(False))
    passages, notes = rows.where(~is_note), rows.where(is_note)
    late = F.struct("at", "__no")
    names = passages.groupBy(identity(passages).alias("on")).agg(F.max_by("__no", late).alias("__named"))
    named = notes.where("on is not null").join(names, "on").select("__no", "__named")
    spans = passages.where("start is not null and end is not null").select("extent", F.col("start").alias("s"), F.col("end").alias("e"), F.col("at").alias("made"), F.col("__no").alias("over"))
    points = notes.where("start is not null").select("extent", F.col("start").alias("p"), F.col("at").alias("said"), "__no").join(named, "__no", "left_anti")
    inside = _nearest(points, spans)
    under = pinned(named.select("__no", F.col("__named").alias("__under")).unionByName(inside))
    said = F.struct(F.col("at"), F.col("__no").alias("no"), "body", "own")
    lists = notes.join(under, "__no").groupBy("__under").agg(F.sort_array(F.collect_list(said), asc=False).alias("notes")).withColumnRenamed("__under", "__no")
    out = rows.join(under.select("__no"), "__no", "left_anti").join(lists, "__no", "left")
    none = F.expr("cast(array() as array<struct<at:timestamp_ntz,body:string,own:boolean>>)")
    return out.withColumn("notes", F.coalesce(F.transform("notes", lambda x: F.struct(x["at"].alias("at"), x["body"].alias("body"), x["own"].alias("own"))), none)).drop("__no")


def book_pages(highlights: DataFrame, corrections: DataFrame, notes: DataFrame, books: DataFrame) -> DataFrame:
    """Every book's passages with the reader's words and notes laid in: COLUMNS, own, on, notes, book.

    Corrections take their place first, then the notes that the reader wrote; what spans no passage (a bookmark) isn't listed. Rows
    whose book isn't held have a null ``book``.
    """
    drawn = with_notes(corrected(highlights, corrections), notes).where(F.col("kind").isin(*PASSAGES))
    return held_by(paired(drawn), books)


def page_figures(pages: DataFrame) -> DataFrame:
    """``(book, passages, notes, newest)`` of ``book_pages``."""
    note = (F.col("kind") == "note").cast("long")
    return pages.where("book is not null").groupBy("book").agg(F.sum(1 - note).alias("passages"), F.sum(F.size("notes") + note).cast("long").alias("notes"), F.max("at").alias("newest"))


def listing(pages: DataFrame, query: str | None = None, kinds: Sequence[str] | None = None, newest_first: bool = True) -> DataFrame:
    """The rows of ``book_pages`` that a list shows, with ``place`` from 0: those of ``kinds`` whose words or notes hold ``query``, by time.

    The place is that of sorted ranges (``ordered.placed``), so a page of a list is a filter on it, and a list of any length is
    sorted by many tasks; ``ordered.keep_listing`` keeps one whose pages are read apart.
    """
    rows = pages if kinds is None else pages.where(F.col("kind").isin(*kinds))
    if query is not None:
        rows = rows.where(holds(F.coalesce("body", F.lit("")), query) | F.exists("notes", lambda x: _holds(x["body"], query)))
    by = [F.col("at").desc_nulls_last(), F.col("book"), F.col("start").desc_nulls_last(), F.col("body")]
    return placed(rows, by if newest_first else [F.col("at").asc_nulls_first(), F.col("book").desc(), F.col("start").asc_nulls_first(), F.col("body").desc()])


def _holds(text: Column, query: str) -> Column:
    return F.coalesce(F.lower(text).contains(query.lower()) | folded(text).contains(folded(F.lit(query))), F.lit(False))
