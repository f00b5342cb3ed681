"""Which book a sitting is of: witnesses that name books at instants, counters of sidecars, and lookups by extent, key and file.

Tables: ``sittings`` (started_at, ended_at, extent, key, seconds and more), ``books`` (extent, cde_key, title, author, identified_by
and more; ``identified_by`` is a rank, 0 the library), ``keys`` (extent, key) and ``pairs`` (extent, file). Ambiguous evidence names
nothing; tables of books are catalogues, small beside the facts, but joins leave their size to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.text import flat, normalised
from readspan.operators.intervals import covering, hour_of
from readspan.operators.lineage import few, pinned, tasks
from readspan.operators.matching import only, only_once

# Seconds of a sitting that can be claimed, and characters of a key that can be looked for in a file's name.
CLAIM_SECONDS, KEY_CHARS = 60, 10
#: Names of files that a task looks for keys in, and keys up to which they are sent to all tasks.
NAMES_A_TASK, FEW_KEYS = 250_000, 100_000
# Sources in the order in which they may speak, the strongest first.
LIBRARY, LOOKUPS, CLIPPINGS, SIDECARS = range(4)


def extents(sittings: DataFrame, ends: DataFrame) -> DataFrame:
    """``sittings`` with ``extent``: what their end position is mapped to by ``ends`` (end_position, extent), else the position itself."""
    known = ends.groupBy("end_position").agg(F.max("extent").alias("__e"))
    return sittings.join(known, "end_position", "left").withColumn("extent", F.coalesce("__e", "end_position")).drop("__e")


def first_slot(books: DataFrame) -> DataFrame:
    """One book an extent, the first by key."""
    w = Window.partitionBy("extent").orderBy("cde_key")
    return books.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def slots(rows: DataFrame, books: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` (extent, key) with ``slot``, the key of the book they are of.

    A book of the extent names it, unless the book of the row's key was identified by a stronger source; then the only
    key that is paired with the extent, then the only file. Null where none does.
    """
    by_extent = first_slot(books).select("extent", F.struct("identified_by", "cde_key").alias("__e"))
    by_key = books.groupBy("cde_key").agg(F.min(F.struct("identified_by", "extent")).alias("__b")).select(F.col("cde_key").alias("key"), F.struct(F.col("__b.identified_by"), F.col("cde_key")).alias("__k"))
    known = books.select("cde_key").distinct()
    one = lambda table, column, name: only(table, ["extent"], column).join(known.withColumnRenamed("cde_key", column), column, "left_semi").select("extent", F.col(column).alias(name))
    out = rows.join(by_extent, "extent", "left").join(by_key, "key", "left").join(one(keys, "key", "__one"), "extent", "left").join(one(pairs, "file", "__file"), "extent", "left")
    stronger = F.col("__k.identified_by") < F.col("__e.identified_by")
    slot = F.coalesce(F.when(F.coalesce(stronger, F.lit(False)), F.col("__k.cde_key")), "__e.cde_key", "__k.cde_key", "__one", "__file")
    return out.withColumn("slot", slot).drop("__e", "__k", "__one", "__file")


def wanting(sittings: DataFrame, books: DataFrame, keys: DataFrame, pairs: DataFrame, rank: int) -> DataFrame:
    """``extent``: those of sittings that no book is of, or one that a weaker source than ``rank`` identified."""
    ranks = books.groupBy(F.col("cde_key").alias("slot")).agg(F.min("identified_by").alias("__r"))
    rows = slots(sittings.select("extent", "key"), books, keys, pairs).join(ranks, "slot", "left")
    return rows.where(F.col("slot").isNull() | (F.col("__r") > rank)).select("extent").distinct()


def _alone(points: DataFrame, spans: DataFrame, wid: str) -> DataFrame:
    """``points`` (wid, at) that spans (started_at, ended_at, extent) of one extent alone hold, with ``extent``; a ``wid`` of several rows has one extent in all.

    Spans of an extent that meet are one first, so the extents at an instant are as many as spans that began and didn't end: a
    running count over the hour's starts, points and ends in order of time. Work goes with points and hours of spans, however many overlap.
    """
    began = Window.partitionBy("extent").orderBy("started_at", "ended_at")
    reached = F.max("ended_at").over(began.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("started_at") > reached, F.lit(True)).cast("long")
    runs = spans.where("extent is not null and ended_at >= started_at").select("extent", "started_at", "ended_at", new.alias("__new"))
    runs = runs.withColumn("__run", F.sum("__new").over(began.rowsBetween(Window.unboundedPreceding, 0))).groupBy("extent", "__run").agg(F.min("started_at").alias("s"), F.max("ended_at").alias("e"))
    hours = runs.withColumn("h", F.explode(F.sequence(hour_of(F.col("s")), hour_of(F.col("e")), F.expr("interval 1 hour"))))
    whole = F.col("extent").cast("decimal(20,0)")
    edge = lambda t, kind, n: F.struct(t.alias("t"), F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), (whole if n > 0 else -whole).alias("x"))
    edges = hours.select("h", F.explode(F.array(edge(F.greatest("s", "h"), 0, 1), F.when(hour_of(F.col("e")) == F.col("h"), edge(F.col("e"), 2, -1)))).alias("x")).where("x is not null")
    edges = edges.select("h", "x.*", F.lit(None).cast(points.schema[wid].dataType).alias(wid))
    marks = points.where("at is not null").select(hour_of(F.col("at")).alias("h"), F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(20,0)").alias("x"), wid)
    so_far = Window.partitionBy("h").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = edges.unionByName(marks).withColumns({"n": F.sum("n").over(so_far), "x": F.sum("x").over(so_far)}).where("kind = 1 and n > 0")
    own = Window.partitionBy(wid)
    held = seen.select(wid, F.col("t").alias("at"), "n", F.when(F.col("n") == 1, F.col("x").cast("long")).alias("extent"))
    held = held.withColumns({"__n": F.max("n").over(own), "__lo": F.min("extent").over(own), "__hi": F.max("extent").over(own)})
    return held.where("__n = 1 and __lo = __hi").select(wid, "at", "extent")


def around(witnesses: DataFrame, sittings: DataFrame, wid: str = "wid") -> DataFrame:
    """``(wid, extent, key, seconds)`` of the witnesses that sittings of one extent alone span, with their longest and a key they carry.

    Sittings without an extent speak for none. Only what is of one extent meets its sittings, and those of an extent alone.
    """
    alone = _alone(witnesses.select(wid, "at"), sittings, wid)
    spans = sittings.where("ended_at >= started_at").select("started_at", "ended_at", "extent", F.col("key").alias("__key"), F.col("seconds").alias("__secs"))
    met = covering(alone, spans, "at", "started_at", "ended_at", ("extent",))
    return met.groupBy(wid).agg(F.min("extent").alias("extent"), F.max_by("__key", F.when(F.col("__key").isNotNull(), F.col("started_at"))).alias("key"), F.max("__secs").alias("seconds"))


def claims(witnesses: DataFrame, sittings: DataFrame, wanted: DataFrame, contested: DataFrame, wid: str = "wid") -> DataFrame:
    """What the witnesses of one source claim: ``(extent, name, title, author, key)``, a row a witness.

    A witness counts over a sitting of CLAIM_SECONDS at least, at a place that the book has, for an extent that is still
    ``wanted`` and that no stronger source left ``contested``.
    """
    rows = around(witnesses, sittings, wid).drop("key").join(witnesses.drop("at"), wid)
    placed = F.col("pos").isNull() | (F.col("pos") < 0) | (F.col("extent") <= 0) | (F.col("pos") <= F.col("extent"))
    rows = rows.where(placed & (F.col("seconds") >= CLAIM_SECONDS)).join(wanted, "extent", "left_semi").join(contested, "extent", "left_anti")
    return rows.select("extent", normalised(F.coalesce("title", F.lit(""))).alias("name"), "title", "author", F.coalesce("key", F.lit("")).alias("key"))


def settled(claimed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(extent, name, title, author, key)`` of the extents whose claims all name one title, and ``extent`` of the contested others."""
    order = F.struct(F.col("key") == "", "key", "title", "author")
    rows = claimed.groupBy("extent").agg(F.countDistinct("name").alias("__n"), F.min("name").alias("name"), F.min(F.struct(order.alias("o"), "title", "author", "key")).alias("c"))
    named = rows.where("__n = 1").select("extent", "name", "c.title", "c.author", "c.key")
    return named, rows.where("__n > 1").select("extent")


def titled(named: DataFrame, books: DataFrame) -> DataFrame:
    """``named`` with ``slot``: the book of its key, else the only book of its title; null where there is none."""
    by_key = books.select(F.col("cde_key").alias("key"), F.col("cde_key").alias("__k")).where("key <> ''").distinct()
    by_title = only_once(books.select(normalised(F.coalesce("title", F.lit(""))).alias("name"), F.col("cde_key").alias("__t")), ["name"])
    return named.join(by_key, "key", "left").join(by_title, "name", "left").withColumn("slot", F.coalesce("__k", "__t")).drop("__k", "__t")


def new_book(columns: list[tuple[str, str]], stated: dict[str, Column]) -> list[Column]:
    """A row of a table of books (name, type): what is ``stated``, and null for the rest."""
    return [stated.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns]


def identify(sittings: DataFrame, books: DataFrame, keys: DataFrame, pairs: DataFrame, sources: list[tuple[int, DataFrame]], wid: str = "wid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books and keys after the witnesses of ``sources`` (rank, table of wid, at, title, author, key, pos) spoke, the strongest first.

    Each source speaks only for what stronger ones left: an extent that two titles claim is contested from then on. A
    claim drops the book that a weaker source made for the extent, gives its extent to a book of that key or title that
    has none, or makes a new book. Returns ``(books, keys, contested)``.
    """
    contested = sittings.select("extent").limit(0)
    for rank, witnesses in sorted(sources, key=lambda s: s[0]):
        claimed = pinned(claims(witnesses, sittings, wanting(sittings, books, keys, pairs, rank), contested, wid))
        named, fought = settled(claimed)
        named, contested = pinned(named), pinned(contested.unionByName(fought).distinct())
        weaker = F.col("identified_by") > rank
        gone = books.where(weaker).join(named.select("extent"), "extent", "left_semi").select("extent", "cde_key")
        books = books.join(gone, ["extent", "cde_key"], "left_anti").select(books.columns)
        keys = keys.join(gone.select("extent", F.col("cde_key").alias("key")), ["extent", "key"], "left_anti").select(keys.columns)
        books, keys = pinned(books), pinned(keys)
        found = pinned(titled(named, books))
        landed = found.where("slot is not null").groupBy("slot").agg(F.min("extent").alias("__x"))
        held = books.join(landed, books["cde_key"] == landed["slot"], "left")
        takes = F.col("__x").isNotNull()
        changed = {"extent": F.when(takes & (F.coalesce("extent", F.lit(0)) == 0), F.col("__x")).otherwise(F.col("extent")), "identified_by": F.when(takes, F.least("identified_by", F.lit(rank))).otherwise(F.col("identified_by"))}
        made = found.where("slot is null").select(
            *new_book(books.dtypes, {"extent": F.col("extent"), "cde_key": F.when(F.col("key") != "", F.col("key")).otherwise(F.col("title")), "title": F.col("title"), "author": F.col("author"), "identified_by": F.lit(rank)})
        )
        columns = books.columns
        books = pinned(held.withColumns(changed).select(columns).unionByName(made))
        keys = keys.unionByName(found.where("slot is not null").select("extent", F.col("slot").alias("key"))).distinct()
    return books, keys, contested


def witnesses_of_lookups(lookups: DataFrame) -> DataFrame:
    """Lookups (at, title, author, key, pos) as witnesses."""
    return lookups.select(F.monotonically_increasing_id().alias("wid"), "at", "title", "author", "key", "pos")


def witnesses_of_clippings(clippings: DataFrame) -> DataFrame:
    """Clippings name neither key nor place."""
    return clippings.select(F.monotonically_increasing_id().alias("wid"), "at", "title", "author", F.lit("").alias("key"), F.lit(None).cast("long").alias("pos"))


def counters_of(sittings: DataFrame, counters: DataFrame) -> DataFrame:
    """``(total_ms, words, end_position)``: the one end position that each pair of counters was ever stated for."""
    stated = sittings.select(F.col("end_counter_ms").alias("total_ms"), F.col("end_words").alias("words"), "end_position").unionByName(counters.select("total_ms", "words", "end_position"))
    return only(stated.where("total_ms is not null and words is not null"), ["total_ms", "words"], "end_position")


def named_in(files: DataFrame, books: DataFrame) -> DataFrame:
    """``(file, cde_key)``: the one book without an extent whose key of KEY_CHARS or more characters a file's name contains.

    Files meet books over every run of characters of their name that is as long as some key, an equi-join on whole keys. Keys are broadcast
    while they are few. Else their beginnings are, as long as they stay few, and only runs that begin like a key are shuffled. A task gets
    about NAMES_A_TASK names, however many there are.
    """
    keys = pinned(books.where((F.coalesce("extent", F.lit(0)) == 0) & (F.length("cde_key") >= KEY_CHARS)).select("cde_key").distinct())
    n = tasks(files, NAMES_A_TASK)
    names = files.select("file").repartition(n, "file").distinct()
    lengths = few(keys.select(F.length("cde_key").alias("__n")).distinct())
    runs = F.transform(F.sequence(F.lit(1), F.length("file") - F.col("__n") + 1), lambda i: F.substr(F.col("file"), i, F.col("__n")))
    rows = names.join(lengths, F.length("file") >= F.col("__n")).select("file", F.explode(runs).alias("cde_key"))
    if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        met = rows.join(F.broadcast(keys), "cde_key")
    else:
        begin = lambda k: F.left("cde_key", F.lit(k))
        kinds = keys.agg(*(F.approx_count_distinct(begin(k)) for k in range(1, KEY_CHARS + 1))).first()
        k = sum(x <= FEW_KEYS for x in kinds)
        if k:
            rows = rows.join(F.broadcast(keys.select(begin(k).alias("__b")).distinct()), begin(k) == F.col("__b"), "left_semi")
        met = rows.repartition(n, "cde_key").join(keys.repartition(n, "cde_key").hint("shuffle_hash"), "cde_key").repartition(n, "file")
    return met.groupBy("file").agg(F.min("cde_key").alias("cde_key"), F.max("cde_key").alias("__last")).where("cde_key = __last").drop("__last")


def recover(sidecars: DataFrame, sittings: DataFrame, counters: DataFrame, ends: DataFrame, books: DataFrame, keys: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(books, pairs)`` after sidecars (file, total_ms, words) found their reading by its counters.

    A sidecar claims the extent whose end position alone was stated with its counter and words; claims that share an
    extent or a file are contested. A pair whose extent a book carries under another key is given up first.
    """
    carried = books.select("extent", "cde_key").distinct()
    other = pairs.join(carried, "extent").where(F.col("cde_key") != F.col("file")).select("extent", "file").distinct()
    pairs = pairs.join(other, ["extent", "file"], "left_anti").select(pairs.columns)
    claimed = sidecars.where("total_ms <> 0").join(counters_of(sittings, counters), ["total_ms", "words"]).select("file", "end_position")
    claimed = extents(claimed, ends).select("extent", "file")
    sides = {"__e": F.count("*").over(Window.partitionBy("extent")), "__f": F.count("*").over(Window.partitionBy("file"))}
    claimed = claimed.withColumns(sides).where("__e = 1 and __f = 1").select("extent", "file")
    free = pinned(slots(claimed.withColumn("key", F.lit(None).cast("string")), books, keys, pairs).where("slot is null").select("extent", "file"))
    by_name = named_in(free, books)
    landed = pinned(free.join(by_name, "file", "left"))
    sized = landed.where("cde_key is not null").groupBy("cde_key").agg(F.min("extent").alias("__x"))
    columns = books.columns
    held = books.join(sized, "cde_key", "left").withColumn("extent", F.when(F.coalesce("extent", F.lit(0)) == 0, F.coalesce("__x", "extent")).otherwise(F.col("extent"))).select(columns)
    title = F.trim(F.regexp_replace(F.regexp_replace(flat(F.col("file")), r"\.[^.]*$", ""), "_", " "))
    made = landed.where("cde_key is null").select(*new_book(books.dtypes, {"extent": F.col("extent"), "cde_key": F.col("file"), "title": title, "identified_by": F.lit(SIDECARS)}))
    return held.unionByName(made), pairs.unionByName(free.select(pairs.columns)).distinct()


def timers(books: DataFrame, sidecars: DataFrame, pairs: DataFrame) -> DataFrame:
    """``books`` (with timer_ms, timer_words, timer_covered) with the counters of the sidecar that is paired with their extent."""
    known = pairs.join(sidecars.dropDuplicates(["file"]), "file").groupBy("extent").agg(F.min(F.struct("file", "total_ms", "words", "covered")).alias("__c"))
    rows = books.join(known, "extent", "left")
    new = {"timer_ms": "__c.total_ms", "timer_words": "__c.words", "timer_covered": "__c.covered"}
    return rows.withColumns({k: F.coalesce(v, k) for k, v in new.items()}).select(books.columns)


def progress(books: DataFrame, sittings: DataFrame, stated: DataFrame) -> DataFrame:
    """``books`` outside ``stated`` (cde_key) at the furthest that a sitting of their extent reached, where that is further."""
    reached = sittings.where("progress is not null").groupBy("extent").agg((F.max("progress") * 100).alias("__p"))
    rows = books.join(reached, "extent", "left").join(stated.select("cde_key", F.lit(True).alias("__s")).distinct(), "cde_key", "left")
    inside = F.when(F.col("__p").isNotNull(), F.least(F.greatest("__p", F.lit(0.0)), F.lit(100.0)))
    far = F.when(F.col("__s").isNull(), F.greatest("percent", inside)).otherwise(F.col("percent"))
    return rows.withColumn("percent", far).select(books.columns)


def shown(books: DataFrame, sittings: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Books that have sittings or are kept."""
    read = slots(sittings.select("extent", "key"), books, keys, pairs).where("slot is not null").select(F.col("slot").alias("cde_key")).distinct().withColumn("__r", F.lit(True))
    return books.join(read, "cde_key", "left").where(F.col("__r") | F.col("kept")).select(books.columns)


def one_book(cde_key: str, books: DataFrame, sittings: DataFrame, keys: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of one book and its sittings."""
    mine = slots(sittings, books, keys, pairs).where(F.col("slot") == cde_key).drop("slot")
    return books.where(F.col("cde_key") == cde_key), mine.select(sittings.columns)


def changed(held: DataFrame, now: DataFrame, key: str, stamp: str) -> DataFrame:
    """``key`` of the inputs whose stamp isn't the one that was last worked on; a pass over others can be left out."""
    both = now.select(key, F.col(stamp).alias("__n")).join(held.select(key, F.col(stamp).alias("__h")), key, "full")
    return both.where(~F.equal_null("__n", "__h")).select(key)
