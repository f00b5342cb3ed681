"""Highlights of two sources: dedup by place and words, matching across clock offsets, notes under passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.scores import intdiv
from readspan.functions.text import bounded, normalised
from readspan.operators.grams import holding
from readspan.operators.lineage import few, pinned
from readspan.operators.matching import only_once, pair_in_order
from readspan.operators.ordered import placed
from readspan.sources.catalog import stem_of

# Kinds that are the reader's own words, and kinds that span a passage.
OWN, PASSAGES = ("note", "sticky_note"), ("highlight", "note", "underline", "circle", "asterisk")
COLUMNS = ("extent", "title", "kind", "at", "state", "start", "end", "location", "page", "colour", "body")


def settle_exact(rows: DataFrame, book: str, start: str, end: str, at: str, *ties: Column) -> DataFrame:
    """One row a book and range: the latest words win."""
    w = Window.partitionBy(book, start, end).orderBy(F.col(at).desc(), *ties)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def settle_words(rows: DataFrame, group: list[str], id_col: str, body: str, at: str, whole_words: bool = False) -> DataFrame:
    """Rows whose words no later row of the group holds as its own words or within them, from the middle of a word too.

    With ``whole_words`` the holding row must also have the held one's first word as a word of its own.

    Words meet as ``grams.holding`` has it, each different text of a group once: of a text only its latest row can hold others. Equal
    words keep the latest row; a row without a time neither holds nor is held.
    """
    clean = rows.select(*group, F.col(id_col).alias("id"), F.col(at).alias("__at"), normalised(F.col(body)).alias("body"), F.monotonically_increasing_id().alias("__r"))
    clean = clean.where("body <> '' and __at is not null").dropna(subset=group)
    late, same = F.struct("__at", "id"), Window.partitionBy(*group, "body")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of text are much work, so they aren't left to few tasks
    clean = pinned(clean.repartition(n, *group, "body").withColumns({"last": F.max(late).over(same), "text": F.min("__r").over(same)}))
    texts = clean.where("text = __r").select(*group, F.col("text").alias("id"), "body", "last")
    held = holding(texts.drop("last"), texts.drop("last"), group).where(F.col("s") != F.col("l"))
    if whole_words:
        held = held.where(F.array_contains(F.split("__l", " "), F.substring_index("__s", " ", 1)))
    ends = held.select("s", "l").join(texts.select(F.col("id").alias("l"), F.col("last").alias("end")), "l").groupBy(F.col("s").alias("text")).agg(F.max("end").alias("end"))
    gone = clean.select("id", "__at", "last", "text").join(ends, "text", "left").where(late < F.greatest("last", "end")).select(F.col("id").alias(id_col))
    return rows.join(gone.distinct(), id_col, "left_anti")


def match_offsets(clips: DataFrame, notes: DataFrame, kind: str, clip_at: str, note_at: str, offsets: DataFrame) -> DataFrame:
    """Full outer merge: clip and note of a kind are one if the note's time plus an offset is the clip's.

    Offsets (``offset_s``, ``rank``) are few and tried in order of rank; of several partners each side takes its
    best rank, and a pair stands if each is the other's first choice. ``state`` is live, unconfirmed or wordless.
    """
    secs = lambda c: F.unix_seconds(F.date_trunc("second", F.col(c).cast("timestamp")))
    n = notes.crossJoin(few(offsets)).withColumn("__t", secs(note_at) + F.col("offset_s"))  # a handful of offsets
    c = clips.withColumn("__t", secs(clip_at))
    met = c.select(kind, "__t", "clip_id").join(n.select(kind, "__t", "note_id", "rank"), [kind, "__t"])
    first = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy("rank", other)) == 1
    pairs = met.withColumns({"__a": first("clip_id", "note_id"), "__b": first("note_id", "clip_id")}).where("__a and __b").select("clip_id", "note_id", "rank")
    out = clips.select("clip_id").join(pairs, "clip_id", "left").join(notes.select("note_id"), "note_id", "full")
    state = F.when(F.col("clip_id").isNull(), "wordless").when(F.col("note_id").isNull(), "unconfirmed").otherwise("live")
    return out.select("clip_id", "note_id", "rank", state.alias("state"))


def journal(rows: DataFrame, at: str, book: str, *ties: str) -> DataFrame:
    """``place`` of each row newest first, and ``book_place`` of its book by the book's newest row."""
    newest = F.max(at).over(Window.partitionBy(book))
    by_day = Window.partitionBy(F.to_date(at)).orderBy(F.col(at).desc(), *ties)
    return rows.withColumns({"newest": newest, "day_place": F.row_number().over(by_day).cast("long")})


# ---------------------------------------------------------------- clippings and annotations as one


def identity(rows: DataFrame) -> Column:
    """What names a highlight across passes: what a clipping states, and the place only where no clipping placed it."""
    return F.struct("at", "kind", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("location", F.lit(-1)).alias("location"), F.when(F.coalesce("location", F.lit(-1)) < 0, F.coalesce("start", F.lit(-1))).otherwise(-1).alias("start"))


def claimed(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs ``(clip_id, ann_id, rank)`` of ``candidates`` (with ``same``: of one book).

    A clipping takes the best rank at which one annotation is left, or one of its own book; an annotation that several
    take goes to the first by rank and id, and the others look again at what is left, until nothing is taken any more.
    """
    left, out = pinned(candidates), None
    while True:
        n = F.count("*").over(Window.partitionBy("clip_id", "rank"))
        fits = left.withColumn("__n", n).where((F.col("__n") == 1) | F.col("same"))
        first = fits.withColumn("__c", F.row_number().over(Window.partitionBy("clip_id").orderBy("rank", "ann_id"))).where("__c = 1")
        taken = first.withColumn("__a", F.row_number().over(Window.partitionBy("ann_id").orderBy("rank", "clip_id"))).where("__a = 1").select("clip_id", "ann_id", "rank")
        taken = pinned(taken)
        if taken.isEmpty():
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        left = pinned(left.join(taken.select("clip_id"), "clip_id", "left_anti").join(taken.select("ann_id"), "ann_id", "left_anti"))


def merged(clippings: DataFrame, annotations: DataFrame, rosters: DataFrame, books: DataFrame, offsets: DataFrame) -> DataFrame:
    """The highlights that clippings (clip_id, title, kind, at, start, page, body) and annotations (ann_id, file, kind, start, end, created, colour, body) state.

    A clipping and an annotation of a kind are one if the annotation's second plus one of the ``offsets`` (offset_s, rank;
    a handful) is the clipping's; what is left of a book and kind pairs in order if both sides have as many. Such a row
    is ``live`` with the annotation's place and colour. A clipping without an annotation is ``retired`` if its book's
    roster is trusted, else ``unconfirmed``. An annotation without a clipping is live and wordless. Columns: COLUMNS.
    """
    own = books.select("extent", "title", "location")
    by_title = only_once(own.select(normalised(F.coalesce("title", F.lit(""))).alias("__t"), F.col("extent").alias("named")), ["__t"])
    stems = own.where(F.coalesce("location", F.lit("")) != "").select(stem_of(F.col("location")).alias("file"), F.struct("location", "extent", "title").alias("__s")).groupBy("file").agg(F.min("__s").alias("__s"))
    clips = pinned(clippings.withColumn("__t", F.when(F.col("title") != "", normalised(F.col("title")))).join(by_title, "__t", "left").drop("__t"))
    notes = annotations.join(stems, "file", "left").select(annotations["*"], F.col("__s.extent").alias("of"), F.col("__s.title").alias("of_title"), intdiv(F.col("created") - F.pmod("created", F.lit(1000)), 1000).alias("second"))
    wall = F.unix_seconds(F.col("at").cast("timestamp"))
    notes = pinned(notes)
    timed = notes.crossJoin(few(offsets)).select("ann_id", "kind", "of", "rank", (F.col("second") + F.col("offset_s")).alias("wall"))  # a handful of offsets
    met = clips.where("at is not null").select("clip_id", "kind", "named", wall.alias("wall")).join(timed, ["kind", "wall"])
    pairs = claimed(met.select("clip_id", "ann_id", "rank", F.coalesce(F.col("named") == F.col("of"), F.lit(False)).alias("same"))).select("clip_id", "ann_id")
    rest_c = clips.join(pairs, "clip_id", "left_anti").where("named is not null").select("clip_id", F.col("named").alias("of"), "kind", F.struct(F.col("start").isNull(), "start", "at", "clip_id").alias("c_order"))
    rest_a = notes.join(pairs, "ann_id", "left_anti").where("of is not null").select("ann_id", "of", "kind", F.struct(F.col("start").isNull(), "start", "created", "ann_id").alias("a_order"))
    pairs = pinned(pairs.unionByName(pair_in_order(rest_a, rest_c, ["of", "kind"], "a_order", "c_order").select("clip_id", "ann_id")))
    a = notes.select("ann_id", F.struct("start", "end", "colour", "body", "of").alias("a"))
    trusted = rosters.where("trusted").join(stems, "file").select(F.col("__s.extent").alias("named"), F.lit(True).alias("trusted")).distinct()
    both = clips.join(pairs, "clip_id", "left").join(a, "ann_id", "left").join(trusted, "named", "left")
    state = F.when(F.col("a").isNotNull(), "live").when(F.col("trusted"), "retired").otherwise("unconfirmed")
    spoken = both.select(
        F.coalesce("a.of", "named", F.lit(0)).cast("long").alias("extent"), "title", "kind", "at", state.alias("state"), F.col("a.start").alias("start"), F.col("a.end").alias("end"),
        F.col("start").alias("location"), "page", F.coalesce("a.colour", F.lit("")).alias("colour"), F.coalesce(F.nullif("a.body", F.lit("")), "body").alias("body"),
    )
    best = offsets.orderBy("rank").limit(1).select(F.col("offset_s").alias("__o"))
    alone = notes.join(pairs.select("ann_id"), "ann_id", "left_anti").join(F.broadcast(best), F.lit(True), "left")  # one row
    wordless = alone.select(
        F.coalesce("of", F.lit(0)).cast("long").alias("extent"), F.coalesce("of_title", "file").alias("title"), "kind", F.timestamp_seconds(F.col("second") + F.coalesce("__o", F.lit(0))).cast("timestamp_ntz").alias("at"),
        F.lit("live").alias("state"), "start", "end", F.lit(None).cast("long").alias("location"), F.lit("").alias("page"), "colour", "body",
    )
    return spoken.unionByName(wordless)


#: Columns of a row's class: the place of the row that opened it, and whether that row's words are never replaced.
_CLASS = ("root", "own")


def blocks(lo: Column, hi: Column, levels: Column) -> Column:
    """The fewest blocks (level, no), each 2**level places from no * 2**level on, that make up the places from ``lo`` to ``hi`` - 1; ``levels`` is the highest that they may need."""
    start = F.struct(lo.alias("lo"), F.greatest(lo, hi).alias("hi"), F.expr("cast(array() as array<struct<level:int,no:bigint>>)").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        low, high = acc["lo"].bitwiseAND(1) == 1, acc["hi"].bitwiseAND(1) == 1
        left = (acc["lo"] < acc["hi"]) & low
        right = (acc["lo"] + left.cast("long") < acc["hi"]) & high
        block = lambda test, no: F.when(test, F.array(F.struct(level.alias("level"), no.alias("no")))).otherwise(F.expr("cast(array() as array<struct<level:int,no:bigint>>)"))
        out = F.concat(acc["out"], block(left, acc["lo"]), block(right, acc["hi"] - 1))
        return F.struct(F.shiftright(acc["lo"] + left.cast("long"), 1).alias("lo"), F.shiftright(acc["hi"] - right.cast("long"), 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), levels), start, step, lambda acc: acc["out"])


#: Rows of a text up to which the places at which a class has its words are met one by one, not by blocks.
FEW_ROWS = 32


def _classes(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """``(no, root)`` of ``rows`` (g, no, body_id, sits, root, own): the first class, by the row that opened it, whose words at that time hold the row's or are held.

    A class's words are those of its last row so far. What a row joins depends on rows before it alone, so any guess that is
    worked out again from itself until nothing changes ends at what one by one would give: each round settles at
    least the rows whose earlier holders are settled, and most at once. Rows meet those of their own ``g`` alone, so a round is of
    the ``g`` in which the one before changed something.

    A row's words stand for their class from the next place up to that of the row after it. A text that FEW_ROWS or fewer
    rows have has no more of these spans, and rows that its words hold or are held by meet all of them. Spans of other texts are cut
    into blocks of places by powers of two, of which a row lies in one a level, so a row meets at most one class a block for each text
    that holds its own, however many rows repeat a text.
    """
    levels = max(n, 1).bit_length()
    rows = pinned(rows)
    many = pinned(rows.groupBy(F.col("body_id").alias("by")).count().where(F.col("count") > FEW_ROWS).select("by"))
    fixed, free, done = rows.where("sits"), rows.where("not sits"), [rows.where("sits").select("no", "root")]
    asks = free.join(edges, "body_id").select("g", "no", "by")
    in_blocks = None
    if not many.isEmpty():
        in_blocks = asks.join(many, "by", "left_semi").select("g", "no", "by", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
        in_blocks = pinned(in_blocks.withColumn("block", F.expr("shiftright(no, level)")))
        asks = asks.join(many, "by", "left_anti")
    asks, size = pinned(asks), free.count()
    while True:
        givers = fixed.unionByName(free).where((F.col("no") == F.col("root")) | ~F.col("own"))
        givers = givers.withColumn("until", F.coalesce(F.lead("no").over(Window.partitionBy("root").orderBy("no")) + 1, F.lit(n).cast("long")))
        givers = givers.select(F.col("body_id").alias("by"), F.col("no").alias("since"), "until", F.struct(*_CLASS).alias("c"))
        met = asks.join(givers, "by").where("since < no and no < until").select("no", "c")
        if in_blocks is not None:
            spans = givers.join(many, "by", "left_semi").select("by", "c", F.explode(blocks(F.col("since") + 1, F.col("until"), F.lit(levels))).alias("b"))
            first = spans.groupBy("by", F.col("b.level").alias("level"), F.col("b.no").alias("block")).agg(F.min("c").alias("c"))
            met = met.unionByName(in_blocks.join(first, ["by", "level", "block"]).select("no", "c"))
        joined = free.join(met.groupBy("no").agg(F.min("c").alias("c")), "no", "left")
        root = F.coalesce("c.root", "no")
        new = pinned(joined.select("g", "no", "body_id", "sits", root.alias("root"), F.coalesce("c.own", F.lit(False)).alias("own"), (root != F.col("root")).alias("moved")))
        free = new.drop("moved")
        moving = new.groupBy("g").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).where("moved")
        left = moving.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left == 0:
            return reduce(DataFrame.unionByName, done, free.select("no", "root"))
        if 2 * left <= size:  # halved each time, so all rounds' leaving costs no more than a round or two
            moving, size = pinned(moving.select("g")), left
            done.append(pinned(free.join(moving, "g", "left_anti").select("no", "root")))
            fixed, free, asks = (pinned(x.join(moving, "g", "left_semi")) for x in (fixed, free, asks))
            in_blocks = None if in_blocks is None else pinned(in_blocks.join(moving, "g", "left_semi"))


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` (COLUMNS) with each highlight once: live rows by their place, others by words that hold each other.

    In order of time, title, kind and start a row joins the first that holds or is held by its words as they stand by then, and
    gives it its own; a live row joins the first live one of its place, and a live note keeps the words the device
    states. The row that opened a class stays. One that isn't live goes if a live one of its title and kind holds its words
    in the end or is held. Words other than the reader's own are cut after. Rows alike in all columns are one if they have words.

    Texts that hold each other meet by their grams (``grams.holding``), once for each different text of a title and kind; the order
    is worked out over sorted ranges and classes by rounds (``_classes``), so a title of any size is spread over tasks.
    """
    clean = lambda c: F.coalesce(c, F.lit(""))
    first = [F.col(c).asc_nulls_first() for c in ("at", "title", "kind", "start", "end", "extent", "state", "location", "page", "colour", "body")]
    rows = placed(rows.select(*COLUMNS), first, "no")
    rows = rows.withColumns({"t": normalised(clean(F.col("title"))), "live": F.coalesce(F.col("state") == "live", F.lit(False)), "k": clean(F.col("kind")), "b": clean(F.col("body"))})
    seat = Window.partitionBy("extent", "k", "start", "end")
    sits = F.col("live") & F.col("start").isNotNull()
    opened = F.min(F.when(sits, F.struct("no", "t"))).over(seat)
    rows = rows.withColumns({"sits": F.col("live") | (F.col("b") == ""), "opened": F.when(sits, opened)})
    rows = pinned(rows.withColumns({"t": F.coalesce("opened.t", "t"), "root": F.coalesce("opened.no", "no"), "own": F.col("live") & (F.col("k") == "note")}).drop("opened"))
    n = rows.count()
    texts = rows.where("b <> ''").groupBy("t", "k", "b").agg(F.min("no").alias("id"), F.min_by("own", "no").alias("own"))
    texts = pinned(texts.withColumnRenamed("b", "body"))
    met = holding(texts.drop("own"), texts.drop("own"), ["t", "k"]).select("s", "l")
    edges = pinned(met.unionByName(met.select(F.col("l").alias("s"), F.col("s").alias("l"))).distinct().toDF("body_id", "by"))
    guess = edges.groupBy("body_id").agg(F.min("by").alias("least")).join(texts.select(F.col("id").alias("least"), F.col("own").alias("least_own")), "least")
    worded = rows.where("b <> ''").join(texts.select("t", "k", F.col("body").alias("b"), F.col("id").alias("body_id")), ["t", "k", "b"]).join(guess, "body_id")
    ahead = ~F.col("sits") & (F.col("least") < F.col("no"))
    worded = pinned(worded.select(F.xxhash64("t", "k").alias("g"), "no", "body_id", "sits", F.when(ahead, F.col("least")).otherwise(F.col("root")).alias("root"), F.when(ahead, F.col("least_own")).otherwise(F.col("own")).alias("own")))
    classes = pinned(_classes(worded, edges, n))
    # the words a class ends with: of its last row that gives any, or its own
    kept = classes.join(rows.select(F.col("no").alias("root"), F.col("own").alias("keeps")), "root").where(~F.col("keeps") | (F.col("no") == F.col("root")))
    ends = kept.groupBy("root").agg(F.max("no").alias("last"))
    said = rows.select(F.col("no").alias("last"), F.col("body").alias("said")).join(worded.select(F.col("no").alias("last"), "body_id"), "last")
    ends = ends.join(said, "last").select(F.col("root").alias("no"), "said", "body_id")
    joined = classes.select("no", F.col("root").alias("joined"))
    roots = rows.join(joined, "no", "left").where(F.coalesce("joined", "root") == F.col("no")).drop("root", "joined")
    roots = pinned(roots.join(ends, "no", "left"))
    spoken = roots.where("live and body_id is not null").select(F.col("body_id").alias("by")).distinct()
    gone = edges.join(spoken, "by").select("body_id").distinct()
    late = roots.where("not live").join(gone, "body_id", "left_semi").select("no")
    out = roots.join(late, "no", "left_anti").withColumn("body", F.coalesce("said", "body"))
    return out.withColumn("body", F.when(F.col("kind").isin(*OWN), F.col("body")).otherwise(bounded(F.col("body")))).select(*COLUMNS)


def spoken_for(rows: DataFrame, spoken: DataFrame) -> DataFrame:
    """``rows`` with ``spoke``: whether a trusted roster spoke for their book; ``spoken`` has extent (0 if none) and title."""
    by_extent = spoken.where("extent <> 0").select("extent", F.lit(True).alias("__x")).distinct()
    by_title = spoken.select(normalised(F.col("title")).alias("__t"), F.lit(True).alias("__y")).distinct()
    out = rows.withColumn("__t", normalised(F.coalesce("title", F.lit("")))).join(by_extent, "extent", "left").join(by_title, "__t", "left")
    return out.withColumn("spoke", F.coalesce(F.when(F.coalesce("extent", F.lit(0)) != 0, F.col("__x")).otherwise(F.col("__y")), F.lit(False))).drop("__t", "__x", "__y")


def _filled(c: str, placed: Column) -> Column:
    """A column of a fresh row ``f`` with what it lacks from the held row ``h``; ``placed`` if only their places met."""
    f, h = F.col(f"f.{c}"), F.col(f"h.{c}")
    blank = f.isNull() | (f.cast("string") == "")
    if c in ("start", "end"):
        return F.when(F.col("f.start").isNull(), h).otherwise(f)
    if c in ("colour", "page"):
        return F.when(blank, F.coalesce(h, f)).otherwise(f)
    if c == "extent":
        return F.when(F.coalesce(f, F.lit(0)) == 0, F.coalesce(h, f)).otherwise(f)
    if c == "state":
        return F.when(f == "unconfirmed", F.coalesce(h, f)).otherwise(f)
    if c in ("at", "title", "location"):
        return F.when(placed & F.col("f.location").isNull() & F.col("h.location").isNotNull(), h).otherwise(f)
    return F.when(placed & blank, F.coalesce(h, f)).otherwise(f)


def over(held: DataFrame, fresh: DataFrame, spoken: DataFrame) -> DataFrame:
    """One pass's rows over those held (COLUMNS).

    A fresh row takes what it lacks from the held row of its identity, else of its place, else the only one made in its
    second where a clipping placed that. In a book that no trusted roster spoke for, a live held row stands against a
    fresh one of its identity, a fresh row whose words a held one of its book and kind holds is left out, and held rows
    that none replaced stay; in other books the pass's rows replace what was held.
    """
    h = spoken_for(held, spoken).withColumn("hid", F.monotonically_increasing_id())
    h = pinned(h.select("hid", F.struct(*COLUMNS).alias("h"), identity(h).alias("__id"), "spoke", *COLUMNS))
    f = spoken_for(fresh, spoken).withColumn("fid", F.monotonically_increasing_id())
    f = pinned(f.select("fid", F.struct(*COLUMNS).alias("f"), identity(f).alias("__id"), "spoke", *COLUMNS))
    first = lambda rows, keys, name: rows.groupBy(*keys).agg(F.min("hid").alias(name))
    f = f.join(first(h, ["__id"], "h1"), "__id", "left")
    place = ["extent", "kind", "start", "end"]
    f = f.join(first(h.where("start is not null"), place, "h2"), place, "left")
    stamped = only_once(h.where("location is not null").select("at", "kind", F.col("hid").alias("h3")), ["at", "kind"])
    unplaced = F.count_if(F.col("location").isNull()).over(Window.partitionBy("at", "kind"))
    f = f.withColumn("__u", unplaced).join(stamped, ["at", "kind"], "left")
    other = F.coalesce("h2", F.when(F.col("location").isNull() & (F.col("__u") == 1), F.col("h3")))
    f = f.withColumns({"hid": F.coalesce("h1", other), "placed": F.col("h1").isNull()})
    f = pinned(f.join(h.select("hid", "h"), "hid", "left"))
    stands = F.col("h1").isNotNull() & ~F.col("spoke") & (F.col("h.state") == "live")
    lost = f.where(F.col("hid").isNull() & ~F.col("spoke") & (F.coalesce("body", F.lit("")) != ""))
    book = [F.coalesce("extent", F.lit(0)).alias("e"), F.when(F.coalesce("extent", F.lit(0)) == 0, normalised(F.coalesce("title", F.lit("")))).otherwise("").alias("t"), F.coalesce("kind", F.lit("")).alias("k"), "body"]
    ours, theirs = lost.select(F.col("fid").alias("id"), *book), h.select(F.col("hid").alias("id"), *book)
    ours, theirs = pinned(ours), pinned(theirs.where("body <> ''").join(ours.select("e", "t", "k").distinct(), ["e", "t", "k"], "left_semi"))
    held_words = holding(ours, theirs, ["e", "t", "k"]).select(F.col("s").alias("fid")).unionByName(holding(theirs, ours, ["e", "t", "k"]).select(F.col("l").alias("fid"))).distinct()
    taken = f.where(~F.coalesce(stands, F.lit(False))).join(held_words, "fid", "left_anti")
    new = pinned(taken.select("hid", *(F.when(F.col("hid").isNull(), F.col(f"f.{c}")).otherwise(_filled(c, F.col("placed"))).alias(c) for c in COLUMNS)))
    stay = h.where(~F.col("spoke")).join(new.where("hid is not null").select("hid").distinct(), "hid", "left_anti")
    return new.select(*COLUMNS).unionByName(stay.select(*COLUMNS))


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """``rows`` with the words that the reader set: the latest correction of a highlight holds while its words are those it was made of.

    ``corrections``: at, kind, title, location, start, edited, was, text; a null text takes the correction back.
    """
    named = corrections.withColumns({"__id": identity(corrections)})
    w = Window.partitionBy("__id").orderBy(F.desc("edited"), "text")
    last = named.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__id", F.col("was").alias("__was"), F.col("text").alias("__text"))
    out = rows.withColumn("__id", identity(rows)).join(last, "__id", "left")
    holds = F.col("__text").isNotNull() & (F.col("__was").isNull() | (F.col("__was") == F.col("body")))
    return out.withColumn("body", F.when(holds, F.col("__text")).otherwise(F.col("body"))).drop("__id", "__was", "__text")


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """``rows`` and, of ``notes``, each that isn't deleted as a row of kind ``note``: at the range its passage has now, else had when it was written.

    ``notes``: written, edited, extent, key, state, at, kind, title, location, start, from, to, words, text; those of no
    passage have no range. ``own`` tells the reader's notes from the device's, ``on`` is the identity of the passage a note names.
    """
    live = notes.where("state <> 'deleted'")
    now = rows.withColumn("__id", identity(rows)).groupBy("__id").agg(F.min(F.struct("start", "end", "extent")).alias("__p"))
    placed = live.withColumn("__id", F.when(F.col("kind") != "", identity(live))).join(now, "__id", "left")
    ranged = lambda now_, then: F.coalesce(F.col(f"__p.{now_}"), F.col(then))
    written = placed.select(
        F.coalesce("__p.extent", "extent").alias("extent"), "title", F.lit("note").alias("kind"), F.col("written").alias("at"), F.lit("live").alias("state"), ranged("start", "from").alias("start"),
        ranged("end", "to").alias("end"), F.lit(None).cast("long").alias("location"), F.lit("").alias("page"), F.lit("").alias("colour"), F.col("text").alias("body"), F.lit(True).alias("own"), F.col("__id").alias("on"),
    )
    none = F.lit(None).cast(written.schema["on"].dataType)
    return rows.select(*COLUMNS, F.lit(False).alias("own"), none.alias("on")).unionByName(written)


def counted(paired: DataFrame, group: list[str]) -> DataFrame:
    """Passages and notes of rows (kind, n_notes) by ``group``: a note that stands alone counts as a note."""
    note = F.col("kind") == "note"
    return paired.groupBy(*group).agg(F.count_if(~note).alias("passages"), F.sum(F.col("n_notes") + note.cast("int")).cast("long").alias("notes"))
