"""Highlights of two sources, notes, corrections and links on small cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from readspan.operators import grams, highlights, links, notes

ROW = "extent long, title string, kind string, at timestamp_ntz, state string, start long, end long, location long, page string, colour string, body string"
NOTE = "written timestamp_ntz, edited timestamp_ntz, extent long, key string, state string, at timestamp_ntz, kind string, title string, location long, start long, `from` long, `to` long, words string, text string"


def at(s, day=11):
    return dt.datetime(2026, 3, day, 10, s // 60, s % 60)


def row(s, body, state="unconfirmed", start=None, end=None, location=None, extent=0, kind="highlight", title="T", colour=""):
    return (extent, title, kind, at(s), state, start, end, location, "", colour, body)


def shown(df):
    return sorted((r["at"].minute * 60 + r["at"].second, r.state, r.start, r.body) for r in df.collect())


def test_clippings_and_annotations_meet(spark):
    epoch = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())
    clips = spark.createDataFrame(
        [(1, "Book", "highlight", at(1), 10, "", "one"), (2, "Book", "highlight", at(2), 20, "", "two"), (3, "Book", "note", at(3), 30, "", "first words"), (4, "Lost", "highlight", at(4), 40, "", "lost"), (5, "Book", "bookmark", None, None, "", "")],
        "clip_id long, title string, kind string, at timestamp_ntz, start long, page string, body string",
    )
    notes_ = spark.createDataFrame(
        [(1, "book", "highlight", 100, 109, (epoch + 1 - 3600) * 1000 + 7, "yellow", ""), (2, "book", "highlight", 200, 209, (epoch + 900) * 1000, "blue", ""), (3, "book", "note", 300, 300, (epoch + 3 - 3600) * 1000, "", "last words"), (4, "book", "pin", 400, 400, epoch * 1000, "", "")],
        "ann_id long, file string, kind string, start long, end long, created long, colour string, body string",
    )
    rosters = spark.createDataFrame([("book", True)], "file string, trusted boolean")
    books = spark.createDataFrame([(777, "BOOK", "/d/book.kfx"), (888, "Lost", "/d/lost.kfx"), (1, "Same", ""), (2, "same", "")], "extent long, title string, location string")
    offsets = spark.createDataFrame([(3600, 0), (7200, 1)], "offset_s long, rank int")
    got = {(r.kind, r.location): (r.extent, r.state, r.start, r.colour, r.body) for r in highlights.merged(clips, notes_, rosters, books, offsets).collect()}
    assert got == {
        ("highlight", 10): (777, "live", 100, "yellow", "one"), ("highlight", 20): (777, "live", 200, "blue", "two"), ("note", 30): (777, "live", 300, "", "last words"),
        ("highlight", 40): (888, "unconfirmed", None, "", "lost"), ("bookmark", None): (777, "retired", None, "", ""), ("pin", None): (777, "live", 400, "", ""),
    }


def test_claims_are_one_to_one(spark):
    rows = [(1, 1, 0, False), (1, 2, 0, False), (2, 2, 1, False), (3, 3, 0, False), (4, 3, 0, False), (4, 4, 2, False), (5, 5, 0, False), (5, 6, 0, True)]
    got = {(r.clip_id, r.ann_id) for r in highlights.claimed(spark.createDataFrame(rows, "clip_id long, ann_id long, rank int, same boolean")).collect()}
    assert got == {(2, 2), (1, 1), (3, 3), (4, 4), (5, 6)}


def test_settled_keeps_each_highlight_once(spark):
    rows = [
        row(1, "a passage", "live", 10, 19, extent=5), row(9, "a passage, longer", "live", 10, 19, extent=5), row(2, "cut pass"), row(3, "the cut passage"), row(4, "passage, l"), row(5, "other"), row(6, ""), row(7, "", "unconfirmed"),
        row(8, "x" * 700, title="Long"), row(10, "my note", "live", 30, 30, extent=5, kind="note"), row(11, "later", "live", 30, 30, extent=5, kind="note"),
    ]
    got = shown(highlights.settled(spark.createDataFrame(rows, ROW)))
    assert got == [(1, "live", 10, "a passage, longer"), (2, "unconfirmed", None, "the cut passage"), (5, "unconfirmed", None, "other"), (6, "unconfirmed", None, ""), (7, "unconfirmed", None, ""), (8, "unconfirmed", None, "x" * 600 + "…"), (10, "live", 30, "my note")]


def test_one_pass_over_held_rows(spark):
    held = [row(1, "one", "live", 10, 19, 1, extent=5, colour="y"), row(2, "two", location=2, extent=5), row(3, "gone", location=3, extent=5), row(4, "silent", "live", location=4, extent=6), row(5, "words kept", location=5, extent=6), row(6, "moved", "live", 60, 69, 6, extent=6), row(7, "stamped", location=7, extent=6)]
    fresh = [row(1, "one again", location=1, extent=5), row(4, "new", location=4, extent=6), row(50, "kept", location=50, extent=6), row(61, "", "live", 60, 69, extent=6), row(7, "", "live", 70, 79, extent=6), row(80, "fresh", location=80, extent=6)]
    spoken = spark.createDataFrame([(5, "T")], "extent long, title string")
    got = shown(highlights.over(spark.createDataFrame(held, ROW), spark.createDataFrame(fresh, ROW), spoken))
    assert got == [(1, "live", 10, "one again"), (4, "live", None, "silent"), (5, "unconfirmed", None, "words kept"), (6, "live", 60, "moved"), (7, "live", 70, "stamped"), (80, "unconfirmed", None, "fresh")]


def test_corrections_and_notes(spark):
    rows = spark.createDataFrame([row(1, "teh words", location=1, extent=5), row(2, "fine", location=2, extent=5)], ROW)
    asked = spark.createDataFrame([(at(1), "highlight", "T", 1, None, "the words"), (at(2), "highlight", "T", 2, None, "fine"), (at(9), "highlight", "T", 9, None, "nothing")], "at timestamp_ntz, kind string, title string, location long, start long, text string")
    none = spark.createDataFrame([], "edited timestamp_ntz, at timestamp_ntz, kind string, title string, location long, start long, was string, text string")
    made = notes.set_words(none, rows, asked, F.lit(at(100)))
    assert [(r.edited, r.was, r.text) for r in made.collect()] == [(at(100), "teh words", "the words")]
    assert [b for *_, b in shown(highlights.corrected(rows, made))] == ["the words", "fine"]
    changed = rows.withColumn("body", F.concat("body", F.lit("!")))
    assert [b for *_, b in shown(highlights.corrected(changed, made))] == ["teh words!", "fine!"]
    back = notes.set_words(made, rows, asked.withColumn("text", F.lit(None).cast("string")), F.lit(at(50)))
    assert [(r.edited, r.text) for r in back.collect()] == [(at(101), None)]
    held = spark.createDataFrame([(at(5), at(5), 5, "K", "live", at(1), "highlight", "T", 1, None, 10, 19, "teh", "my note"), (at(6), at(6), 5, "K", "deleted", None, "", "", None, None, None, None, "", "")], NOTE)
    new = spark.createDataFrame([(at(5), at(5), 5, "K", "live", None, "", "", None, None, None, None, "", "second"), (at(5), at(5), 5, "K", "live", None, "", "", None, None, None, None, "", "third")], NOTE)
    lit = lambda rows: rows.withColumn("device", F.lit("d"))
    both = notes.add_notes(lit(held), lit(new)).drop("device")
    assert sorted((r.written, r.text) for r in both.collect()) == [(at(5), "my note"), (at(6), ""), (at(7), "second"), (at(8), "third")]
    edited = notes.reword(both, spark.createDataFrame([(at(7), "2nd"), (at(6), "no")], "written timestamp_ntz, text string"), F.lit(at(3)))
    gone = notes.delete(edited, spark.createDataFrame([(at(8),)], "written timestamp_ntz"), F.lit(at(90)))
    assert sorted((r.written, r.edited, r.state, r.text) for r in gone.collect()) == [(at(5), at(5), "live", "my note"), (at(6), at(6), "deleted", ""), (at(7), at(8), "live", "2nd"), (at(8), at(90), "deleted", "")]
    laid = highlights.with_notes(rows, gone).collect()
    assert sorted((r.body, r.start) for r in laid if r.own) == [("2nd", None), ("my note", 10)]
    paired = spark.createDataFrame([("b", "highlight", 2), ("b", "note", 0), ("c", "note", 1)], "book string, kind string, n_notes int")
    assert sorted(map(tuple, highlights.counted(paired, ["book"]).collect())) == [("b", 1, 3), ("c", 0, 2)]


LINK = "field string, type string, first string, names array<string>, edited timestamp_ntz"


def test_links_join_and_part(spark):
    held = spark.createDataFrame([("tag", "place", "Rome", ["Roma"], at(1)), ("tag", "place", "Wien", ["Vienna"], at(1))], LINK)
    asked = spark.createDataFrame([("tag", "place", "Rom", ["roma", "Urbs"])], "field string, type string, first string, names array<string>")
    after, before = links.link(held, asked, F.lit(at(9)))
    got = {r["first"]: r.names for r in after.collect()}
    assert sorted(got["Rom"]) == ["Roma", "Rome", "Urbs", "roma"] or sorted(x.lower() for x in got["Rom"]) == ["roma", "roma", "rome", "urbs"]
    assert got["Rome"] is None and got["Wien"] == ["Vienna"] and {r["first"]: r.names for r in before.collect()} == {"Rom": None, "Rome": ["Roma"]}
    assert {r["first"] for r in links.standing(after).collect()} == {"Rom", "Wien"}
    parted, _ = links.separate(after, spark.createDataFrame([("tag", "place", "Wien")], "field string, type string, first string"), F.lit(at(0)))
    assert {r["first"]: r.edited for r in parted.collect()}["Wien"] == at(2) and {r["first"] for r in links.standing(parted).collect()} == {"Rom"}
    bad = spark.createDataFrame([("language", "", "a", ["b"]), ("tag", "", "a", ["A "]), ("tag", "", "a", ["b"])], "field string, type string, first string, names array<string>")
    assert links.refused(bad).count() == 2
    new = {r["first"]: r.names for r in links.renamed(held, "tag", "place", "roma", "Rome").collect()}
    assert new == {"Rome": None, "Wien": ["Vienna"]}
    assert {r.type for r in links.refiled(held, "Place", "town").collect()} == {"town"}


def test_tags_respelled(spark):
    tags = lambda *x: [("Genre", t) for t in x]
    rows = spark.createDataFrame([(1, tags("Sci-Fi", "Old")), (2, tags("sci-fi")), (3, tags("Sci-Fi")), (4, [])], "book int, tags array<struct<type:string,tag:string>>")
    spellings = links.spelled(rows, "book", "tags")
    got = {r.book: ([t.tag for t in r.tags], r.changed) for r in links.respelled(rows, "tags", spellings).collect()}
    assert got == {1: (["Sci-Fi", "Old"], False), 2: (["Sci-Fi"], True), 3: (["Sci-Fi"], False), 4: ([], False)}
    assert [t.tag for t in links.retag(rows, "tags", ("genre", "OLD"), ("Genre", "Sci-Fi")).where("book = 1").first().tags] == ["Sci-Fi"]
    assert [t.tag for t in links.retag(rows, "tags", ("genre", "OLD"), None).where("book = 1").first().tags] == ["Sci-Fi"]
    assert links.rename_type(rows, "tags", "genre", "Kind").first().tags[0].type == "Kind"
    assert links.spell(spark.createDataFrame([("GENRE", "SCI-FI"), ("x", "y")], "type string, tag string"), spellings).select("spelt.tag").collect()[0].tag in ("Sci-Fi", "y")


def test_copies_settle_once_a_text(spark):
    """Six thousand copies of one text and a later one that holds it: 18 million pairs of rows, one of texts."""
    from readspan.operators import grams, highlights

    n = 6000
    rows = spark.range(n).select(F.lit("g").alias("g"), "id", F.col("id").alias("at"), F.lit("A passage of some words").alias("body"))
    rows = rows.unionByName(spark.createDataFrame([("g", n, 7, "the passage of some words, once"), ("g", n + 1, 9, "passage  of some"), ("g", n + 2, None, "passage"), (None, n + 3, 1, "x"), (None, n + 4, 2, "x")], "g string, id long, at long, body string"))
    met = []
    whole, grams_holding = highlights.holding, grams.holding
    highlights.holding = lambda *a: met.append(grams_holding(*a)) or met[-1]
    try:
        left = highlights.settle_words(rows, ["g"], "id", "body", "at")
        assert sorted(r.id for r in left.collect()) == [n - 1, n, n + 2, n + 3, n + 4]
    finally:
        highlights.holding = whole
    assert met[0].count() == 5


def test_windows_of_grams_find_all_that_is_held(spark):
    from readspan.operators import grams

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([30, 90, 300]))).strip() or "a" for _ in range(60)]
    parts = [t[(a := rng.randrange(len(t))) : a + rng.choice([1, 2, 5, 8, 9, 12, 15, 16, 40, 90])] for t in texts for _ in range(4)]
    short = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(parts)], "g int, id long, body string")
    long = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "g int, id long, body string")
    want = sorted((i, j) for i, s in enumerate(parts) for j, t in enumerate(texts) if i % 2 == j % 2 and s and s in t)
    assert sorted((r.s, r.l) for r in grams.holding(short, long, ["g"]).collect()) == want
    few, grams.FEW_GRAMS = grams.FEW_GRAMS, 3
    try:
        assert sorted((r.s, r.l) for r in grams.holding(short, long, ["g"]).collect()) == want
    finally:
        grams.FEW_GRAMS = few


def test_small_groups_meet_without_grams(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i % 7 or None, i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) + ("x" * 15 if i % 5 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(texts, "g int, id int, body string")
    want = sorted((a, b) for g, a, x in texts for h, b, y in texts if g is not None and g == h and x and x in y)
    found = grams.holding(df, df, ["g"])
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    for few in (128, 17, 0):  # all groups are small, some are, none is
        monkeypatch.setattr(grams, "FEW_TEXTS", few)
        assert sorted((r.s, r.l) for r in grams.holding(df, df, ["g"]).collect()) == want


def test_settling_words_fetches_rows_by_number(spark):
    rows = spark.createDataFrame([(1, 1, "a b", 1), (1, 2, "a b", 2), (1, 3, "x a b", 1), (2, 4, "a b", 1), (None, 5, "a b", 1), (None, 6, "a b", 2), (1, 7, "later", None)], "g int, id int, body string, at int")
    left = highlights.settle_words(rows, ["g"], "id", "body", "at")
    assert sorted(r.id for r in left.collect()) == [2, 3, 4, 5, 6, 7]
    joins = [x for x in left._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("body" in x for x in joins)
