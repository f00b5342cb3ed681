"""Pages of books on small cases: notes under passages, books by extent and title, blocks of any length."""

import random

from pyspark.sql import functions as F

from readspan.operators import bookpage
from tests.test_highlights import NOTE, ROW, at, row

FIXES = "edited timestamp_ntz, at timestamp_ntz, kind string, title string, location long, start long, was string, text string"


def test_covering_equals_all_pairs(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 3, 40, 1000, 9999])) for i, s in enumerate(rng.sample(range(5000), 60))] + [(99, "a", 7, 6)]
    points = [(i, rng.choice("abc"), rng.randrange(6000)) for i in range(200)]
    got = bookpage.covering(spark.createDataFrame(points, "p int, k string, x long"), spark.createDataFrame(spans, "s int, k string, lo long, hi long"), ["k"], "x", "lo", "hi")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, k, x in points for s, j, lo, hi in spans if k == j and lo <= x <= hi)


def test_notes_lie_under_their_passages(spark):
    rows = [
        row(1, "wide", "live", 10, 90, extent=5), row(2, "narrow", "live", 20, 40, extent=5), row(3, "as narrow", "live", 25, 45, extent=5), row(9, "device note", "live", 30, 30, extent=5, kind="note"), row(10, "nowhere", "live", 200, 200, extent=5, kind="note"),
        row(11, "elsewhere", "live", 30, 30, extent=6, kind="note", title="U"), row(12, "mark", "live", 30, 31, extent=5, kind="bookmark"), row(4, "by title", location=4, title=" t "), row(5, "", None, None, None, extent=7, title=None),
    ]
    said = [(at(50), at(50), 5, "K", "live", at(1), "highlight", "T", None, 10, 10, 90, "wide", "named"), (at(51), at(51), 5, "K", "deleted", at(2), "highlight", "T", None, 20, 20, 40, "", "gone"), (at(52), at(52), 5, "K", "live", at(59), "highlight", "T", None, 1, 80, 80, "", "passage gone")]
    books = spark.createDataFrame([(70, 5, "T", 1), (71, 5, "other", 2), (72, 0, "u", 3)], "book int, extent long, title string, order int")
    pages = bookpage.book_pages(spark.createDataFrame(rows, ROW), spark.createDataFrame([(at(99), at(2), "highlight", "T", None, 20, "narrow", "NARROW")], FIXES), spark.createDataFrame(said, NOTE), books)
    got = {r.body: (r.book, [n.body for n in r.notes]) for r in pages.collect()}
    assert got == {"wide": (70, ["passage gone", "named"]), "NARROW": (70, []), "as narrow": (70, ["device note"]), "nowhere": (70, []), "elsewhere": (72, []), "by title": (70, []), "": (None, [])}
    assert {r.book: (r.passages, r.notes) for r in bookpage.page_figures(pages).collect()} == {70: (4, 4), 72: (0, 1)}
    shown = lambda df: [r.body for r in sorted(df.collect(), key=lambda r: r.place)]
    assert shown(bookpage.listing(pages, kinds=["highlight"])) == ["", "by title", "as narrow", "NARROW", "wide"]
    assert shown(bookpage.listing(pages, "DEVICE")) == ["as narrow"] and shown(bookpage.listing(pages, "narrow", newest_first=False)) == ["NARROW", "as narrow"]
    assert bookpage.listing(pages.where(F.lit(False))).count() == 0


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(5)
    time = lambda: rng.choice([None, *range(1, 9)])
    stamp = lambda t: t and f"2026-01-01 00:00:0{t}.{rng.randrange(3)}"
    spans = [(rng.choice("ab"), s := rng.randrange(-9, 40), s + rng.choice([-1, 0, 2, 3, 7, 30]), stamp(time()), i) for i in range(400)]
    points = [(rng.choice("abc"), rng.randrange(-9, 60), stamp(time()), i) for i in range(300)]
    p = spark.createDataFrame(points, "extent string, p long, said string, __no long").withColumn("said", F.col("said").cast("timestamp_ntz"))
    s = spark.createDataFrame(spans, "extent string, s long, e long, made string, over long").withColumn("made", F.col("made").cast("timestamp_ntz"))
    gap = F.abs(F.unix_seconds(F.col("made").cast("timestamp")) - F.unix_seconds(F.col("said").cast("timestamp")))
    near = F.struct((F.col("e") - F.col("s")).alias("n"), gap.alias("g"), (-F.unix_micros(F.col("made").cast("timestamp"))).alias("m"), "over")
    want = p.join(s, "extent").where("p between s and e").groupBy("__no").agg(F.min(near)["over"].alias("under"))
    got = bookpage._nearest(p, s).collect()
    assert len(got) > 150 and sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
