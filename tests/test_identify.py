"""Which book a sitting is of, on small cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from readspan.operators import identify
from readspan.sources import catalog

SITTING = "started_at timestamp_ntz, ended_at timestamp_ntz, extent long, key string, seconds long, end_position long, end_counter_ms long, end_words long, progress double"
BOOK = "extent long, cde_key string, title string, author string, identified_by int, percent double, kept boolean, timer_ms long, timer_words long, timer_covered double"


def at(h, m=0):
    return dt.datetime(2026, 3, 11, h, m)


def sitting(h, extent, key=None, seconds=600, minutes=30, total=None, words=None, progress=None):
    return (at(h), at(h, minutes), extent, key, seconds, extent, total, words, progress)


def tables(spark, sittings, books=(), keys=(), pairs=()):
    return (
        spark.createDataFrame(list(sittings), SITTING), spark.createDataFrame([(*b, *(None,) * (10 - len(b))) for b in books], BOOK),
        spark.createDataFrame(list(keys), "extent long, key string"), spark.createDataFrame(list(pairs), "extent long, file string"),
    )


def witnesses(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "wid long, at timestamp_ntz, title string, author string, key string, pos long")


def test_slots(spark):
    sit, books, keys, pairs = tables(spark, [], [(10, "K1", "One", "", 0), (20, "K2", "Two", "", 3), (0, "K3", "Three", "", 0), (50, "f", "F", "", 3)], [(30, "K3"), (40, "K1"), (40, "K3")], [(60, "f")])
    rows = spark.createDataFrame([(10, None), (20, "K1"), (20, "zz"), (30, None), (40, None), (60, None), (70, "K3"), (80, None), (None, None)], "extent long, key string")
    got = {(r.extent, r.key): r.slot for r in identify.slots(rows, books, keys, pairs).collect()}
    assert got == {(10, None): "K1", (20, "K1"): "K1", (20, "zz"): "K2", (30, None): "K3", (40, None): None, (60, None): "f", (70, "K3"): "K3", (80, None): None, (None, None): None}


def test_cascade_of_sources(spark):
    sit, books, keys, pairs = tables(
        spark, [sitting(8, 100), sitting(9, 200), sitting(10, 300), sitting(11, 400, seconds=59), sitting(12, 500), sitting(13, 600), sitting(14, 700), sitting(14, 701)],
        [(0, "K2", " The  Second", "", 0), (500, "old", "Wrong", "", 3), (0, "D1", "Twice", "", 0), (0, "D2", "twice", "", 0)], [(500, "old")],
    )
    lookups = witnesses(spark, [
        (at(8, 5), "First", "A", "K1", 50), (at(8, 6), "first ", "A", "", 101), (at(9, 5), "the second", "B", "", -1), (at(10, 1), "X", "", "", 1), (at(10, 2), "Y", "", "", 1), (at(11, 1), "Short", "", "", 1),
        (at(12, 1), "Right", "C", "K5", 3), (at(14, 1), "Both", "", "", 1), (at(20, 1), "Nobody", "", "", 1),
    ])
    clippings = witnesses(spark, [(at(10, 3), "X", "", "", None), (at(8, 7), "Late", "", "", None), (at(13, 1), "Twice", "", "", None)])
    books, keys, contested = identify.identify(sit, books, keys, pairs, [(identify.CLIPPINGS, clippings), (identify.LOOKUPS, lookups)])
    got = {r.cde_key: (r.extent, r.title, r.identified_by) for r in books.collect()}
    assert got == {"K1": (100, "First", 1), "K2": (200, " The  Second", 0), "K5": (500, "Right", 1), "D1": (0, "Twice", 0), "D2": (0, "twice", 0), "Twice": (600, "Twice", 2)}
    assert {(r.extent, r.key) for r in keys.collect()} == {(200, "K2")} and [r.extent for r in contested.collect()] == [300]


def test_recover_by_counters(spark):
    sit, books, keys, pairs = tables(spark, [sitting(8, 10, total=7000, words=5), sitting(9, 20, total=8000, words=6), sitting(10, 30, total=8000, words=6), sitting(11, 40, total=9000, words=7), sitting(12, 50, total=1, words=1)],
                                     [(0, "B00ABCDEFG", "Named", "", 0), (50, "Z", "Z", "", 0), (77, "K", "K", "", 0)], [], [(77, "other")])
    counters = spark.createDataFrame([(7000, 5, 10)], "total_ms long, words long, end_position long")
    ends = spark.createDataFrame([(40, 44)], "end_position long, extent long")
    cards = spark.createDataFrame([("My_B00ABCDEFG_file.kfx", 7000, 5), ("tie", 8000, 6), ("A_Title.azw", 9000, 7), ("zero", 0, 0), ("held", 1, 1)], "file string, total_ms long, words long")
    books, pairs = identify.recover(cards, sit, counters, ends, books, keys, pairs)
    got = {r.cde_key: (r.extent, r.title) for r in books.collect()}
    assert got == {"B00ABCDEFG": (10, "Named"), "Z": (50, "Z"), "K": (77, "K"), "A_Title.azw": (44, "A Title")}
    assert {(r.extent, r.file) for r in pairs.collect()} == {(10, "My_B00ABCDEFG_file.kfx"), (44, "A_Title.azw")}


def test_books_of_sittings(spark):
    sit, books, keys, pairs = tables(spark, [sitting(8, 10, progress=0.4), sitting(9, 10, progress=0.9), sitting(10, 20, progress=1.2)], [(10, "A", "a", "", 0, 50.0, False), (20, "B", "b", "", 0, None, False), (30, "C", "c", "", 0, None, True), (40, "D", "d", "", 0, None, False)], [], [(10, "f")])
    assert {r.cde_key for r in identify.shown(books, sit, keys, pairs).collect()} == {"A", "B", "C"}
    stated = spark.createDataFrame([("B",)], "cde_key string")
    assert {r.cde_key: r.percent for r in identify.progress(books, sit, stated).collect()} == {"A": 90.0, "B": None, "C": None, "D": None}
    assert {r.cde_key: r.percent for r in identify.progress(books, sit, stated.limit(0)).collect()}["B"] == 100.0
    cards = spark.createDataFrame([("f", 5, 6, 0.5), ("g", 1, 1, 0.1)], "file string, total_ms long, words long, covered double")
    assert {r.cde_key: r.timer_ms for r in identify.timers(books, cards, pairs).collect()} == {"A": 5, "B": None, "C": None, "D": None}
    book, mine = identify.one_book("A", books, sit, keys, pairs)
    assert (book.count(), mine.count()) == (1, 2)
    assert {r.extent for r in identify.wanting(sit, books, keys, pairs, identify.LOOKUPS).collect()} == set()
    now = spark.createDataFrame([("clips", 2), ("db", 1), ("new", 1)], "name string, stamp long")
    held = spark.createDataFrame([("clips", 1), ("db", 1), ("gone", 1)], "name string, stamp long")
    assert {r.name for r in identify.changed(held, now, "name", "stamp").collect()} == {"clips", "new", "gone"}


def test_catalogue_over_held_books(spark):
    schema = "extent long, cde_key string, title string, percent double, on_device boolean, note string"
    held = spark.createDataFrame([(10, "A", "old", 5.0, True, "n"), (0, "B", "b", None, True, None), (30, "C", "c", None, True, None), (1, "T", "t1", None, True, None), (2, "T", "t2", None, True, None)], schema)
    listed = spark.createDataFrame([(10, "A", "new", None, True), (20, "B", "", 7.0, True), (9, "N", "n", None, False), (3, "T", "t3", None, True)], "extent long, cde_key string, title string, percent double, on_device boolean")
    got = {(r.cde_key, r.extent): (r.title, r.percent, r.on_device, r.change) for r in catalog.merged(held, listed).collect()}
    assert got == {
        ("A", 10): ("new", 5.0, True, "changed"), ("B", 20): ("b", 7.0, True, "changed"), ("C", 30): ("c", None, False, "changed"), ("N", 9): ("n", None, False, "added"), ("T", 3): ("t3", None, True, "added"),
        ("T", 1): ("t1", None, False, "changed"), ("T", 2): ("t2", None, False, "changed"),
    }


def test_lookups(spark):
    looked = spark.createDataFrame([("b1", "AfQ:77", 1_700_000_000_123), ("b1", "x", 5_000), ("b2", "1", 9_000), ("b1", "2", 0), ("zz", "2", 9)], "book_key string, pos string, timestamp long")
    infos = spark.createDataFrame([("b1", "ASIN", "Title", "Auth"), ("b2", "Q", None, None)], "id string, asin string, title string, authors string")
    got = sorted((r.epoch, r.title, r.author, r.key, r.pos) for r in catalog.lookups(looked, infos).collect())
    assert got == [(5, "Title", "Auth", "ASIN", None), (1_700_000_000, "Title", "Auth", "ASIN", 77)]
    assert [r.x for r in spark.createDataFrame([("/a/b.kfx",), ("/a/run.SH",), ("/d/My Clippings.txt",), ("plain",)], "l string").select(catalog.is_reading(F.col("l")).alias("x")).collect()] == [True, False, False, True]


def test_around_equals_all_pairs(spark):
    rng = random.Random(3)
    time = lambda n: at(0) + dt.timedelta(minutes=10 * n)
    spans = [(time(a := rng.randrange(90)), time(a + rng.choice([0, 1, 2, 3, 20])), rng.randrange(25), rng.choice([None, "K"]) and f"K{i}", i) for i in range(45)]
    points = [(rng.choice([i, i, i, 7]), time(rng.randrange(100)) + dt.timedelta(seconds=rng.choice([0, 0, 1]))) for i in range(400)]
    s = spark.createDataFrame(spans, "started_at timestamp_ntz, ended_at timestamp_ntz, extent long, key string, seconds long")
    got = {r.wid: (r.extent, r.seconds) for r in identify.around(spark.createDataFrame(points, "wid long, at timestamp_ntz"), s).collect()}
    met = {}
    for wid, p in points:
        met.setdefault(wid, []).extend((x[2], x[4]) for x in spans if x[0] <= p <= x[1])
    want = {wid: (rows[0][0], max(r[1] for r in rows)) for wid, rows in met.items() if len({r[0] for r in rows}) == 1}
    assert len(want) > 50 and got == want


def test_extents_are_counted_not_paired(spark):
    """Twelve thousand sittings that overlap and as many witnesses within them: 144 million pairs, none of one extent alone but the last."""
    n = 12_000
    ids = spark.range(n).withColumns({"started_at": F.lit(at(5)), "ended_at": F.lit(at(5, 50)), "extent": F.col("id"), "key": F.lit("K"), "seconds": F.lit(600).cast("long")})
    alone = spark.createDataFrame([(-1, at(9), at(9, 9), n, "L", 60)], ids.schema)
    marks = spark.range(n).select(F.col("id").alias("wid"), F.lit(at(5, 30)).alias("at")).unionByName(spark.createDataFrame([(-1, at(9, 5))], "wid long, at timestamp_ntz"))
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")}
    met = identify.around(marks.withColumn("at", F.col("at").cast("timestamp_ntz")), ids.unionByName(alone).withColumns(stamps))
    assert [tuple(r) for r in met.collect()] == [(-1, n, "L", 60)]
