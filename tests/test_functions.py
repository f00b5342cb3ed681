"""Column functions on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from readspan.functions import dates, languages, scores, text
from readspan.operators import breakdown, edits, figures


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def test_stamps(one):
    at = dt.datetime(2026, 8, 9, 23, 59, 58)
    assert one(dates.read_iso(F.lit("2026-08-09T23:59:58"))) == at and one(dates.read_iso(F.lit("2026-08-09"))) == dt.datetime(2026, 8, 9) and one(dates.read_iso(F.lit("x"))) is None
    assert one(dates.iso_of_log(F.lit("260809:235958"))) == "2026-08-09T23:59:58" and one(dates.iso_of_log(F.lit("261309:235958"))) is None
    assert one(dates.log_of_iso(F.lit("2026-08-09T23:59:58"))) == "260809:235958" and one(dates.log_of_iso(F.lit("2026"))) is None
    assert one(dates.second_of_day(F.lit(at))) == 86398 and one(dates.second_of_day(F.lit(None).cast("timestamp_ntz"))) == 0
    assert one(dates.moved(F.lit(at), F.lit(3))) == dt.datetime(2026, 8, 10, 0, 0, 1)
    assert [one(dates.plausible(F.lit(x))) for x in (0, 50_400, -50_400, 50_460, 30)] == [True, True, True, False, False]


def test_durations_and_counts(one):
    assert [one(dates.duration(F.lit(x))) for x in (-1, 0, 29, 59, 60, 3570, 3600, 8520)] == ["0m", "0m", "<1m", "<1m", "1m", "1h", "1h", "2h 22m"]
    assert [one(dates.duration_coarse(F.lit(x))) for x in (8520, 90_000, 88_199)] == ["2h 22m", "25h", "24h"]
    assert [one(dates.duration_tight(F.lit(x))) for x in (59, 2220, 15_120)] == ["·", "37m", "4h12"]
    assert [one(dates.short_count(F.lit(x))) for x in (812, 48_400, 1_234_567)] == ["812", "48k", "1.2M"]


def test_names(one):
    split = lambda x: one(text.split_names(F.lit(x)))
    assert split("春野一郎, 秋山次郎 & B、C") == ["春野一郎", "秋山次郎", "B", "C"] and split("スミス，ジョン") == ["スミス，ジョン"] and split("") == []
    shown = lambda x: one(text.shown_name(F.lit(x)))
    assert [shown(x) for x in ("Doe,  Jane", "Davis, Jr.", "a, b, c", "山, 川", "X,", "Plain  Name")] == ["Jane Doe", "Davis, Jr.", "a, b, c", "山, 川", "X,", "Plain Name"]
    assert one(text.suggested_authors(F.lit("Doe, Jane"))) == "Jane Doe" and one(text.suggested_authors(F.lit("Jane Doe"))) is None
    assert one(text.joined_names(F.array(F.lit("山"), F.lit("川")))) == "山、川" and one(text.joined_names(F.array(F.lit("山"), F.lit("B")))) == "山 & B"


def test_tags_and_fields(one):
    value = "place\tRome\nbad\n\tx\nkind\ta\tb"
    assert [tuple(t) for t in one(text.tags_of(F.lit(value)))] == [("place", "Rome"), ("kind", "a\tb")]
    assert one(text.tags_value(text.tags_of(F.lit(value)))) == "place\tRome\nkind\ta\tb"
    assert one(text.optional(F.lit(None).cast("string"))) == "\\N" and one(text.read_optional(F.lit("\\N"))) is None and one(text.read_optional(text.optional(F.lit("\\N")))) == "\\N"
    assert one(text.flat(F.lit("a\tb\r\nc"))) == "a b  c"
    tag = lambda a, b: F.struct(F.lit(a).alias("type"), F.lit(b).alias("tag"))
    assert one(text.same_tag(tag("Ｐlace", "ROME"), tag("place ", "rome"))) and not one(text.same_tag(tag("place", "a"), tag("place", "b")))


def test_folding_and_matches(one):
    assert one(text.folded(F.lit("醫藥　Ａ"))) == "医药 a" or one(text.folded(F.lit("醫藥Ａ"))) == "医药a"
    runs = lambda line, key: [tuple(r) for r in one(text.runs_in(F.lit(line), F.lit(key)))]
    assert runs("The then THE", "the") == [(0, 3), (4, 7), (9, 12)] and runs("aaaa", "aa") == [(0, 2), (2, 4)] and runs("a.b", ".") == [(1, 2)] and runs("x", "") == [] and runs("國語", "国") == [(0, 1)]
    a, b = one(text.fingerprint([F.lit(1), F.lit(None)])), one(text.fingerprint([F.lit(None), F.lit(1)]))
    assert a != b


def test_languages(spark, one):
    names = languages.language_names(spark)
    rows = spark.createDataFrame([(x,) for x in ("Ungarisch", "english", "日本語", "JPN", "zh-TW", "Klingon", "中国語", "Deutsch", "")], "w string")
    got = {r.w: r.code for r in languages.codes_of(rows, "w", names).collect()}
    assert (got["Ungarisch"], got["english"], got["日本語"], got["JPN"], got["zh-TW"], got["Klingon"], got["中国語"], got["Deutsch"], got[""]) == ("hu", "en", "ja", "ja", "zh-Hant", None, "zh", "de", None)
    assert one(languages.suggested(F.lit("ノルウェイ"), F.lit(""))) == "ja" and one(languages.suggested(F.lit("서울"), F.lit(None).cast("string"))) == "ko" and one(languages.suggested(F.lit("x"), F.lit("y"))) is None
    assert one(languages.is_language_type(F.lit("Sprache"))) and one(languages.is_language_type(F.lit("語言"))) and not one(languages.is_language_type(F.lit("Genre")))


def test_figures_of_a_book(one):
    lit = F.lit
    left = lambda *x: one(scores.time_left(*(lit(v) for v in x)))
    assert left(True, 10.0, 100, 0.5) == 0 and left(False, 50.0, 3601, 0.5) == 3601 and left(False, 0.4, 100, 0.5) is None and left(False, 99.5, 100, 0.5) is None and left(False, 50.0, 100, 0.0) is None and left(False, 50.0, 100, 0.5, 77) == 77
    assert one(scores.words_a_minute(lit(1000), lit(250))) == 240 and one(scores.words_a_minute(lit(0), lit(250))) is None and one(scores.words_a_minute(lit(1), lit(0), lit(9))) == 9
    assert one(scores.times_finished(F.array(lit(1), lit(2)), lit(True))) == 3 and one(scores.times_finished(F.lit(None).cast("array<int>"), lit(None).cast("boolean"))) in (0, -1)
    assert one(scores.share_of(lit(10), lit(30), lit(100))) == 0.2 and one(scores.share_of(lit(-1), lit(30), lit(100))) == 0.0 and one(scores.share_of(lit(1), lit(3), lit(0))) == 0.0
    assert one(scores.through(lit(5), lit(50))) == 0.1 and one(scores.through(lit(5), lit(0))) is None and one(scores.can_restart(lit(0.4), lit(False))) is False


def test_hours(one):
    spread = lambda s, a, b: [tuple(x) for x in one(figures.spread_over(F.lit(s), F.lit(a), F.lit(b)))]
    assert spread(100, 3000, 4200) == [(0, 50), (1, 50)] and spread(101, 3000, 4200) == [(0, 51), (1, 50)] and spread(7, 5000, 5000) == [(1, 7)] and spread(0, 0, 9) == [] and spread(10, 0, 7200) == [(0, 5), (1, 5)]
    hours = lambda *x: F.array(*(F.struct(F.lit(h).alias("h"), F.lit(s).cast("long").alias("s")) for h, s in x))
    at = lambda h, t: [tuple(x) for x in one(figures.hours_at(h, F.lit(t), F.lit(0), F.lit(3600)))]
    assert at(hours((1, 10), (2, 10), (3, 5)), 50) == [(1, 20), (2, 20), (3, 10)] and at(hours((1, 10), (2, 10)), 5) == [(1, 2), (2, 3)] and at(hours((1, 1), (2, 1), (3, 1)), 1) == [(1, 1)]
    assert at(F.expr("cast(array() as array<struct<h:int,s:bigint>>)"), 9) == [(0, 9)] and at(hours((1, 3)), 3) == [(1, 3)]


def test_marks_and_stronger_books(spark):
    books = spark.createDataFrame([("a", -1, False, 10.0), ("b", 1, True, 99.6), ("c", 1, True, 10.0), ("d", 2, False, 1.0)], "cde_key string, read_state int, finished boolean, percent double")
    marks = spark.createDataFrame([("a", 2), ("b", 3), ("c", 5), ("d", 2), ("z", 1)], "cde_key string, read_state int")
    assert {r.cde_key: (r.read_state, r.finished) for r in edits.take_mark(books, marks).collect()} == {"a": (2, True), "b": (3, True), "c": (5, False), "d": (2, False)}
    other = spark.createDataFrame([("a", 7, True, 5.0), ("n", 0, False, 1.0)], "cde_key string, read_state int, finished boolean, percent double")
    got = {r.cde_key: (r.read_state, r.finished, r.percent) for r in edits.stronger(books, other, ["cde_key"], ["percent"], ["finished"]).collect()}
    assert got["a"] == (-1, True, 10.0) and got["n"] == (0, False, 1.0) and len(got) == 5


def test_chain_of_aliases_of_any_length(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"N{i + 1:03d}") for i in range(40)], "a string, b string")
    got = breakdown.alias_classes(links, "a", "b").collect()
    assert len(got) == 41 and {r["class"] for r in got} == {"n000"}


def test_value_names(spark):
    links = spark.createDataFrame(
        [("tag", "place", "Rome", ["Roma"], "1"), ("tag", "place", "Paris", ["Lutetia"], "1"), ("tag", "place", "paris", None, "2")], "field string, type string, first string, names array<string>, edited string"
    )
    held = spark.createDataFrame([(1, "tag", "place", "Roma"), (2, "tag", "place", "roma"), (3, "tag", "place", "roma"), (1, "tag", "place", "Paris"), (2, "tag", "place", "Lutetia")], "book int, field string, type string, name string")
    got = {r.name: (r.shown, r.n_books) for r in breakdown.value_names(links, held).collect()}
    assert got == {"Rome": ("roma", 0), "Roma": ("roma", 1), "roma": ("roma", 2), "Paris": ("Paris", 1), "Lutetia": ("Lutetia", 1)}
    read = spark.createDataFrame([(1, 100), (2, 50), (3, 25), (4, 5), (5, 0)], "book int, seconds long")
    bars = [(r.value, r.seconds, r.n_books, r.first_book, r.place) for r in breakdown.ranked_by_field(read, held, breakdown.value_names(links, held)).orderBy("place").collect()]
    assert bars == [("roma", 175, 3, 1, 1), ("Paris", 100, 1, 1, 2), ("Lutetia", 50, 1, 2, 3), (None, 5, 1, 4, 4)]
