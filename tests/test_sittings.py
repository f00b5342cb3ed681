"""The sessioniser on small logs: breaks, starts, counters that come late, pages, power."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from readspan.functions import logline, scores
from readspan.operators import intervals
from readspan.sources import logs
from readspan.streaming import late
from readspan.streaming import sittings as stream

BOOK, OTHER, CHAPTER = 91500, 440021, 30500


def timer(at, said, day="260311"):
    return f"{day}:{at} cvm[71]: I ReadingTimerController:Information::{said}"


def turn(at, total, interval=40000, words=None, book=BOOK, event="NextPage", day="260311", more="%Left:0.5"):
    words = total // 200 if words is None else words
    return timer(at, f"{event},PageStartPos:YJPosition: Aa:17,IntervalTime:{interval},IntervalWords:250,TotalTime:{total},TotalWords:{words},CurrentPos:YJPosition: Aa:17,EndPos:YJPosition: Ab:{book},PosLeft:9,{more};", day)


def place(at, book=BOOK):
    return timer(at, f"CurrentPos:YJPosition: Aa:17,EndPos:YJPosition: Ab:{book},PosLeft:9;")


def flush(at, total, words, book=BOOK):
    """The tail of a chapter's event, then a page that the counter refused, then the sleep."""
    tail = f"NewTimeLeft:60,NextTOCEntryPosition:YJPosition: Ac:{CHAPTER},NextTOCEntryLength:3,CurrentPos:YJPosition: Aa:17,EndPos:YJPosition: Ac:{CHAPTER},PosLeft:4,"
    return timer(at, f"{tail}PageStartPos:YJPosition: Aa:19,IntervalTime:5000,IntervalWords:90,SkipAvgReason:Other,TotalTime:{total},TotalWords:{words},CurrentPos:YJPosition: Aa:19,EndPos:YJPosition: Ab:{book},%Left:0.9;Reading_Interrupted,Reason:1;")


def opens(at, read):
    return timer(at, f"OpenBook,StoredBookData:{read};")


def wake(at, reason=2):
    return timer(at, f"Reading_Resumed,Reason:{reason};")


def page(at, start=-1, words=300, day="260311", end=None):
    place = "" if start < 0 else f'"start_position" : {start}, "end_position" : {end if end is not None else start + 915}, '
    return f'{day}:{at} fast[1]: SchemaName[ereader_book_consume_content], Fields[{{ {place}"words_count" : {words} }}]'


def power(at, on, day="260311"):
    return f"{day}:{at} powerd[2]: lipc:evts:name={'outOfScreenSaver' if on else 'goingToScreenSaver'}, origin=com.lab126.powerd"


KEY = '260311:100050 fast[1]: SchemaName[ereader_reader_latency_ops], Fields[{ "cde_key" : "B0XYZ" }]'
CLOSE = "260311:100030 fast[1]: SchemaName[ereader_close_book]"

#: Every case is a device's log; all are read in one pass.
LOGS = {
    "first page": [opens("101500", "null"), place("101501"), turn("101541", 40000), turn("101621", 80000)],
    "whole seconds": [opens("101500", "TimeRead:6,200 sec. WPM:0"), place("101501"), turn("101541", 6_200_700 + 40_000)],
    "other open": [opens("101500", "TimeRead:6,200 sec."), turn("101541", 9_000_000), turn("101621", 9_040_000)],
    "open and close": [opens("180000", "null"), place("180002"), turn("182500", 10_300, 30_000, event="CloseBook")],
    "midnight": [turn("235900", 5_000_000, 20_000), turn("235950", 5_050_000, 50_000), turn("000030", 5_090_000, 40_000, day="260312")],
    "metrics past midnight": [flush("230000", 800_000, 900), power("230000", False), power("235000", True), wake("235000"), page("235010"), page("235500"), page("000100", day="260312"), page("000500", day="260312")],
    "wake": [
        turn("120000", 700_000), turn("120040", 740_000), power("120100", False), wake("123500"), power("123500", True), timer("123540", "Reading_Interrupted,Reason:1;"), power("123540", False),
        wake("123800"), power("123800", True), turn("123815", 755_000, 15_000), turn("123855", 795_000),
    ],
    "shared gain": [
        opens("221000", "TimeRead:1,000 sec."), flush("221010", 1_000_400, 5_000), flush("222000", 1_300_400, 6_500), page("222006"), power("222007", False), power("222200", False),
        wake("231500"), power("231500", True), turn("232500", 1_607_000, 9_000, 8_000, event="CloseBook"),
    ],
    "hole": [turn("080000", 7_000_000), power("080030", False), wake("081000"), power("081000", True), page("081001"), turn("190000", 12_000_000), turn("190040", 12_040_000)],
    "silence": [flush("120000", 3_000_000, 100), power("120000", False), power("143000", True), wake("143001"), flush("150201", 4_900_000, 900), power("150201", False)],
    "silence with pages": [flush("070000", 900_000, 100), power("070000", False), power("081400", True), wake("081400"), page("090000"), page("091000"), page("092000"), flush("093400", 3_800_000, 900), power("093400", False)],
    "left open": [
        flush("100000", 600_000, 50), power("100000", False), power("120000", True), wake("120000"), page("120010"), page("120100"), page("120200"), timer("120500", "Reading_Interrupted,Reason:1;"), power("120500", False),
    ],
    "open waits": [turn("100000", 7_000_000), page("100010"), opens("100500", "null"), page("100510"), page("100610"), turn("100700", 60_000, book=OTHER)],
    "open again": [turn("100000", 7_000_000), page("100010"), opens("100500", "TimeRead:7,000 sec."), page("100510"), page("100610"), turn("100700", 7_040_000)],
    "pages": [turn("100000", 1000, 0), page("100001", 10, 100), page("100031", 20, 50), page("100032", 20, 50), page("100532", 30, 7), turn("100533", 1000, 0)],
    "slept page": [turn("100000", 1000, 0), page("100001"), power("100021", False), power("100521", True), page("100531"), page("100541")],
    "closed page": [turn("100000", 1000, 0), page("100001"), "x", CLOSE, page("100040")],
    "chapter": [power("100000", False), power("100010", True), flush("100020", 1000, 5), place("100100", CHAPTER), place("100130"), place("100300"), power("100310", False)],
    "late fields": [
        turn("100000", 1000, 0, more="%Left:0.9,TotalWPM:210.5"), turn("100040", 41000, more="%Left:0.8,NewTimeLeft:300"), KEY, turn("100100", 61000, event="GoToPosition", more="%Left:0.4"),
        turn("100140", 101000, more="%Left:0.3"),
    ],
    "a": [turn("100000", 1000, 0), turn("100040", 41000), turn("100040", 41000), None],
    "b": [turn("100010", 900_000, 0), turn("100020", 910_000)],
    "counter names": [
        turn("220000", 604_250, 40_000, 2_400), turn("220100", 604_250, 100, 2_400, event="CloseBook"), opens("221500", "TimeRead:604 sec."), page("221503"), page("221603"), page("221950"), page("222330"), timer("222400", "OldTimeLeft:900"),
        opens("230000", "TimeRead:1,010 sec."), turn("230020", 1_010_400, 400, 4_100, event="CloseBook"),
    ],
    "counter names, alone": [
        turn("220000", 604_250, 40_000, 2_400), turn("220100", 604_250, 100, 2_400, event="CloseBook"), opens("221500", "TimeRead:604 sec."), page("221503"), page("221603"), page("221950"), page("222330"), timer("222400", "OldTimeLeft:900"),
    ],
    "counter names none": [turn("220000", 604_250, 100, 2_400, event="CloseBook"), opens("221500", "TimeRead:605 sec."), page("221503"), page("221603")],
    "counter names two": [turn("220000", 604_250, 100, 2_400, event="CloseBook"), turn("220100", 604_900, 100, 10, book=OTHER, event="CloseBook"), opens("221500", "TimeRead:604 sec."), page("221503"), page("221603")],
    "counter named by then": [turn("220000", 604_250, 100, 2_400, event="CloseBook"), turn("220100", 704_900, 100, 2_500, event="CloseBook"), opens("221500", "TimeRead:604 sec."), page("221503"), page("221603"), opens("230000", "null")],
    "held across a sleep": [
        power("105000", True), turn("105003", 7_000_000, 0), page("105010"), turn("105020", 7_000_000, 0), power("105200", False), power("111000", True), page("111500"), turn("111510", 7_000_000, 0), power("111600", False),
    ],
    "step back": [turn("104500", 7_000_000), turn("104540", 7_040_000), turn("064620", 7_080_000), turn("064700", 7_120_000)],
}


@pytest.fixture(scope="module")
def sits(spark):
    rows = spark.createDataFrame([(device, x) for device, lines in LOGS.items() for x in lines], "device string, line string").dropDuplicates()
    out = {device: [] for device in LOGS}
    for r in sorted(stream.sittings(logs.observations(rows)).collect(), key=lambda r: r.started_at):
        out[r.device].append(r)
    return out


def at(text, day=11):
    return dt.datetime(2026, 3, day, *(int(text[i : i + 2]) for i in (0, 2, 4)))


def test_credit_of_a_page(spark):
    rows = [(1, 9000, 300, False, False), (1, 60000, 30, True, False), (1, 60000, 200, True, False), (1, 900000, 300, True, True), (1, 90000, 190, False, True), (None, 9000, 300, False, False), (1, None, 9, False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t long, ms long, w long, refused boolean, closes boolean")
    got = [tuple(r.c) for r in df.select("i", scores.credits(*(F.col(c) for c in ("t", "ms", "w", "refused", "closes"))).alias("c")).orderBy("i").collect()]
    assert got == [(9000, 300, 0), (0, 0, 0), (0, 0, 60000), (0, 0, 0), (0, 0, 90000), (0, 0, 0), (0, 0, 0)]


def test_payload_that_a_line_is_read_by(spark):
    lines = [flush("100000", 7000, 50), place("100001"), timer("100002", f"NextPage,EndPos:MobiSerializedPosition:12 {BOOK};"), timer("100003", f"Other,EndPos:YJPosition: Ab:{BOOK};"), timer("100004", "NewTimeLeft:60,NextTOCEntryPosition:HTMLPosition:5,EndPos:HTMLPosition:5,TotalTime:9;")]
    got = logs.observations(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("ts").collect()
    assert [(r.position, r.total_ms, r.refused) for r in got] == [(BOOK, 7000, True), (BOOK, None, False), (BOOK, None, False), (None, None, None), (None, None, None)]
    assert got[0].chapters == [CHAPTER] and got[0].chapter_books == [BOOK] and got[0].left_share == 0.9 and got[4].chapters == [5]


def test_first_page_counts_where_the_open_vouches(sits):
    (r,) = sits["first page"]
    assert (r.seconds, r.timed_seconds, r.started_at, r.start_counter_ms) == (80, 80, at("101500"), 0)
    (r,) = sits["whole seconds"]
    assert (r.seconds, r.start_counter_ms) == (40, 6_200_700)  # under a second past the stated seconds is rounding
    (r,) = sits["other open"]
    assert (r.seconds, r.started_at) == (40, at("101541"))  # the open's counter can't be this book's
    (r,) = sits["open and close"]
    assert (r.seconds, r.start_counter_ms, r.measure) == (10, 0, "counted")


def test_midnight_shares_the_page_that_stands_over_it(sits):
    a, b = sits["midnight"]
    assert (a.seconds, a.timed_seconds, a.ended_at) == (60, 60, at("235959"))
    assert (b.seconds, b.timed_seconds, b.started_at, b.start_counter_ms) == (30, 30, at("000000", 12), 5_060_000)


def test_hours_add_up(sits):
    hours = lambda r: [tuple(x) for x in r.hours]
    assert [hours(r) for r in sits["midnight"]] == [[(23, 60)], [(0, 30)]] and [hours(r) for r in sits["step back"]] == [[(6, 40)], [(10, 40)]]
    assert [hours(r) for r in sits["silence with pages"]] == [[(8, 1667), (9, 1233)]] and [hours(r) for r in sits["left open"]] == [[(12, 110)]]
    assert all(sum(s for _, s in hours(r)) == r.seconds for rows in sits.values() for r in rows)


def test_page_metrics_go_past_midnight(sits):
    got = sits["metrics past midnight"]
    assert [(r.started_at, r.ended_at) for r in got] == [(at("235000"), at("235959")), (at("000000", 12), at("000500", 12))]
    assert {r.end_position for r in got} == {BOOK}


def test_wake_starts_the_sitting_that_its_first_page_opens(sits):
    a, b = sits["wake"]
    assert a.seconds == 40 and (b.started_at, b.start_counter_ms, b.seconds, b.timed_seconds) == (at("123800"), 740_000, 55, 55)


def test_gain_of_a_sleep_is_shared_by_the_seconds_awake(sits):
    a, b = sits["shared gain"]
    ours = (1_607_000 - 1_300_400) * 600 // 606
    assert (b.started_at, b.start_counter_ms, b.measure) == (at("231500"), 1_607_000 - ours, "counted")
    assert a.end_counter_ms == b.start_counter_ms and a.seconds == (a.end_counter_ms - 1_000_000) // 1000 and b.seconds == ours // 1000


def test_wake_before_a_hole_in_the_log_starts_nothing(sits):
    assert sits["hole"] and all(r.seconds < 100 and r.started_at != at("081000") for r in sits["hole"])


def test_silence_between_two_counters_is_read_from_its_wake(sits):
    (r,) = sits["silence"]
    assert (r.started_at, r.start_counter_ms, r.seconds) == (at("143001"), 3_000_000, 1900)
    (r,) = sits["silence with pages"]
    assert (r.started_at, r.start_counter_ms, r.seconds, r.measure) == (at("081400"), 900_000, 2900, "counted")


def test_pages_after_a_wake_are_the_book_left_open(sits):
    (r,) = sits["left open"]
    assert (r.end_position, r.started_at, r.ended_at, r.measure, r.paged_seconds, r.words) == (BOOK, at("120000"), at("120200"), "paged", 110, 600)


def test_pages_after_an_open_wait_for_its_book(sits):
    (r,) = sits["open waits"]
    assert (r.end_position, r.started_at, r.paged_seconds) == (OTHER, at("100500"), 60)
    (r,) = sits["open again"]
    assert r.paged_seconds == 180


def test_pages(sits):
    (r,) = sits["pages"]
    assert (r.seconds, r.measure, r.words) == (150, "paged", 150) and r.covered == pytest.approx(2 * 915 / BOOK)
    (r,) = sits["slept page"]
    assert r.seconds == 40  # slept five minutes of the first page
    assert sits["closed page"] == []


def test_chapter_is_no_book_and_awake_is_the_last_measure(sits):
    (r,) = sits["chapter"]
    assert (r.end_position, r.measure, r.seconds, r.started_at) == (BOOK, "awake", 160, at("100020"))


def test_late_fields(sits):
    (r,) = sits["late fields"]
    assert (r.content_key, r.time_left, r.stated_wpm, round(r.progress, 6)) == ("B0XYZ", 300, 210, 0.7)
    assert [(round(x["from"], 6), round(x["to"], 6)) for x in r.stretches] == [(0.1, 0.2), (0.6, 0.7)]


def test_devices_are_apart_and_a_clock_step_cuts(sits):
    assert [(r.seconds, r.page_turns) for r in (*sits["a"], *sits["b"])] == [(40, 2), (10, 2)]
    assert [(r.started_at, r.seconds) for r in sits["step back"]] == [(at("064620"), 40), (at("104500"), 40)]


def test_no_lines_give_no_sittings(spark):
    assert stream.sittings(logs.observations(spark.createDataFrame([], "device string, line string"))).count() == 0


def test_from_book(spark):
    lines = ["x BookEndPosition.FromBook:HTMLPosition:99;", "x,BookEndPosition.FromBook:YJPosition: Ab:77,y", "none"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(logline.from_book(F.col("line")).alias("e"))
    assert [r.e for r in df.collect()] == [100, 77, None]


def rows_of(df):
    return sorted(map(str, df.select("device", "started_at", "ended_at", "end_position", "seconds", "measure", "start_counter_ms", "end_counter_ms", "page_turns", "words").collect()))


def test_schema_of_sittings(spark):
    got = stream.sittings(logs.observations(spark.createDataFrame([], "device string, line string")))
    assert got.dtypes == spark.createDataFrame([], stream.SITTING).dtypes


def test_batches_of_files_equal_the_whole_log(spark, tmp_path):
    """Any cut of a log into batches, with a batch that comes late and a clock that stepped back, gives the whole log's sittings."""
    lines = {
        "a": [turn(f"{9 + i // 12:02d}{5 * (i % 12):02d}00", 300_000 * (i + 1), 200_000) for i in range(30) if i not in (13, 14, 15, 16, 17, 18, 19, 20)],
        "b": LOGS["shared gain"] + [turn("235950", 9_000_000, book=OTHER), turn("000040", 9_050_000, 50_000, book=OTHER, day="260312"), turn("000140", 9_110_000, 60_000, book=OTHER, day="260312")],
        "c": LOGS["step back"],
    }
    whole = rows_of(stream.sittings(logs.observations(spark.createDataFrame([(d, x) for d, some in lines.items() for x in some], "device string, line string"))))
    args = [str(tmp_path / x) for x in ("in", "lines", "out", "ck")]
    cuts = [{"a": (0, 9), "b": (0, 4), "c": (0, 2)}, {"a": (14, 30), "b": (4, 10)}, {"a": (7, 14), "b": (10, 20), "c": (2, 4)}]
    for n, batch in enumerate(cuts):
        for device, (lo, hi) in batch.items():
            (tmp_path / "in" / device).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / device / f"f{n}").write_text("\n".join(lines[device][lo:hi]) + "\n")
        stream.run_available(spark, *args)
    assert rows_of(stream.read_sittings(spark, args[2])) == whole


def test_pass_from_a_wake_takes_the_held_counter(spark):
    lines = [wake("231500"), power("231500", True), turn("232500", 1_607_000, 9_000, 8_000, event="CloseBook")]
    rows = logs.observations(spark.createDataFrame([("d", x) for x in lines], "device string, line string"))
    held = spark.createDataFrame([("d", at("231500"), at("232500"), BOOK, 1_303_000, 6_510)], "device string, started_at timestamp_ntz, ended_at timestamp_ntz, end_position long, start_counter_ms long, start_words long")
    (r,) = stream.sittings(rows, held=held).collect()
    assert (r.start_counter_ms, r.seconds, r.measure) == (1_303_000, 304, "counted")
    (r,) = stream.sittings(rows).collect()
    assert r.measure == "timed"
    pages = logs.observations(spark.createDataFrame([("d", x) for x in (wake("231500"), power("231500", True), page("231510"), page("231610"), page("231710"))], "device string, line string"))
    (r,) = stream.sittings(pages, held=held).collect()
    assert (r.end_position, r.started_at, r.measure, r.seconds) == (BOOK, at("231500"), "paged", 120)


def sitting(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], "device string, started_at timestamp_ntz, ended_at timestamp_ntz, end_position long, seconds long, content_key string, progress double")


def test_an_open_that_no_line_takes_is_named_by_its_counter(sits):
    a = sits["counter names"][-1]
    assert (a.started_at, a.ended_at, a.end_position, a.paged_seconds) == (at("221500"), at("222330"), BOOK, 300)
    assert (a.start_counter_ms, a.end_counter_ms, a.seconds, a.measure) == (604_250, 1_010_000, 405, "counted")
    alone = sits["counter names, alone"][-1]
    assert (alone.started_at, alone.seconds, alone.measure, alone.end_position) == (at("221500"), 300, "paged", BOOK)
    for name in ("counter names none", "counter names two", "counter named by then"):
        assert all(r.started_at < at("221500") for r in sits[name]), name


def test_counters_before_the_cut_name_and_begin_sittings(spark):
    lines = [opens("221500", "TimeRead:604 sec."), page("221503"), page("221603"), page("221950"), opens("230000", "null"), wake("231500"), power("231500", True), turn("232500", 1_607_000, 9_000, 8_000, book=OTHER, event="CloseBook")]
    rows = logs.observations(spark.createDataFrame([("d", x) for x in lines], "device string, line string"))
    counters = spark.createDataFrame([("d", BOOK, 604_250, 2_400, at("090000")), ("d", OTHER, 1_303_000, 6_510, at("090000")), ("e", OTHER, 604_000, 1, at("090000"))], "device string, position long, total_ms long, words long, ts timestamp_ntz")
    a, b = sorted(stream.sittings(rows, counters=counters).collect(), key=lambda r: r.started_at)
    assert (a.end_position, a.measure, a.seconds) == (BOOK, "paged", 180)
    assert (b.start_counter_ms, b.seconds, b.measure, b.start_words) == (1_303_000, 304, "counted", 6_510)
    assert [r.end_position for r in stream.sittings(rows).collect()] == [OTHER]


def test_gains_count_where_the_device_was_awake(sits):
    (r,) = sits["held across a sleep"]
    assert (r.measure, [tuple(h) for h in r.hours], r.seconds) == ("paged", [(10, 32), (11, 88)], 120)


def test_amounts_over_spans(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(4000), 6))
        a, b = sorted((rng.randrange(4000), rng.randrange(4000)))
        rows.append((i, [{"a": x, "b": y} for x, y in zip(cuts[::2], cuts[1::2])], a, b, rng.randrange(1, 9000)))
    df = spark.createDataFrame(rows, "i int, s array<struct<a:long,b:long>>, a long, b long, ms long")
    got = {r.i: [tuple(p) for p in r.p if p.ms] for r in df.select("i", intervals.shared_over(F.col("s"), F.col("a"), F.col("b"), F.col("ms")).alias("p")).collect()}
    for i, spans, a, b, ms in rows:
        parts = [(max(x["a"], a), min(x["b"], b)) for x in spans if min(x["b"], b) > max(x["a"], a)]
        total = sum(y - x for x, y in parts)
        want = [(x, y, ms * (y - x) // total) for x, y in parts]
        want = [*want, (parts[0][0], parts[0][0], ms - sum(w[2] for w in want))] if parts else [(a, b, ms)]
        assert got[i] == [w for w in want if w[2]]


def test_heal_rebuild_and_merge(spark):
    held = sitting(spark, (at("100000"), at("101000"), 1, 100, "K", 0.5), (at("110010"), at("111000"), 1, 50, None, None), (at("120000"), at("121000"), 2, 9, None, 0.1), (at("130000"), at("131000"), 3, 5, None, None))
    whole = sitting(spark, (at("100000"), at("100900"), 1, 120, None, 0.6), (at("110000"), at("111000"), 1, 60, None, None), (at("130000"), at("131000"), 3, 5, None, None), (at("140000"), at("141000"), 4, 7, None, None))
    got = {r.started_at: r for r in late.heal(held, whole).collect()}
    r = got[at("100000")]
    assert (r.ended_at, r.seconds, r.content_key, r.progress, r.change) == (at("101000"), 120, "K", 0.6, "healed")
    assert [(got[t].seconds, got[t].change) for t in (at("110000"), at("120000"), at("130000"), at("140000"))] == [(60, "healed"), (9, "same"), (5, "same"), (7, "added")]
    got = sorted((r.started_at, r.ended_at, r.end_position, r.seconds) for r in late.rebuild(held, whole).collect())
    assert got == [(at("100000"), at("101000"), 1, 100), (at("110000"), at("111000"), 1, 60), (at("120000"), at("121000"), 2, 9), (at("130000"), at("131000"), 3, 5), (at("140000"), at("141000"), 4, 7)]
    got = sorted((r.started_at, r.seconds, r.content_key) for r in late.merge_sittings(held, sitting(spark, (at("100500"), at("101000"), 1, 1, "Z", 0.9), (at("115900"), at("121000"), 2, 10, "Y", None))).collect())
    assert got == [(at("100000"), 100, "K"), (at("110010"), 50, None), (at("115900"), 10, "Y"), (at("130000"), 5, None)]


def test_clock_that_steps_back_takes_the_watermark(spark):
    state = spark.createDataFrame([("a", at("100000"), at("090000"), 7200), ("b", at("100000"), None, 7200), ("c", at("100000"), at("090000"), None), ("e", None, None, 3600)], "device string, watermark timestamp_ntz, reset_at timestamp_ntz, clock_offset long")
    clocks = spark.createDataFrame([("a", 3600), ("b", 7170), ("c", 3600), ("x", 1)], "device string, offset long")
    got = {r.device: tuple(r)[1:] for r in late.follow_clock(state, clocks).collect()}
    assert got == {"a": (at("090000"), at("080000"), 3600, 3600), "b": (at("100000"), None, 7170, 0), "c": (at("100000"), at("090000"), 3600, 0), "e": (None, None, 3600, 0)}


def test_next_pass_starts_where_the_chain_over_midnight_does(spark):
    held = sitting(spark, (at("230000"), at("235959"), 1, 9, None, None), (at("000000", 12), at("001000", 12), 1, 9, None, None), (at("100000"), at("101000"), 2, 9, None, None))
    mark = lambda t, day: spark.createDataFrame([("d", at(t, day)), ("n", at(t, day))], "device string, watermark timestamp_ntz")
    cut = lambda t, day: {r.device: r.cut for r in stream.resume_at(held, mark(t, day)).collect()}
    assert cut("002000", 12) == {"d": at("230000"), "n": None} and cut("050000", 12)["d"] == at("050000", 12)


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    lines = [(f"d{i}", turn(f"10{m:02d}00", m * 40_000)) for i in range(12) for m in range(6)]
    for i in range(0, 12, 3):  # chapters, opens that name a book, and power lines: every table that lines meet
        lines += [(f"d{i}", x) for x in LOGS["chapter"] + LOGS["counter names"]]
    rows = logs.observations(spark.createDataFrame(lines, "device string, line string"))
    whole = sorted(map(str, stream.sittings(rows).collect()))
    monkeypatch.setattr(stream, "LINES_A_TASK", 30)
    n = -(-len(lines) // 30)
    assert n > 4 and stream.read_rows(rows).rdd.getNumPartitions() == n
    assert sorted(map(str, stream.sittings(rows).collect())) == whole
