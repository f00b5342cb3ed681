"""Log lines, sittings, clippings and records on small cases."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from readspan.functions import logline, scores, text
from readspan.operators import breakdown, intervals
from readspan.sources import clippings, logs, records
from readspan.streaming import sittings as stream

HEAD = "cvm[6144]: I ReadingTimerController:Information::NextPage,Verdict:Processed,PageStartPos:YJPosition: AfQ:54205,IntervalTime:39890,IntervalWords:320,"


def turn(at, ms, words, end=148207, chapter=56499):
    return f"{at} {HEAD}TotalTime:{ms},TotalWords:{words},EndPos:YJPosition: Abc:{end},%Left:0.645,NextTOCEntryPosition:YJPosition: AT4:{chapter},EndPos:YJPosition: AT4:{chapter},PosLeft:2;"


def page(at, start, words):
    return f'{at} fast[1]: SchemaName[ereader_book_consume_content], Fields[{{ "start_position" : {start}, "end_position" : {start + 9}, "words_count" : {words} }}]'


def parsed(spark, lines, device="d"):
    return logs.observations(spark.createDataFrame([(device, x) for x in lines], "device string, line string"))


def test_page_line(spark):
    r = parsed(spark, [turn("260807:101501", 7390020, 49583)]).first()
    assert (r.ts, r.family, r.position, r.chapters, r.total_ms, r.words, r.interval_ms, r.interval_words, r.page_turn) == (dt.datetime(2026, 8, 7, 10, 15, 1), "timer", 148207, [56499], 7390020, 49583, 39890, 320, True)
    assert r.left_share == 0.645


def test_html_position_and_odd_lines(spark):
    lines = ["260230:101501 x ReadingTimerController", "not a line", "260906:192401 java[1]: I ReadingTimerController:Information::OpenBook,StoredBookData:TimeRead:9,229 sec. x;"]
    df = parsed(spark, lines).withColumn("opened", logline.opened_at(F.col("line")))
    got = {r.line: r for r in df.collect()}
    assert got[lines[0]].ts is None and got[lines[1]].family is None and got[lines[2]].opened == 9_229_000


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('x SchemaName[ereader_book_page_turn], "action_id" : "PrevPage"', "back"),
        ('x SchemaName[ereader_book_linear_page_actions], "action_id" : "NextPageTap"', "forward"),
        ("x SchemaName[ereader_close_book]", "close"),
        (page("260807:101501", 3227, 217), "page"),
    ],
)
def test_metrics(spark, line, want):
    assert parsed(spark, [line]).first().metric.kind == want


def test_power(spark):
    lines = ['SchemaName[ereader_powerd_state_change] "curr_state" : "ACTIVE", "prev_state" : "READY"', 'SchemaName[ereader_powerd_state_change] "curr_state" : "READY", "prev_state" : "ACTIVE"', logline.POWER_ON, logline.POWER_OFF[1]]
    assert [r.power for r in parsed(spark, lines).collect()] == ["active", "idle", "active", "idle"]


def test_two_turns_count_the_counter(spark):
    (r,) = stream.sittings(parsed(spark, [turn("260807:101501", 7390020, 49583), turn("260807:101543", 7431463, 49877)])).collect()
    assert (r.seconds, r.end_position, r.page_turns, r.words, r.measure) == (41, 148207, 2, 294, "counted")
    assert (r.started_at, r.ended_at) == (dt.datetime(2026, 8, 7, 10, 15, 1), dt.datetime(2026, 8, 7, 10, 15, 43))


def test_sittings_break(spark):
    lines = [
        turn("260807:100000", 1000, 1), turn("260807:100100", 61000, 9), turn("260807:103101", 70000, 10), turn("260807:103201", 90000, 10),
        turn("260807:103301", 5000, 1, 777), turn("260807:103401", 9000, 5, 777), turn("260807:235959", 100000, 1), turn("260808:000001", 150000, 2), turn("260808:000101", 160000, 2),
    ]
    got = [(r.end_position, r.seconds) for r in stream.sittings(parsed(spark, lines)).orderBy("started_at").collect()]
    assert got == [(148207, 60), (148207, 20), (777, 4), (148207, 25), (148207, 35)]  # the counter's 50 s over midnight are shared


def test_pages_stand_in_for_the_counter(spark):
    lines = [turn("260807:100000", 1000, 1), page("260807:100001", 10, 100), page("260807:100031", 20, 50), page("260807:100032", 20, 50), page("260807:100532", 30, 7), turn("260807:100533", 1000, 1)]
    (r,) = stream.sittings(parsed(spark, lines)).collect()
    # 30 + under the floor + the cap; a page drawn again leaves its words to the next; the last turn's interval comes before that
    assert (r.paged_seconds, r.paged_words, r.seconds, r.measure) == (150, 150, 39, "timed")


def test_incremental_equals_whole(spark):
    lines = [turn(f"2608{7 + i // 40:02d}:{10 + i % 40 // 4:02d}{15 * (i % 4):02d}00", 1000 * 50 * i, i) for i in range(80)]
    whole = stream.sittings(parsed(spark, lines))
    held = stream.sittings(parsed(spark, lines[:47]))
    mark = spark.createDataFrame([("d", lines[46][:13])], "device string, s string").select("device", logline.stamp(F.col("s")).alias("watermark"))
    again = stream.absorb(held, parsed(spark, lines), stream.resume_at(held, mark))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in/d1").mkdir(parents=True)
    (tmp_path / "in/d1/a").write_text(turn("260807:101501", 7390020, 49583) + "\nnoise\n")
    args = [str(tmp_path / x) for x in ("in", "lines", "out", "ck")]
    stream.run_available(spark, *args)
    (tmp_path / "in/d1/b").write_text(turn("260807:101543", 7431463, 49877) + "\n" + turn("260807:101501", 7390020, 49583) + "\n")
    stream.run_available(spark, *args)
    (r,) = spark.read.parquet(f"{args[2]}/version=1").collect()
    assert (r.device, r.seconds, r.page_turns) == ("d1", 41, 2)


def test_log_files_are_pruned_by_name(spark, tmp_path):
    for name, at in (("messages_1_20260801000000.gz", "260801:000000"), ("messages_2_20260807000000.gz", "260807:000000"), ("messages_3_20260809000000.gz", "260809:000000")):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(turn(at, 1, 1) + "\n")
    (tmp_path / "messages").write_text(turn("260810:000000", 1, 1) + "\nnone\n")
    got = {r.path.rsplit("/", 1)[1] for r in logs.read_lines(spark, [str(tmp_path)], "260807:120000").collect()}
    assert got == {"messages_3_20260809000000.gz", "messages"}
    assert logs.read_lines(spark, [str(tmp_path)]).count() == 4


def test_clippings(spark, tmp_path):
    first = "﻿Title (One) (Author, A. (B))\r\n- Your Highlight on page xii | Location 3227-3240 | Added on Wednesday, June 24, 2026 10:15:01 PM\r\n\r\nbody\r\nmore\r\n==========\r\n"
    second = "Alone\r\n- Ihr Lesezeichen bei Location 7 | Added on 24 June 2026 22:15:01\r\n\r\n\r\n==========\r\nshort\r\n==========\r\n"
    (tmp_path / "c.txt").write_text(first + second + "unfinished")
    rows = clippings.parse_blocks(clippings.read_blocks(spark, [str(tmp_path / "c.txt")])).collect()
    a, b = sorted(rows, key=lambda r: r.title, reverse=True)
    at = dt.datetime(2026, 6, 24, 22, 15, 1)
    assert (a.title, a.author, a.kind, a.page, a.start, a.end, a.at, a.body) == ("Title (One)", "Author, A. (B)", "highlight", "xii", 3227, 3240, at, "body\nmore")
    assert (b.title, b.author, b.kind, b.start, b.end, b.at, b.body) == ("Alone", "", "bookmark", 7, 7, at, "")


def test_records(spark):
    lines = spark.createDataFrame([("c\t7\tk\\tx\t2026-01-02T03:04:05\tmore",), ("c\tbad",), ("z\t1",), ("end\t3",)], "value string")
    got = records.decode(lines, "c").collect()
    assert [(r.extent, r.key, r["at"]) for r in got] == [(7, "k\tx", dt.datetime(2026, 1, 2, 3, 4, 5)), (None, None, None)]
    assert records.whole(lines).first().whole
    assert not records.whole(lines.limit(3)).first().whole
    assert [tuple(x) for x in spark.range(1).select(records.hours(F.lit("7:30;x;23:1")).alias("h")).first().h] == [(7, 30), (23, 1)]


def test_shares_of_a_known_case(spark):
    rows = spark.createDataFrame([(0, 232), (1, 156), (2, 65), (3, 42), (4, 61)], "i int, n long")
    assert [r.share for r in intervals.largest_remainder(rows, [], "n", ["i"]).orderBy("i").collect()] == [42, 28, 12, 7, 11]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.folded(F.lit(" ＡＢ  時間の記録 "))) == "ab 时间の记录"
    assert one(text.authors(F.lit("Doe, Jane & 山田太郎& King,  Jr."))) == ["Jane Doe", "山田太郎", "King, Jr."]
    assert one(text.unescaped(F.lit("a\\\\tb\\t\\q"))) == "a\\tb\t\\q"
    assert one(text.unpadded(F.lit("***Name"))) == "Name" and one(text.unpadded(F.lit("**Name"))) == "**Name"
    assert one(scores.duration(F.lit(8520))) == "2h 22m" and one(scores.duration(F.lit(20))) == "<1m"


def test_alias_classes(spark):
    links = spark.createDataFrame([("B", "C"), ("A", "b "), ("x", "Y")], "a string, b string")
    got = {r.name: r["class"] for r in breakdown.alias_classes(links, "a", "b").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
