"""Sidecars, zones and lanes on small cases."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from readspan.operators import lanes, zones
from readspan.sources import records, sidecar


def text(s):
    raw = s.encode()
    return b"\0" + struct.pack(">H", len(raw)) + raw


def timer(ms, words, covered):
    values = b"\1" + struct.pack(">i", 7) + b"\2" + struct.pack(">q", ms) + b"\2" + struct.pack(">q", words) + b"\4" + struct.pack(">d", covered)
    body = b"\xfe" + text("timer.model") + values + b"\xff"
    return sidecar.SIGNATURE + b"\2" + struct.pack(">q", 1) + b"\1" + struct.pack(">i", 1) + body


def test_sidecars(spark, tmp_path):
    (tmp_path / "good").write_bytes(timer(7390020, 49583, 0.25))
    (tmp_path / "cut").write_bytes(timer(1, 2, 3)[:-4])
    (tmp_path / "long").write_bytes(timer(1, 2, 3) + b"x")
    values = sidecar.read_sidecars(spark, [str(tmp_path)]).cache()
    (r,) = sidecar.counters(values).collect()
    assert (r.file.rsplit("/", 1)[1], r.total_ms, r.words, r.covered) == ("good", 7390020, 49583, 0.25)
    assert values.where("path = 'error'").count() == 2
    with pytest.raises(ValueError):
        sidecar.decode(b"nothing")


def zone_file():
    kinds = [(3600, 0, 0), (7200, 1, 4)]
    changes, index = [1_000_000, 2_000_000, 3_000_000], bytes([1, 0, 1])
    counts = struct.pack(">6I", 0, 0, 0, len(changes), len(kinds), 8)
    info = b"".join(struct.pack(">iBB", *k) for k in kinds) + b"CET\0CST\0"
    part = lambda f: b"TZif2" + b"\0" * 15 + counts + struct.pack(f">3{f}", *changes) + index + info
    return part("i") + part("q") + b"\nCET-1CEST\n"


def test_zones(spark, tmp_path):
    (tmp_path / "z").write_bytes(zone_file())
    zone = zones.read_tzif(spark, str(tmp_path / "z"))
    rows = spark.createDataFrame([(0,), (1_000_000,), (1_999_999,), (2_000_000,), (4_000_000,)], "at long")
    got = {r["at"]: (r.offset_s, r.local) for r in zones.localised(rows, zone, "at").collect()}
    assert [got[k][0] for k in sorted(got)] == [3600, 7200, 7200, 3600, 7200]
    assert got[0][1] == dt.datetime(1970, 1, 1, 1)
    assert zones.rle(zone.where("since is not null"), "since", "offset_s").count() == 3
    assert spark.range(1).select(zones.offset_text(F.lit(-5400)).alias("x")).first().x == "-01:30"


def test_lanes(spark):
    day = lambda n: dt.date(2026, 6, n)
    rows = [(1, day(1), "a", 10), (1, day(2), "a", 10), (1, day(2), "b", 99), (1, day(3), "b", 1), (1, day(4), "a", 5), (1, day(3), "c", 50)]
    got = {(r.book, r.first_day.day): (r.last_day.day, r.lane) for r in lanes.lanes(spark.createDataFrame(rows, "week int, day date, book string, seconds int")).collect()}
    assert got == {("a", 1): (2, 0), ("b", 2): (3, 1), ("c", 3): (3, 0), ("a", 4): (4, 0)}


def place(anchor):
    return b"\3" + text(anchor)


def annotation(kind, start, created, sixth):
    fields = place(f"x:{start}") + place(f"x:{start + 9}") + b"\2" + struct.pack(">q", created) + b"\2" + struct.pack(">q", created) + place("0") + place(sixth)
    return b"\xfe" + text(f"annotation.personal.{kind}") + fields + b"\xff"


def cache(*annotations):
    tree = b"\xfe" + text("saved.avl.interval.tree") + b"\1" + struct.pack(">i", len(annotations)) + b"".join(annotations) + b"\xff"
    body = b"\xfe" + text("annotation.cache.object") + (b"\1" + struct.pack(">i", 1) + b"\1" + struct.pack(">i", 1) + tree if annotations else b"") + b"\xff"
    return sidecar.SIGNATURE + b"\2" + struct.pack(">q", 1) + b"\1" + struct.pack(">i", 1) + body


def test_annotations(spark, tmp_path):
    (tmp_path / "a").write_bytes(cache(annotation("highlight", 100, 7_000, "yellow"), annotation("note", 50, 8_000, "said"), annotation("sticky_note", 1, 2, "id")))
    (tmp_path / "none").write_bytes(cache())
    (tmp_path / "bad").write_bytes(cache()[:-1])
    values = sidecar.read_sidecars(spark, [str(tmp_path)]).cache()
    got = sorted((r.kind, r.start, r.end, r.created, r.colour, r.body) for r in sidecar.annotations(values).collect())
    assert got == [("highlight", 100, 109, 7000, "yellow", ""), ("note", 50, 59, 8000, "", "said"), ("sticky_note", 1, 10, 2, "", "")]
    assert {r.file.rsplit("/", 1)[1]: r.trusted for r in sidecar.rosters(values).collect()} == {"a": True, "none": True, "bad": False}


def test_sidecar_files_are_chosen_by_name(spark):
    mine, other = "a" * 32, "b" * 32
    names = [f"/d/x.sdr/x{mine}.yjr", f"/d/x.sdr/x{other}.yjr", "/d/x.sdr/x.yjf", f"/d/y.sdr/y{mine}.azw3r", "/d/y.sdr/y.azw3r.bad_file", "/d/z.sdr/z.mbp1", f"/d/z.sdr/z{other}.mbp1", f"/d/w.sdr/w{mine}.tal", "/d/plain/p.yjr"]
    got = {r.folder: (r.often, r.seldom) for r in sidecar.files(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"/d/x.sdr": ("/d/x.sdr/x.yjf", f"/d/x.sdr/x{mine}.yjr"), "/d/y.sdr": (None, f"/d/y.sdr/y{mine}.azw3r"), "/d/z.sdr": (None, f"/d/z.sdr/z{other}.mbp1"), "/d/w.sdr": (None, f"/d/w.sdr/w{mine}.tal")}


def test_clocks(spark, tmp_path):
    (tmp_path / "z").write_bytes(zone_file())
    zone = zones.read_tzif(spark, str(tmp_path / "z"))
    rows = spark.createDataFrame([(0,), (1_000_000,), (5_000_000,)], "at long")
    assert {r["at"]: r.changes_at for r in zones.next_change(rows, zone, "at").collect()} == {0: 1_000_000, 1_000_000: 2_000_000, 5_000_000: None}
    schema = "d string, epoch long, offset long"
    held = spark.createDataFrame([("a", 10, 3600), ("a", 20, 7200)], schema)
    seen = spark.createDataFrame([("a", 10, 0), ("a", 15, 3600), ("a", 30, 7201), ("a", 40, 3600), ("b", 5, 60)], schema)
    clock = zones.observed(held, seen, ("d",))
    assert sorted(map(tuple, clock.select("d", "epoch", "offset").collect())) == [("a", 10, 3600), ("a", 20, 7200), ("a", 40, 3600), ("b", 5, 60)]
    assert sorted(map(tuple, zones.offsets(clock, ("d",)).select("d", "offset", "first").collect())) == [("a", 3600, 10), ("a", 7200, 20), ("b", 60, 5)]


def test_lanes_of_devices_are_apart(spark):
    day = lambda n: dt.date(2026, 6, n)
    rows = [("x", 1, day(1), "a", 10), ("y", 1, day(1), "b", 99)]
    got = {(r.device, r.book): r.lane for r in lanes.lanes(spark.createDataFrame(rows, "device string, week int, day date, book string, seconds int"), keys=("device",)).collect()}
    assert got == {("x", "a"): 0, ("y", "b"): 0}


def test_record_tags(spark):
    now = dt.datetime(2026, 3, 4, 5, 6, 7)
    note = spark.createDataFrame([(now, now, 5, "k\ty", "live", None, "", "", None, 3, -1, None, "w", "two\nlines")], "written timestamp_ntz, edited timestamp_ntz, extent long, key string, state string, at timestamp_ntz, kind string, title string, location long, start long, `from` long, `to` long, words string, text string")
    line = records.encode(note, "w")
    assert line.first().value == "w\t2026-03-04T05:06:07\t2026-03-04T05:06:07\t5\tk\\ty\tlive\t\t\t\t-1\t3\t-1\t-1\tw\ttwo\\nlines"
    r = records.decode(line, "w").first()
    assert (r.text, r.key, r.location, r.start, r["from"]) == ("two\nlines", "k\ty", None, 3, None)
    lines = spark.createDataFrame([("d\t2026-03-04T05:06:07\tK\t5\ttitle\t\\N\told\\\\N",), ("b\t7\tK\tT\tA\t\t\t99.5\t1\t\t\t0\t\t2\tEBOK\t1\tvocab\t0\t0\t0.0\t20000;x;20001",), ("z\t5\t3600",), ("m\t260304:050607\t",)], "value string")
    d = records.decode(lines, "d").first()
    assert (d.value, d.was) == (None, "old\\N")
    b = records.decode(lines, "b").first()
    assert (b.percent, b.kept, b.identified_by, b.restarted_on) == (99.5, 1, "vocab", [dt.date(2024, 10, 4), dt.date(2024, 10, 5)])
    assert records.decode(lines, "z").first().offset_s == 3600 and records.decode(lines, "m").first().watermark == "260304:050607"
    assert set(records.tables(lines)) == set(records.LAYOUTS) and records.tables(lines)["s"].count() == 0
    assert [tuple(x) for x in spark.range(1).select(records.stretches(F.lit("500-800,x,1000-250")).alias("s")).first().s] == [(0.05, 0.08), (0.1, 0.025)]
