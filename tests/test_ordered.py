"""Places, pages, free seconds and texts that hold each other against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from readspan.operators import grams, highlights, matching, notes, ordered
from tests.test_highlights import NOTE, ROW

EPOCH = dt.datetime(2026, 3, 1)


def test_places_and_pages(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 2, 2]), "x" * rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, s string").repartition(3)
    order = [F.col("k").desc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted(ordered.placed(df, order).collect(), key=lambda r: r.place)
    assert [(r.id, r.k, r.s) for r in got] == want and [r.place for r in got] == list(range(500))
    assert ordered.placed(df.limit(0), order).count() == 0
    path = str(tmp_path / "listing")
    ordered.keep_listing(df, order, path, 5)
    whole = len(spark.read.parquet(path).inputFiles())
    for no, size in ((0, 7), (3, 50), (9, 50), (10, 50), (0, 1000)):
        page = ordered.page(spark, path, no, size)
        assert [r.id for r in sorted(page.collect(), key=lambda r: r.place)] == [r[0] for r in want[no * size : (no + 1) * size]]
    one = ordered.page(spark, path, 3, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "range#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    read = {r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    assert whole >= 3 and len(read) == 1
    ordered.keep_listing(df.limit(0), order, str(tmp_path / "none"))


def test_free_seconds(spark):
    rng = random.Random(6)
    note = lambda s, text: (EPOCH + dt.timedelta(seconds=s), EPOCH, 5, "K", "live", None, "", "", None, None, None, None, "", text)
    held = [(d, rng.randrange(40)) for d in "ab" for _ in range(25)]
    new = [(d, rng.randrange(-5, 45), f"{d}{i}") for d in "abc" for i in range(30)]
    frame = lambda rows: spark.createDataFrame([(*note(s, t), d) for d, s, t in rows], f"{NOTE}, device string")
    want = []
    for d in "abc":
        taken, last = {s for e, s in held if e == d}, -10
        for s in sorted(s for e, s, _ in new if e == d):
            last = max(s, last + 1)
            while last in taken:
                last += 1
            want.append((d, last))
    both = notes.add_notes(frame([(d, s, "old") for d, s in held]), frame(new))
    got = [(r.device, int((r.written - EPOCH).total_seconds())) for r in both.where("text <> 'old'").collect()]
    assert sorted(got) == sorted(want) and both.count() == len(held) + len(new)
    asked = {t: (d, s) for d, s, t in new}
    assert all((r.device, int((r.written - EPOCH).total_seconds())) >= asked[r.text] and r.edited == r.written for r in both.where("text <> 'old'").collect())


def test_texts_that_hold_each_other(spark):
    rng = random.Random(7)
    bodies = ["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", "a", "long " * 400, "ng long", "x😀y", "😀"]
    rows = [(i, i % 2, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, g int, body string")
    got = {(r.s, r.l) for r in grams.holding(df, df, ["g"]).collect()}
    assert got == {(i, j) for i, g, a in rows for j, h, b in rows if g == h and a and b and a in b}


def test_contained_names_a_text_once(spark):
    texts = spark.range(3).selectExpr("id", "'one two three four five six' as text")
    needles = spark.createDataFrame([("two three four five six",)], "needle string")
    plan = matching.contained(needles, texts, "needle", "text")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate explode")[0].rsplit("\n", 2)[-2]
    assert "xxhash64" not in above, "the whole text is hashed once a row, not once a word"


def _loop(rows):
    """One by one: what ``settled`` gives, without the cut of long words."""
    words = lambda a, b: bool(a) and bool(b) and (a in b or b in a)
    key = lambda v: (v is not None, v)
    rows = sorted(({**r} for r in rows), key=lambda r: [key(r[c]) for c in ("at", "title", "kind", "start", "end", "extent", "state", "location", "page", "colour", "body")])
    out, seats, under = [], {}, {}
    for r in rows:
        group, live = (" ".join(r["title"].lower().split()), r["kind"]), r["state"] == "live"
        seat = (r["extent"], r["kind"], r["start"], r["end"]) if live and r["start"] is not None else None
        held = seats.get(seat) if live else next((m for m in under.get(group, []) if words(m["body"], r["body"])), None)
        if held is None:
            out.append(r)
            r["group"] = group
            under.setdefault(group, []).append(r)
            if seat:
                seats[seat] = r
        elif r["body"] and not (held["state"] == "live" and held["kind"] == "note"):
            held["body"] = r["body"]
    return [r for r in out if r["state"] == "live" or not r["body"] or not any(m["state"] == "live" and words(m["body"], r["body"]) for m in under[r["group"]])]


def test_settled_equals_one_by_one(spark):
    for seed in range(6):
        rng = random.Random(seed)
        base = "".join(rng.choice("abcd ") for _ in range(24))
        rows = []
        for _ in range(70):
            a, b = sorted((rng.randrange(25), rng.randrange(25)))
            body = rng.choice([base[a:b], base[a:b], base[: 3 + a], "other " + base[a:], "", "z" * rng.randrange(3)])
            live = rng.random() < 0.3
            start = rng.choice([None, 1, 2]) if live else None
            rows.append(dict(extent=rng.choice([5, 6]), title=rng.choice(["T", "t ", "U"]), kind=rng.choice(["highlight", "note"]), at=EPOCH + dt.timedelta(seconds=rng.randrange(50)), state="live" if live else rng.choice(["retired", "unconfirmed"]), start=start, end=start, location=None, page="", colour="", body=body))
        names = [c.split()[0] for c in ROW.split(", ")]
        got = highlights.settled(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ROW)).collect()
        show = lambda r: tuple(str(r[c]) for c in ("at", "title", "kind", "state", "start", "extent", "body"))
        assert sorted(map(show, got)) == sorted(map(show, _loop(rows))), seed


def test_settled_spreads_a_large_title(spark):
    rows = spark.range(30_000).selectExpr(
        "0L as extent", "'' as title", "'highlight' as kind", "timestamp_ntz'2026-03-01 00:00:00' + make_dt_interval(0, 0, 0, id) as at", "'unconfirmed' as state", "cast(null as long) as start", "cast(null as long) as end", "cast(null as long) as location", "'' as page", "'' as colour",
        "case when id % 3 = 0 then 'a passage that thousands copied' else concat('words of their own ', sha(string(id div 2 * 2)), if(id % 2 = 1, ' and more', '')) end as body",
    )
    got = highlights.settled(rows)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = 1 + len({i // 2 for i in range(30_000) if i % 3})
    assert got.count() == want


def _unconfirmed(bodies):
    """A row a second of each (title, body)."""
    return [dict(extent=0, title=t, kind="highlight", at=EPOCH + dt.timedelta(seconds=i), state="unconfirmed", start=None, end=None, location=None, page="", colour="", body=b) for i, (t, b) in enumerate(bodies)]


def _settles(spark, rows):
    names = [c.split()[0] for c in ROW.split(", ")]
    show = lambda r: tuple(str(r[c]) for c in ("at", "title", "body"))
    got = highlights.settled(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ROW)).collect()
    return sorted(map(show, got)) == sorted(map(show, _loop(rows)))


def test_settling_rounds_grow_with_what_moves(spark, monkeypatch):
    """300 titles that one round settles beside one of eight links, each of which settles a round after the one before it."""
    word = lambda i: f"{i * 7919 % 1000:03d}-{i}"
    chain = [("chain", word(i // 2) + word(i // 2 + 1) * (i % 2)) for i in range(8)]
    rows = _unconfirmed([(f"t{i}", f"words {i}" + x) for i in range(300) for x in ("", " more", " more still", "")] + chain)
    made, whole = [], highlights.pinned
    monkeypatch.setattr(highlights, "pinned", lambda df: made.append(whole(df)) or made[-1])
    assert _settles(spark, rows)
    asked = [df.count() for df in made if {"no", "by"} <= set(df.columns)]
    assert asked[0] <= 3 * len(rows), "a row meets each text once, not once a level of blocks"
    worked = [df.count() for df in made if "moved" in df.columns]
    assert len(worked) > 3 and worked[0] == len(rows) and worked[-1] == len(chain), "settled titles leave the rounds"


def test_settling_by_rows_and_by_blocks_is_one(spark, monkeypatch):
    rng = random.Random(4)
    rows = _unconfirmed([(rng.choice("TU"), "abcdefgh"[(a := rng.randrange(7)) : a + rng.choice([1, 1, 2, 3])]) for _ in range(80)])
    for few in (0, 4, 1000):  # all texts meet by blocks, some do, none does
        monkeypatch.setattr(highlights, "FEW_ROWS", few)
        assert _settles(spark, rows), few
