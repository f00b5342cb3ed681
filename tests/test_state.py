"""Manifests, change sets and alias graphs against plain versions."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from readspan.functions.languages import language_names
from readspan.operators import aliases, changes
from readspan.sources import manifest


def test_passes_read_what_changed(spark, tmp_path):
    folder, cache = tmp_path / "docs", str(tmp_path / "cache")
    folder.mkdir()
    write = lambda name, text: (folder / name).write_text(text)
    for i in range(5):
        write(f"{i}.yjr" if i < 2 else f"{i}.yjf", f"text {i}")
    opened = []

    def decode(contents):
        rows = contents.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
        opened.append(rows.count())
        return rows

    def passed():
        rows, report = manifest.refresh(spark, [str(folder)], cache, decode)
        r = report.first()
        return {os.path.basename(x.file): x.text for x in rows.collect()}, (r.n_files, r.n_read, r.n_kept, r.n_gone, r.moved)

    first, report = passed()
    assert report == (5, 5, 0, 0, True) and first["3.yjf"] == "text 3" and opened == [5]
    before = spark.createDataFrame(manifest.survey(spark, [str(folder)]).collect(), "path string, size long, modified timestamp")
    stamp = manifest.stamps(before).first()
    assert passed() == (first, (5, 0, 5, 0, False)) and opened == [5], "a second pass reads no file"
    write("3.yjf", "changed")
    os.utime(folder / "3.yjf", (time.time() + 9, time.time() + 9))
    second, report = passed()
    assert report == (5, 1, 4, 0, True) and opened == [5, 1] and second == {**first, "3.yjf": "changed"}
    now = manifest.survey(spark, [str(folder)])
    after = manifest.stamps(now).first()
    assert after.stamp != stamp.stamp and after.seldom_stamp == stamp.seldom_stamp
    gates = spark.createDataFrame([(stamp.seldom_stamp,), ("other",), (None,)], "gate string")
    assert [r.s for r in gates.select(manifest.skips(F.col("gate"), manifest.stamps(now)).alias("s")).collect()] == [True, False, False]
    os.remove(folder / "0.yjr")
    write("9.yjr", "new")
    assert {os.path.basename(r.path): r.what for r in manifest.compared(manifest.survey(spark, [str(folder)]), before).collect()} == {"0.yjr": "gone", "1.yjr": "kept", "2.yjf": "kept", "3.yjf": "changed", "4.yjf": "kept", "9.yjr": "added"}
    third, report = passed()
    assert report == (5, 1, 4, 1, True) and set(third) == {"1.yjr", "2.yjf", "3.yjf", "4.yjf", "9.yjr"} and opened == [5, 1, 1]
    assert manifest.rows_of(spark, cache).count() == 5


def test_changes_apply_and_reverse(spark):
    rng = random.Random(3)
    draw = lambda: {(rng.choice([None, 1, 2, 3]), i): (rng.choice(["a", "b", None]), rng.choice([None, 1.5])) for i in range(12) if rng.random() < 0.8}
    frame = lambda rows: spark.createDataFrame([(*k, *v) for k, v in rows.items()], "k int, n int, s string, x double")
    show = lambda df: sorted(map(str, df.select("k", "n", "s", "x").collect()))
    for _ in range(3):
        old, new = draw(), draw()
        found = changes.diff(frame(old), frame(new), ["k", "n"])
        assert {(r.k, r.n): r.what for r in found.collect()} == {k: "added" if k not in old else "gone" if k not in new else "changed" for k in {*old, *new} if old.get(k) != new.get(k) or (k in old) != (k in new)}
        assert show(changes.apply(frame(old), found, ["k", "n"])) == show(frame(new)) and show(changes.undo(frame(new), found, ["k", "n"])) == show(frame(old))
        assert show(changes.apply(changes.apply(frame(old), found, ["k", "n"]), found, ["k", "n"])) == show(frame(new))
        n = {w: sum(r.what == w for r in found.collect()) for w in ("added", "changed", "gone")}
        assert changes.report(found).first().asDict() == {**n, "moved": any(n.values())}
        assert {(r.k, r.n, r.field) for r in changes.fields_changed(found, ["k", "n"]).collect()} == {(*k, f) for k in old if k in new for i, f in enumerate("sx") if old[k][i] != new[k][i]}
    assert changes.report(changes.diff(frame(old), frame(old), ["k", "n"])).first().moved is False


def test_restore_and_latest(spark):
    row = "k int, text string, edited int, own boolean"
    held = spark.createDataFrame([(1, "held", 5, False), (2, "mine", 9, True), (3, "mine too", 1, True)], row)
    backups = spark.createDataFrame([("t1", 1, "old", 1, False), ("t1", 7, "oldest", 1, False), ("t2", 1, "backup", 1, False), ("t2", 2, "was", 3, True), ("t2", 3, "later", 4, True), ("t2", 4, "only", 1, False)], f"stamp string, {row}")
    show = lambda df: sorted((r.k, r.text) for r in df.collect())
    assert show(changes.restored(held, backups.where("stamp = 't2'").drop("stamp"), ["k"])) == [(1, "held"), (2, "mine"), (3, "mine too"), (4, "only")]
    assert show(changes.restored(held, backups.where("stamp = 't2'").drop("stamp"), ["k"], "edited")) == [(1, "held"), (2, "mine"), (3, "later"), (4, "only")]
    now = changes.latest(held, backups, ["k"], "stamp", F.col("own"), "edited")
    assert show(now) == [(1, "backup"), (2, "mine"), (3, "later"), (4, "only")]
    assert [r.stamp for r in changes.superseded(backups, now.unionByName(backups.where("stamp = 't1'").drop("stamp")), "stamp").collect()] == ["t1"]


LINK, HELD = "field string, type string, first string, names array<string>, edited timestamp_ntz", "book int, field string, type string, name string"


def test_names_meet_through_links_and_codes(spark):
    at = lambda s: dt.datetime(2026, 3, 1, 0, 0, s)
    links = spark.createDataFrame([
        ("type", "", "mood", ["Stimmung"], at(0)), ("tag", "mood", "calm", ["ruhig", "still"], at(1)), ("author", "", "A. One", ["One, A"], at(1)), ("author", "", "A. One", None, at(2)),
        ("publisher", "", "X", ["Y"], at(1)), ("publisher", "", "Z", ["y"], at(2)), ("type", "", "language", ["tongue"], at(3)), ("tag", "language", "English", ["Deutsch"], at(3)),
    ], LINK)
    held = spark.createDataFrame([
        (1, "tag", "mood", "calm"), (2, "tag", "Stimmung", "Ruhig"), (3, "tag", "Stimmung", "ruhig"), (4, "tag", "Stimmung", "ruhig"), (5, "tag", "other", "calm"), (1, "author", "", "A. One"), (2, "author", "", "One, A"),
        (1, "publisher", "", "X"), (1, "publisher", "", "Y"), (2, "publisher", "", "Z"), (1, "tag", "language", "English"), (2, "tag", "言語", "英語"), (3, "tag", "language", "English"), (3, "tag", "Sprache", "de"), (4, "tag", "tongue", "English"), (6, "tag", "language", "Quenya"),
    ], HELD)
    dictionary = language_names(spark)
    values, classes = aliases.values(links, held, dictionary)
    pairs = [
        (("tag", "mood", "calm"), ("tag", "Stimmung", "ruhig"), True), (("tag", "mood", "calm"), ("tag", "other", "calm"), False), (("tag", "mood", "CALM"), ("tag", "stimmung", "still"), True), (("author", "", "A. One"), ("author", "", "One, A"), False),
        (("publisher", "", "y"), ("publisher", "", "Z"), True), (("publisher", "", "X"), ("publisher", "", "Y"), False), (("tag", "language", "English"), ("tag", "言語", "英語"), True), (("tag", "Sprache", "Englisch"), ("tag", "language", "English"), True),
        (("tag", "language", "English"), ("tag", "language", "Deutsch"), False), (("tag", "language", "Deutsch"), ("tag", "Sprache", "de"), True), (("tag", "tongue", "English"), ("tag", "language", "English"), False), (("tag", "none", "a"), ("tag", "none", "A"), True), (("tag", "none", "a"), ("author", "", "a"), False),
    ]
    name = "struct<field:string,type:string,name:string>"
    asked = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], f"id int, a {name}, b {name}")
    assert {r.id: r.same for r in aliases.same(asked, values, classes, dictionary).collect()} == {i: same for i, (*_, same) in enumerate(pairs)}
    asked = spark.createDataFrame([("tag", "mood", "still"), ("tag", "言語", "英語"), ("tag", "x", "new"), ("publisher", "", "Z")], "field string, type string, name string")
    got = {r.name: (r.shown, r.every, r.also) for r in aliases.others(asked, values, classes, dictionary).collect()}
    assert got == {"still": ("ruhig", ["ruhig", "Ruhig", "calm", "still"], ["Ruhig", "calm"]), "英語": ("English", ["English", "英語"], ["英語"]), "new": ("new", ["new"], []), "Z": ("Z", ["Y", "Z", "y"], ["Y"])}
    assert {r.name: r.linked for r in values.where("field = 'tag' and kind <> 'other'").collect()} == {"calm": True, "Ruhig": True, "ruhig": True, "still": True, "English": False, "英語": False, "de": False, "Quenya": False}
