"""Source divergence, prefix tries and mixing against their SQL on tables with edge cases, and against plain counts."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readspan.llm import divergence, minhash, mixing, ordered, prefix_trie, queries
from tests.llm.brute import FIXTURE, near_classes

NEW = ["op11_source_divergence", "op12_prefix_trie", "op13_source_mixing"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string, size string, rank string"
TURNS = "conv_id long, turn long, role string, text string, depth string, k1 int"


def shown(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("~" if r[i] is None else f"{r[i]:.12g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def same_as_sql(con, name, df):
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = df.collect()
    assert shown(df.columns, map(tuple, rows)) == shown(columns, want.fetchall())
    return rows


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{FIXTURE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, con, name):
    assert len(same_as_sql(con, name, queries.QUERIES[name](spark, FIXTURE))) > 20


def documents():
    rng = random.Random(1)
    words = ["alpha", "Beta", "beta", "gamma7delta", "éclair", "Éclair", "zür-ich", "x\u00a0y", "ÀB", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "Z", "é", None, ""])) for i in range(90)]
    rows += [(200 + i, "hot alpha words " * (i % 3 + 1), "en", "hot") for i in range(150)]
    rows += [(None, "no id at all", "en", "a"), (None, "no id at all", "en", "a"), (None, None, None, None), (7, None, "en", "only"), (7, "alpha beta", "en", "a"), (7, "alpha beta", "en", "a"), (500, "word " * 5000, "de", "big"), (501, "", "fr", "x"), (502, "once only here", "fr", "y"), (503, "ÀÀÀ" * 4000, "en", "b")]
    return [(*r, 0, "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    con = duckdb.connect()
    rows = documents()
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")]).astype({"doc_id": "Int64"})  # noqa: F841  read by its name
    con.execute("create table documents as select doc_id, text, lang, source from frame")
    return spark.createDataFrame(rows, DOCS).repartition(5), con


def test_divergence_of_odd_rows(spark, odd, monkeypatch):
    docs, con = odd
    rows = same_as_sql(con, NEW[0], divergence.source_divergence(docs))
    assert {r.value for r in rows if r.lang == "fr"} == {0} and {r.part for r in rows if r.lang == "fr"} == {"pair"}
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    again = divergence.source_divergence(docs, broadcast_rows=0)  # summed up in parts, joined by a shuffle
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_of_a_plain_count(spark):
    rows = [(1, "a b a", "en", "s"), (2, "a b", "en", "s"), (3, "A c", "en", "t"), (4, "b c d", "en", "t"), (5, "c", "en", "u")]
    got = divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = ["a", "b", "c"]
    count = {s: Counter(w for _, t, _, x in rows if x == s for w in t.lower().split() if w in kept) for s in "stu"}
    whole = sum(count.values(), Counter())
    p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + 3)
    gap = lambda a, b: (a - b) ** 2 // b
    for s in "stu":
        pairs = sorted(((-sum(gap(p(count[s], w), p(count[o], w)) for w in kept), o) for o in "stu" if o != s))
        assert [(r.item, r.value, r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if (r.source, r.part) == (s, "pair")] == [(o, -v, i) for i, (v, o) in enumerate(pairs, 1)]
        terms = sorted((-gap(p(count[s], w), p(whole, w)), w) for w in kept if count[s][w] and p(count[s], w) > p(whole, w))
        assert [(r.item, r.value) for r in sorted(got, key=lambda r: r["rank"]) if (r.source, r.part) == (s, "term")] == [(w, -v) for v, w in terms]


def test_mix_of_odd_rows(spark, odd):
    docs, con = odd
    rows = same_as_sql(con, NEW[2], mixing.mix(docs))
    assert len(rows) == len(documents()) and sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, rows))
    sources = sorted({r[3] for r in documents()}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: total(documents(), s) for s in sources}
    weight, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, dict.fromkeys(sources), {}
    budget = 1.5 * sum(size.values())
    while left:
        share = budget / sum(weight[s] for s in left)
        full = [s for s in left if 2 * size[s] < share * weight[s]]
        if not full:
            target |= {s: share * weight[s] for s in left}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            budget -= target[s]
            del left[s]
    by_size = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_size[r.source_size, round(r.target, 6)] = by_size.get((r.source_size, round(r.target, 6)), 0) + r.taken
    assert sorted(by_size) == sorted({(size[s], round(target[s], 6)) for s in sources})
    for (_, want), got in by_size.items():
        n = sum(round(target[s], 6) == want for s in sources)
        assert abs(got / n - want) <= 1 + want / mixing.PARTS * 2
    assert sum(r.taken for r in rows) == int(1.5 * sum(size.values()))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text is null")).where("taken = 0 and target = 0").count() == 2


def words_of(text):
    return len((text or "").replace("\u00a0", "x").split())


def total(rows, source):
    return sum(words_of(r[1]) for r in rows if r[3] == source)


def test_copies_of_one_row_are_served_one_by_one(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s")] * 5000 + [(1, "d e", "en", "t")] * 3, "doc_id long, text string, lang string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5003 and {r.taken for r in rows if r.doc_id is None} <= {0, 3, 4, 5, 6, 1, 2} and sum(r.taken for r in rows) == int(1.5 * 15006)


def plain_trie(turns):
    """{conv ids by path: figures} by brute force."""
    by = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            by.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    by = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in by.items()}
    whole = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(by.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(whole[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below), sum(leaf(p) for p in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(70):
        n = rng.randrange(0, 12)
        rows += [(c, t if t else rng.choice([0, None]), rng.choice(["user", None]) if t % 2 else "assistant", rng.choice(["hot", "é", "", None, "b" * 40]) if t < 2 else rng.choice("xyz")) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(6)]  # copies
    rows += [(2001, t, "user", "long chain" if t < 30 else str(t)) for t in range(120)]
    rows += [(None, 0, "user", "of no conversation"), (3, 50, None, None), (5000, 0, "user", "w" * 50_000)]
    return rows


def test_trie_equals_plain_paths(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(4)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for limit in (None, 3, 40):  # undivided, and divided turn by turn
        got = sorted((tuple(r[c] for c in columns) for r in prefix_trie.family_trie(turns, limit=limit).collect()), key=str)
        assert got == plain_trie(rows), limit
    assert prefix_trie.family_trie(turns.limit(0)).count() == 0
    (root,) = prefix_trie.family_trie(turns.where("conv_id = 5000 or conv_id is null").limit(1).withColumn("conv_id", F.lit(5003).cast("long"))).where("depth = 0").collect()
    assert (root.conv_id, root.n_convs) == (5003, 1)


def test_running_sums_go_on_over_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.randrange(-(1 << 62), 1 << 62)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.running(df, [F.col("k"), F.col("i")], ["v"], ["k"]).collect()
        whole = ordered.running(df, [F.col("i")], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for rows_of, key in ((got, lambda r: r.k), (whole, lambda r: 0)):
        seen = {}
        for r in sorted(rows_of, key=lambda r: r.i):
            at = seen.get(key(r), 0)
            seen[key(r)] = ordered.wrapped(at + r.v)
            assert (r.v_before, r.v_upto) == (at, seen[key(r)])


def test_near_duplicates_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (None, text), (None, "alone here"), (None, "alone here"), (3, text + " more"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (3, 1, False), (None, None, True)], key=str)


def test_mixed_buckets_in_many_blocks(spark, monkeypatch):
    """Clusters around one text that none of them is near: their buckets hold many labels, which meet block by block."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"v{rng.randrange(10**6)}"
        return out

    rows = [(0, " ".join(base))]
    for c in range(40):
        middle = changed(base, 3)
        rows += [(1 + 5 * c + k, " ".join(changed(middle, k % 2))) for k in range(5)]
    seen = []
    blocks = minhash.linked_in_blocks

    def counted(rest, held, least):
        seen.append(rest.groupBy("key").count().where("count > 8").count())
        return blocks(rest, held, least)

    monkeypatch.setattr(minhash, "linked_in_blocks", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == near_classes(dict(rows)) and seen[0] > 0
