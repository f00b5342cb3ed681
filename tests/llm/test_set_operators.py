"""Dedup, sharding, packing, toxicity and the pipeline against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readspan.llm import common, exact_dedup, minhash, packing, queries, sharding, substring_dedup, toxicity
from tests.llm.brute import FIXTURE, grams, near_classes, words

DOCS = "doc_id long, text string, keep_id string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b}
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent if x in got} and {x for x in parent if x not in got} <= loops
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    long = "x" * 30_000
    rows = [(5, "a"), (3, "a"), (9, None), (8, ""), (1, "b"), (2, long), (4, long), (7, long + "y"), (1, "b"), (6, "A")] + [(100 + i, "hot") for i in range(300)]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_duplicates(frame(spark, rows), keep=keep).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [i for i, t in rows if (t or "") in {x or "" for j, x in rows if j == r.doc_id}]
            assert (r.keep_id, r.group_size, r.kept) == (pick(same), len(same), r.doc_id == pick(same))
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in left) == [1, 1, 2, 3, 6, 7, 8, 100] and left[0].keep_id == "clash"


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    ids = common.seeded(300, 1)
    a, b = rng.exponential(2, 300), rng.exponential(2, 300)
    b[:150] = a[:150]
    k = 2000
    sig = minhash.dart_signatures(np.concatenate([ids, ids]), np.repeat([0, 1], 300), 3, k, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()
    one = minhash.dart_signatures(ids[:40], np.zeros(40, int), 1, 64)
    twice = minhash.dart_signatures(np.concatenate([ids[:40], ids[:7]]), np.zeros(47, int), 1, 64, np.ones(47))
    assert one.shape == (1, 64) and twice.shape == (1, 64)


def test_dart_signatures_do_not_depend_on_the_slice():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (3, 9, 12, 20, 40, 90)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(20, 900))) for _ in range(250)]

    def signed(some, weighted=False):
        ((lo, hi, words),) = common.slices(pa.array(some))
        hashes, owner = words.shingles(minhash.WORDS)
        weights = (hashes % np.uint64(7)).astype(np.float64) + 0.3 if weighted else None
        return minhash.dart_signatures(hashes, owner, hi - lo, 125, weights)

    together, weighted = signed(texts), signed(texts, True)
    for i in range(8):
        assert (signed([texts[i]])[0] == together[i]).all() and (signed([texts[i]], True)[0] == weighted[i]).all()
        assert (signed([texts[i], texts[i + 1]])[0] == together[i]).all()


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 8]))) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One  two"), (205, "one"), (206, rows[0][1]), (206, rows[0][1]), (207, "z" * 20_000)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = near_classes(dict(rows))
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_the_fixture(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    assert {r.doc_id: r.class_id for r in queries.op5_minhash_near_dedup(spark, FIXTURE).collect()} == near_classes(texts)


def test_substring_dedup(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = fresh(60), []
    for i in range(12):
        rows.append((i, " ".join(fresh(rng.randrange(90)) + passage + fresh(rng.randrange(90)))))
    clean = [(50 + i, "  " + "\n".join(fresh(70)) + " ") for i in range(10)] + [(70, None), (71, ""), (72, "short"), (73, " ".join(fresh(40) * 3))]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows + clean)).collect()}
    assert len(got) == len(rows + clean) and got[0].keep_id == "clash"
    for i, t in clean:
        assert got[i].text == t and got[i].n_spans == 0
    joined = " ".join(passage)
    assert got[0].text == rows[0][1]
    for i, t in rows[1:]:
        before, after = t.split(joined)
        assert got[i].text == before.rstrip(" ") + after and 0 <= got[i].class_ids[0] < i


def test_spanning_links_what_all_links_join():
    rng = np.random.default_rng(4)
    for n, m, p in ((1, 1, 1), (30, 40, 0.03), (64, 5, 0.2), (20, 20, 0.9), (3, 3, 0)):
        near = rng.random((n, m)) < p

        def classes(rows, columns):
            up = list(range(n + m))
            for i, j in zip(rows, columns, strict=True):
                a, b = up[i], up[n + j]
                up = [min(a, b) if x in (a, b) else x for x in up]
            return up

        rows, columns = minhash.spanning(near.copy())
        assert len(rows) <= max(0, n + m - 1) and near[rows, columns].all() and classes(rows, columns) == classes(*np.nonzero(near))


def test_near_contents_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    fresh = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    n, texts = substring_dedup.PARAGRAPH, {}
    for cluster in range(6):  # more clusters in one key than a few rounds of leaders reach
        base = fresh(n)
        for _ in range(3):
            texts[len(texts)] = [*fresh(1), *base[1:]] if rng.random() < 0.7 else [*base[:-1], *fresh(1)]
    a = fresh(n)
    b, c = [*fresh(1), *a[1:]], [*a[:-2], *fresh(2)]
    chain = [a, [*fresh(2), *a[2:]], c, b]
    for w in chain:
        texts[len(texts)] = w
    for _ in range(90):
        texts[len(texts)] = fresh(n)
    sets = {i: {tuple(w[k : k + 5]) for k in range(n - 4)} for i, w in texts.items()}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, t string")
    keepers = spark.createDataFrame([(i, i, 0) for i in texts], "content long, id long, pos int")

    def classes(pairs):
        up = {i: i for i in texts}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            x, y = sorted((find(x), find(y)))
            up[y] = x
        return {i: find(i) for i in texts}

    monkeypatch.setattr(substring_dedup, "LARGE", 100)
    for last in (22, 80, len(texts)):  # a small key, a middling one and a large one
        members = spark.createDataFrame([(7, i) for i in range(last)], "key long, content long")
        links = [tuple(r) for r in substring_dedup.near_contents(members, keepers, docs, 0.8).collect()]
        want = [(x, y) for x in range(last) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
        assert want and classes(links) == classes(want) and {tuple(sorted(p, reverse=True)) for p in links} <= set(want)


def test_paragraphs_at_the_threshold_share_a_band():
    rng = random.Random(10)
    fresh = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    n, keys = substring_dedup.PARAGRAPH, {}
    for i in range(400):
        base = fresh(60)
        for side, text in enumerate((base, [*base[:21], *fresh(39)], [*fresh(2), *base[2:23], *fresh(37)])):
            ((_, _, words),) = common.slices(pa.array([" ".join(text)]))
            starts = substring_dedup.paragraphs(words)
            for p, k in zip(starts[1], starts[2], strict=True):
                w = text[p : p + n]
                keys[i, side, int(p)] = {tuple(w[j : j + 5]) for j in range(n - 4)}, set(k.tolist()) - {0}
    near = met = 0
    for (i, side, _), (a, ka) in keys.items():
        if side:
            for (j, other, _), (b, kb) in [(q, keys[q]) for q in keys_of(keys, i, 0)]:
                if len(a & b) >= 0.8 * len(a | b):
                    near, met = near + 1, met + bool(ka & kb)
    assert near > 20 and met == near


def keys_of(keys, i, side):
    return [(i, side, p) for p in range(60) if (i, side, p) in keys]


def test_shared_bands_over_batches(spark):
    """Near contents of different documents meet under a key, whatever the batches and however a large key is divided."""
    rng = random.Random(12)
    base = [f"s{rng.randrange(10**7)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 3, 6, 9, 30])).split())) for i in range(60)] + [(50, " ".join(["one two three four five six seven"] * 12))]
    docs, keys_of_content, sets, docs_of = spark.createDataFrame(rows, "id long, t string"), {}, {}, {}
    for i, t in rows:
        ((_, _, words),) = common.slices(pa.array([t]))
        _, pos, keys, content, _ = substring_dedup.paragraphs(words)
        w = t.split()
        for p, k, c in zip(pos, keys.view(np.int64), content.view(np.int64), strict=True):
            own = w[p : p + substring_dedup.PARAGRAPH]
            sets[int(c)] = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
            keys_of_content[int(c)] = set(k.tolist()) - {0}
            docs_of.setdefault(int(c), set()).add(i)
    near = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and keys_of_content[a] & keys_of_content[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and min(docs_of[a]) != min(docs_of[b])
    ]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, large in (("1", 1024), ("2", 3), ("7", 2), (before, 1024), (before, 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            members: dict[int, set[int]] = {}
            for r in substring_dedup.shared_bands(docs, large).collect():
                members.setdefault(r.key, set()).add(r.content)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        met = {tuple(sorted((a, b))) for group in members.values() for a in group for b in group if a != b}
        assert len(near) > 50 and not [p for p in near if p not in met]
        if large > 1000:
            assert all(any(k in keys_of_content[c] for c in group) for k, group in members.items())


def test_substring_dedup_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = lambda i: " ".join(f"o{i}x{j}" for j in range(40))
    rows = [(1, other(1) + " " + passage), (2, passage + " " + other(2)), (2, passage + " " + other(2)), (None, passage), (3, "w" * 500_000 + " " + passage), (4, " ".join(f"l{j}" for j in range(200_000)))]
    got = sorted((r.doc_id or 0, len(r.text), r.n_spans) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(0, len(passage), 0), (1, len(rows[0][1]), 0), (2, len(other(2)) + 1, 1), (2, len(other(2)) + 1, 1), (3, 500_000, 1), (4, len(rows[5][1]), 0)])
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="class_ids"):
        substring_dedup.remove_repeats(frame(spark, rows).withColumn("class_ids", F.lit(1)))


def test_substring_dedup_of_the_fixture(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.text for r in queries.op10_substring_dedup(spark, FIXTURE).collect()}
    assert not [g for g, ids in grams(got, 51).items() if len(ids) > 1]
    shared = set().union(set(), *(ids for ids in grams(texts, substring_dedup.PARAGRAPH).values() if len(ids) > 1))
    assert all(got[i] == texts[i] for i in texts if i not in shared)
    assert all(sum(1 for _ in words(got[i])) <= len(words(texts[i])) for i in texts)


def test_sharding(spark):
    rows = [(i, "t" * (i % 7)) for i in range(1003)] + [(5, "same"), (5, "same"), (2000, None)]
    got = sharding.shard_rows(frame(spark, rows), 8).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    again = sharding.shard_rows(frame(spark, list(reversed(rows))), 8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sharding.shard_rows(frame(spark, []), 8).count() == 0


def test_communication_matrix(monkeypatch):
    counts = [5, 0, 17, 400, 3]
    m = sharding.communication_matrix(counts, 8, 1)
    assert m.sum(1).tolist() == counts and max(m.sum(0)) - min(m.sum(0)) <= 1
    mean = np.mean([sharding.communication_matrix([40, 40], 4, s)[0] for s in range(400)], 0)
    assert abs(mean - 10).max() < 0.5
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 410)
    m = sharding.communication_matrix(counts, 8, 1)
    assert m.sum(1).tolist() == counts and max(m.sum(0)) - min(m.sum(0)) <= 1


def test_word_ids_equal_the_tokenizer():
    path = queries.tokenizer_path("word_bpe_49k.json")
    known, rng = packing.WordIds(path), np.random.default_rng(2)
    texts = ["", "It's they'll ''s 'S", "²³¼ 12ab", "ÀÉÎ ß K", "İstanbul", "é é", "Σας ΣΑΣ", "x\u0085y\xa0z\x1c", "日本語 テスト", "<|endoftext|> x", "\x00\x01a", "\U0001f389a"]
    texts += ["".join(map(chr, rng.choice([*range(32, 127), *range(0xA0, 0x190)], 50))) for _ in range(200)]
    texts += pq.read_table(f"{FIXTURE}/documents.parquet")["text"].to_pylist()[:60]
    for text in texts:
        assert np.frombuffer(known.ids(text), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.choice([1, 2, 3, 7, 30, 31, 64, 64])) for i in range(700)] + [(1000 + i, 0, 33) for i in range(300)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "id long, piece int, length long"), 64).collect()
    assert sorted((r.id, r.piece, r.length) for r in got) == sorted(rows)
    n = check_packed(got, 64)
    over = sum(x > 32 for _, _, x in rows)
    assert n <= max(over, -(-sum(x for _, _, x in rows) // 64)) * 1.05 + 1
    assert packing.best_fit_pack(spark.createDataFrame([], "id long, piece int, length long"), 64).count() == 0


def test_packing_of_documents(spark):
    rows = [(1, None), (2, ""), (3, "one two " * 5000), (4, "tie"), (5, "tie"), (5, "tie")]
    got = packing.pack_documents(frame(spark, rows), queries.tokenizer_path("word_bpe_49k.json")).collect()
    check_packed(got, 4096)
    lengths = {}
    for r in got:
        lengths.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert lengths[1] == lengths[2] == [(0, 0, 1)] and sorted(lengths[3]) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1809)] and len(lengths[5]) == 2


def test_packing_query(spark):
    """The query's pieces against the tokenizer itself, and how many sequences it takes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    got = queries.op9_best_fit_packing(spark, FIXTURE).collect()
    want, total = set(), 0
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert check_packed(got, 4096) <= -(-total // 4096) * 1.02 + 1


def test_packing_edge_cases(spark):
    rows = [(2**53 + 1, "one"), (None, "two"), (7, None)]
    got = {r.doc_id for r in packing.pack_documents(frame(spark, rows), queries.tokenizer_path("word_bpe_49k.json")).collect()}
    assert got == {2**53 + 1, None, 7}
    pieces = spark.createDataFrame([(1, 0, 3, "x")], "id long, piece int, length long, `range` string")
    assert packing.best_fit_pack(pieces, 8).first()["range"] == "x"
    with pytest.raises(ValueError, match="offset"):
        packing.best_fit_pack(pieces.withColumn("offset", F.lit(1)), 8)
    with pytest.raises(ValueError, match="length 9"):
        packing.best_fit_pack(pieces.withColumn("length", F.lit(9).cast("long")), 8)


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    got = queries.op7_sharding(spark, FIXTURE).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items()} and len(got) == len(texts)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    # a uniform shuffle: neighbours by id aren't neighbours in a shard
    order = {r.doc_id: (r.shard, r.slot) for r in got}
    close = sum(order[i][0] == order[i + 1][0] and abs(order[i][1] - order[i + 1][1]) == 1 for i in order if i + 1 in order)
    assert close < len(order) * 0.05


def test_sharding_spreads_null_ids(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(1, None), (1, None)]
    got = sharding.shard_rows(frame(spark, rows), 8).collect()
    assert len(got) == 402 and sorted(len([r for r in got if r.shard == s]) for s in range(8)) == [50] * 6 + [51] * 2


def test_exact_dedup_of_null_ids(spark):
    rows = [(2**53 + 1, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "c")]
    for keep in ("largest", "smallest"):
        got = sorted((r.text_sha256, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, rows), keep=keep).collect())
        assert {(d, k, n, kept) for _, d, k, n, kept in got} == {(2**53 + 1, 2**53 + 1, 2, True), (0, 2**53 + 1, 2, False), (0, None, 2, True), (3, 3, 1, True)}


def test_toxicity_score_columns(spark):
    model = toxicity.train([], np.zeros(0, int), toxicity.Settings())
    with pytest.raises(ValueError, match="score"):
        toxicity.score(frame(spark, [(1, "a")]).withColumn("Score", F.lit(1)), model)
    assert toxicity.score(frame(spark, [(1, "a")]), model, score_col="s2").first().s2 == pytest.approx(1 / 3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = [(i, None if i % 7 == 0 else f"w{i % 2}") for i in range(40)] + [(1, "w1"), (3, "z" * 200_000), (None, "q")]
    model = toxicity.fit(frame(spark, rows), labels, toxicity.Settings(least_docs=1))
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark, rows), model).collect())


def test_no_module_defines_a_name_twice():
    import ast
    import pathlib

    for path in pathlib.Path("readspan").rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path


def test_pipeline_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "", "", 0), (900_003, " one two ", "en", "s", 9), (900_004, " one two ", None, "s", 9)], empty.schema)
    for docs, left in ((empty, 0), (odd, 2)):
        for name, stage in corpus_pipeline.STAGES:
            path = common.folder(spark, f"test-{name}")
            stage(spark, docs, FIXTURE).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == left


def test_toxicity_finds_unseen_spellings(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join("".join(rng.choice("aeioultnrs") for _ in range(5)) for _ in range(n))
    rows = [(i, plain(30) + (" " + rng.choice(["horridness", "vilething"]) * (i % 2)), i % 2) for i in range(400)]
    s = toxicity.Settings(least_docs=2, epochs=15)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]), s)
    tests = [plain(30) for _ in range(40)], [plain(30) + " " + rng.choice(["horridnes", "horrridness", "vilethingz"]) for _ in range(40)]
    clean, toxic = (model.score(t, {}) for t in tests)
    assert (clean < 0.5).mean() > 0.9 and (toxic >= 0.5).mean() > 0.8
    docs = frame(spark, [(1, None), (2, ""), (3, tests[1][0]), (3, tests[1][0]), (4, "!" * 30_000)])
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert all(0 <= x <= 1 for _, x in got) and got[0][1] == got[1][1] == got[4][1] and got[2][1] == got[3][1]


def test_toxicity_without_both_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, [(1, "a"), (2, "b")]), labels)
    assert all(0 < r.score < 1 for r in toxicity.score(frame(spark, [(1, "a")]), model).collect())
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["toxic"]).mean() > 0.95


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{FIXTURE}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = common.folder(spark, f"test-{name}")
        stage(spark, docs, FIXTURE).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.count()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            assert len(set(texts.values())) == len(texts)
        if name == "minhash_near_dedup":
            assert all(i == c for i, c in near_classes(texts).items())
        if name == "substring_dedup":
            assert not [g for g, ids in grams(texts, 51).items() if len(ids) > 1]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert docs.select("doc_id").distinct().count() == seen["substring_dedup"]
    check_packed(docs.collect(), 4096)
