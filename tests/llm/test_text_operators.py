"""Formatting, extraction, the codec and media against plain versions."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from readspan.llm import chat_format, html_extract, media, queries, sentencepiece_codec
from tests.llm.brute import FIXTURE

TURNS = "conv_id long, turn long, role string, text string, note string"


def test_chat_reads_back(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>\n<|im_start|>user\nx", "n"),
        (1, 1, "user", "</s>[INST] a\\ [/INST]<\\/s><|im_next|>", "n"),
        (1, 3, "assistant", None, "n"),
        (1, 4, "assistant", "", "n"),
        (2, 1, None, "only", "n"),
        (2, 1, None, "only", "n"),
        (3, None, "sys<tem\n%0A", "< | [ \\ é\U0001f600", "n"),
        (4, 1, "assistant", "x" * 50_000, "n"),
    ]
    out = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, 4):
        want = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2] or "", r[3] or "") for r in want]
        assert out[conv].loss_text == "".join(r[3] or "" for r in want if r[2] == "assistant")
    assert out[1].formatted.count(chat_format.START) == 2  # three assistant turns are one block


def test_chat_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_query(spark):
    table = pq.read_table(f"{FIXTURE}/conversations.parquet").to_pylist()
    table += [{"conv_id": -1, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, FIXTURE).collect()}
    for conv in {r["conv_id"] for r in table}:
        own = sorted((r for r in table if r["conv_id"] == conv), key=lambda r: r["turn"])
        loss = "".join(r["text"] for r in own if r["role"] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{x['role']}\n{x['text']}\n" for x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_html_query(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{FIXTURE}/pages.parquet").to_pylist()}
    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, FIXTURE).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article))
        assert got[i] == "\n".join(b for b in blocks if b)


def test_html_without_landmarks_uses_repeated_runs(spark):
    head = "<div class=top>Welcome to our site with all the news of the day and more</div>"
    foot = "<div>All rights are reserved by the owners of this very site since 1999</div>"
    body = "<div>Story {0} tells of a matter that no other page of this host has told, number {0}</div>"
    rows = [(i, "http://a.b/x", head + body.format(i) + foot, 1) for i in range(4)]
    rows += [(9, "http://c.d/x", head + body.format(9) + foot, 1), (10, None, None, 1), (11, "http://c.d/", "", 1), (11, "http://c.d/", "", 1)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(4):
        assert got[i] == f"Story {i} tells of a matter that no other page of this host has told, number {i}"
    assert got[9].startswith("Welcome") and got[10] == "" and got[11] == ""


def test_html_marks_and_stray_tags():
    page = (
        "<title>t</title><nav>n</nav><main><header><h1>A &lt;b&gt;</h1></header><p>one<p>two <i>in</i>line<div class='cookie-notice'>c</div></b></section>"
        "<script>if (a</b) x</script><!-- <p>no</p> --><ul><li>x<li>y</ul><div id=comments>bad</div>tail</main><footer>f"
    )
    assert [t for t, s, _ in html_extract.blocks(page) if s == 1] == ["A <b>", "one", "two inline", "x", "y", "tail"]


def test_html_marks_by_class_names():
    shown = lambda page: [t for t, s, _ in html_extract.blocks(page) if s == 1]
    for outer in ("<body class='has-sidebar'>", "<div class='no-sidebar'>", "<div id='content-with-sidebar'>", "<div class=sidebar>", "<div data-role='menu' data-id=ad>", "<body id=header>"):
        assert shown(f"{outer}<article class='post social-share'><p>text</p><div class='share-buttons'>s</div></article>") == ["text"]
    page = "<main><p>story</p><div class='ad-slot'>a</div><span class=sponsored>s</span>end<div class='post has-ads'>kept</div></main><div class='related'><article>other</article></div><ol><article class='comment odd'>c</article></ol>"
    assert shown(page) == ["story", "end", "kept"]
    assert shown("<aside><article>x</article></aside><article>y</article>") == ["y"]


def test_html_empty_table_and_long_page(spark):
    schema = "page_id string, url string, html string"
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "word &amp; " * 300_000 + "</p>" + "<div>" * 3000 + "deep"
    rows = [("a", "http://h/1", long), (None, "http://h/2", "<p>few words"), ("b", "http://h/2", "")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == ("word & " * 300_000).strip() + "\ndeep" and got[None] == "few words" and got["b"] == ""


def test_suffix_windows_against_all_windows():
    rng = np.random.default_rng(3)
    streams = [[str(x) for x in rng.integers(0, 3, n)] for n in (0, 5, 8, 40, 60)]
    stream, place, group = html_extract.suffix_windows(streams)
    seen = {}
    for s, p, g in zip(stream, place, group, strict=True):
        seen.setdefault(tuple(streams[s][p : p + html_extract.RUN]), set()).add(int(g))
    assert len(stream) == sum(max(0, len(s) - html_extract.RUN + 1) for s in streams)
    assert all(len(g) == 1 for g in seen.values()) and len(set().union(*seen.values())) == len(seen)


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_codec_equals_the_library(model):
    codec = sentencepiece_codec.Codec(model)
    rng = np.random.default_rng(1)
    texts = ["", " ", "  a  b ", "日本語テスト 長い", "\x00a\x00", "▁▁x ▁", "é \U0001f389", "a" * 3000, "ab " * 3 + " " * 70 + "z", "x\n\n\ny\t"]
    texts += ["".join(map(chr, rng.choice([32, *range(33, 127), *range(0xA0, 0x500)], 60))) for _ in range(100)]
    texts += pq.read_table(f"{FIXTURE}/documents.parquet")["text"].to_pylist()
    for text, ids, want in zip(texts, codec.encode(texts), codec.model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == codec.model.decode(want)


def test_codec_on_words_of_any_length(model):
    """A word without spaces is indexed in windows; its ids are the library's, and it isn't remembered."""
    codec = sentencepiece_codec.Codec(model)
    rng = np.random.default_rng(5)
    texts = ["ab" * 130_000, "".join(map(chr, rng.choice([*range(97, 123), 0xE9, 0x4E2D], 120_000))), "x " + "z" * 60_001]
    for text, ids, want in zip(texts, codec.encode(texts), codec.model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == text
    assert max(map(len, codec.memo)) < sentencepiece_codec.LONG_WORD


def test_codec_keeps_ids_beside_null_ones(spark, model):
    rows = [(2**53 + 1, "a b"), (None, "c"), (7, None)]
    got = {r.doc_id: (r.decoded, r.n_tokens) for r in sentencepiece_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got.keys() == {2**53 + 1, None, 7} and got[2**53 + 1][0] == "a b" and got[7] == ("", 0)
    assert sentencepiece_codec.encode_decode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_sentencepiece_query(spark, model):
    """The query's columns against the library, text by text."""
    import zlib

    codec = sentencepiece_codec.Codec(model)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    for r in queries.op6_sentencepiece(spark, FIXTURE).collect():
        ids = codec.model.encode(texts[r.doc_id])
        said = codec.model.decode(ids)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_chars, r.decoded_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_codec_operator(spark, model):
    rows = [(1, "one two", "x"), (2, None, "x"), (2, "", None), (3, "one two", "x")]
    got = sorted((r.doc_id, r.n_tokens, r.decoded) for r in sentencepiece_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model).collect())
    assert [(i, d) for i, _, d in got] == [(1, "one two"), (2, ""), (2, ""), (3, "one two")] and got[0][1] == got[3][1] > 0 == got[1][1]


def test_media_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FIXTURE}/documents.parquet").to_pylist()}
    got = queries.op8_media_columns(spark, FIXTURE).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.describe(payload))


def test_media_query_keeps_every_row(spark, tmp_path):
    rows = [(2**53 + 1, "a"), (None, "b"), (None, "b"), (None, None), (7, "c"), (7, "d"), (8, "")]
    spark.createDataFrame([(*r, "clash", b"x") for r in rows], "doc_id long, text string, digest string, media binary").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_media_columns(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.tail_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()), zlib.crc32(media.padded((t or "").encode())[-32:])) for i, t in rows), key=str)


def test_stored_media_is_a_png_to_others(spark, tmp_path):
    payload = media.padded(bytes(range(256)) * 5 + b"text")
    (tmp_path / "x.png").write_bytes(media.to_png(payload))
    image = spark.read.format("image").load(str(tmp_path / "x.png")).select("image.*").first()  # decoded by Java
    data = np.frombuffer(bytes(image.data), np.uint8).reshape(image.height, image.width, image.nChannels)
    flat = data[..., ::-1].tobytes() if image.nChannels == 3 and len(data.tobytes()) == len(payload) else data[..., 0].tobytes()
    assert flat == payload


def test_media_features_by_a_plain_count():
    import math
    import statistics

    data = media.padded(bytes(range(256)) * 3 + b"aab")
    p = [data.count(v) / len(data) for v in range(256)]
    entropy = -sum(x * math.log2(x) for x in p if x)
    want = f"mean={statistics.fmean(data):.4f};std={statistics.pstdev(data):.4f};entropy={entropy:.4f};high={sum(b > 127 for b in data) / len(data):.4f}"
    assert media.describe(data) == want


def test_media_edge_cases(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "text", "x"), (2, "text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    got = {r.n_bytes: r.payload_bytes for r in media.media_features(media.store_media(docs, "digest", "text")).collect()}
    assert got == {0: 576, 4: 576}
    empty = docs.limit(0)
    assert media.media_features(media.store_media(empty, "digest", "text")).count() == 0


def test_interleaved_items(spark):
    digest = hashlib.sha256(b"p").hexdigest()
    page = f"<p>before</p><figure><img src='digest:{digest}' alt=a><figcaption>the <b>cap</b>tion</figcaption></figure>after<img alt='x &amp; y' src=\"digest:{'0' * 64}\"><p>end"
    items = media.page_items(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), "page_id", "html")
    table = spark.createDataFrame([(digest, "payload")], "digest string, kind string")
    rows = media.interleave(items, table).collect()
    assert len(rows) == 1
    shown = [(i.kind, i.text or i.caption, i.media and i.media.kind) for i in rows[0]["items"]]
    assert shown == [("text", "before", None), ("media", "the caption", "payload"), ("text", "after", None), ("media", "x & y", None), ("text", "end", None)]


def test_padding_of_nothing():
    assert media.padded(b"") == b"\xff" * 576 and len(media.padded(b"x" * 576)) == 576
