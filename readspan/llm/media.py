"""Media columns: payloads stored once by digest, and HTML read into interleaved text and media references."""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import folder, freed

#: Samples in a row of a stored image.
WIDTH = 576
_ITEMS = "id long, position int, kind string, text string, digest string, caption string"
_FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


# ---------------------------------------------------------------- the stored form: 8-bit grey PNG, lossless


def padded(data: bytes, width: int = WIDTH, fill: int = 255) -> bytes:
    """``data`` and fill bytes up to a positive multiple of ``width``."""
    return data + bytes([fill]) * (-len(data) % width if data else width)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """One sample a byte, rows of ``width`` samples without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; raises if a chunk is damaged."""
    at, body, size = 8, [], (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and share of samples over 127, to four places."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};high={float(p[128:].sum()):.4f}"


# ---------------------------------------------------------------- the media table


def store_media(rows: DataFrame, digest_col: str, data_col: str) -> DataFrame:
    """Write ``(digest, n_bytes, media)`` to the shared folder and return that table.

    A task stores a digest once; equal payloads of several tasks are stored by each, with the same bytes. Null
    data counts as empty.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for digest, text in zip(batch["digest"][at : at + 256], batch["data"][at : at + 256], strict=True):
                    key = bytes.fromhex(digest)
                    if key not in seen:
                        seen.add(key)
                        data = text.encode("utf-8")
                        out.append((digest, len(data), to_png(padded(data))))
                if out:
                    yield pd.DataFrame(out, columns=["digest", "n_bytes", "media"])

    path = folder(rows.sparkSession, "media")
    picked = rows.select(F.col(digest_col).alias("digest"), F.coalesce(F.col(data_col), F.lit("")).alias("data"))
    picked.mapInPandas(encode, "digest string, n_bytes long, media binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back: one row a digest with sizes, hashes and features of its payload."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, n, stored in zip(batch["digest"], batch["n_bytes"], batch["media"], strict=True):
                payload = from_png(stored)
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FEATURES.split(", ")])

    return media.mapInPandas(decode, _FEATURES).dropDuplicates(["digest"])


# ---------------------------------------------------------------- interleaved sequences

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|([^<]+|<)", re.S | re.I)
_SRC, _ALT = re.compile(r"\bsrc\s*=\s*[\"']?digest:([0-9a-f]{64})", re.I), re.compile(r"\balt\s*=\s*[\"']([^\"']*)", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code em i kbd mark q s samp small span strong sub sup u var".split())


def parse_items(page: str) -> list[tuple[str, str, str, str]]:
    """Ordered (kind, text, digest, caption): text blocks and references ``src="digest:…"``.

    A figure's caption is its ``figcaption``, else the image's ``alt``; caption text is no text block.
    """
    items: list[list[str]] = []
    block: list[str] = []
    in_figure, caption, in_caption = -1, [], False

    def close() -> None:
        text = " ".join(entities.unescape("".join(block)).split())
        block.clear()
        if text:
            items.append(["text", text, "", ""])

    for m in _TOKEN.finditer(page):
        tag = (m[3] or "").lower()
        if m[5] is not None:
            (caption if in_caption else block).append(m[5])
        elif tag == "img":
            close()
            if src := _SRC.search(m[4] or ""):
                alt = _ALT.search(m[4] or "")
                items.append(["media", "", src[1].lower(), entities.unescape(alt[1]) if alt else ""])
        elif tag == "figcaption":
            in_caption = not m[2]
            if m[2] and in_figure >= 0:
                said = " ".join(entities.unescape("".join(caption)).split())
                for item in items[in_figure:]:
                    if item[0] == "media" and said:
                        item[3] = said
            caption = []
        elif tag == "figure":
            close()
            in_figure = -1 if m[2] else len(items)
        elif tag and tag not in _INLINE:
            close()
    close()
    return [tuple(x) for x in items]


def page_items(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row an item of each page; ids of any kind, null ones too, go along as they are. Null html counts as empty and gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, k, *item) for i, page in enumerate(batch.column("html").to_pylist()) for k, item in enumerate(parse_items(page))]
            if out:
                of, position, *said = zip(*out, strict=True)
                columns = [batch.column("id").take(pa.array(of)), pa.array(position, pa.int32()), *(pa.array(c, pa.string()) for c in said)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "position", "kind", "text", "digest", "caption"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(freed(run), _ITEMS)


def interleave(items: DataFrame, media: DataFrame) -> DataFrame:
    """``(id, items)``: each page's items in order, media items with the columns of ``media`` that their digest names.

    The join shuffles both sides by a key of its own, so that AQE can split a digest that very many pages name.
    A digest without a row in ``media`` leaves those columns null; position and caption stay as they are.
    """
    columns = [c for c in media.columns if c != "digest"]
    left = items.withColumn("k", F.xxhash64("digest", F.lit("media")))
    right = media.select(F.xxhash64("digest", F.lit("media")).alias("k2"), F.col("digest").alias("d2"), F.struct(*columns).alias("media"))
    joined = left.join(right, (left.k == right.k2) & (left.digest == right.d2), "left")
    item = F.struct("position", "kind", "text", "digest", "caption", "media")
    return joined.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("items"))
