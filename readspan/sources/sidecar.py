"""Reading sidecars: a binary of tagged values, decoded in tasks to rows of path and value."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signature, and the tags of values with their big-endian forms.
SIGNATURE = bytes([0, 0, 0, 0, 0, 0x1A, 0xB1, 0x26])
FORMS = {0: ">?", 1: ">i", 2: ">q", 4: ">d", 5: ">h", 6: ">f", 7: ">b"}
TEXT, CHAR, OBJECT, END = 3, 9, 0xFE, 0xFF


def decode(data: bytes) -> list[tuple[str, str]]:
    """``(path, value)`` of every leaf, paths like ``timer.model[1]``; raises ValueError for anything malformed."""
    if data[:8] != SIGNATURE:
        raise ValueError("no sidecar")
    at, out = 8, []

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("cut short")
        got = struct.unpack_from(form, data, at)
        at += size
        return got

    def text() -> str:
        nonlocal at
        if take(">B")[0]:
            return ""
        (n,) = take(">H")
        raw, at = data[at : at + n], at + n
        if len(raw) < n:
            raise ValueError("cut short")
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def value(path: str) -> None:
        (tag,) = take(">B")
        if tag in FORMS:
            (x,) = take(FORMS[tag])
            out.append((path, str(x).lower() if tag == 0 else str(x)))
        elif tag == TEXT:
            out.append((path, text()))
        elif tag == CHAR:
            out.append((path, chr(take(">H")[0])))
        elif tag == OBJECT:
            nonlocal at
            name, i = text(), 0
            if not path:
                out.append((name, ""))
            while at < len(data) and data[at] != END:
                value(f"{path}.{name}[{i}]".lstrip("."))
                i += 1
            take(">B")
        else:
            raise ValueError(f"unknown tag {tag}")

    if take(">Bq") != (2, 1):
        raise ValueError("unknown version")
    tag, n = take(">Bi")
    if tag != 1:
        raise ValueError("no count")
    for _ in range(n):
        value("")
    if at != len(data):
        raise ValueError("bytes behind the end")
    return out


def decoded(contents: DataFrame) -> DataFrame:
    """``(file, path, value)`` of the sidecars in ``contents`` (path, content); a malformed file gives one row whose path is ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, p, v) for p, v in decode(content)]
                except (ValueError, struct.error, UnicodeError) as e:
                    rows.append((name, "error", str(e)))
            yield pd.DataFrame(rows, columns=["file", "path", "value"])

    return contents.mapInPandas(run, "file string, path string, value string")


def read_sidecars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``decoded`` of all files under ``paths``; ``manifest.refresh`` reads only those that changed."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content"))


def counters(values: DataFrame) -> DataFrame:
    """``(file, total_ms, words, covered)`` as the timer model states them."""
    pick = lambda i: F.max(F.when(F.col("path") == f"timer.model[{i}]", F.col("value")))
    rows = values.groupBy("file").agg(pick(1).try_cast("long").alias("total_ms"), pick(2).try_cast("long").alias("words"), F.coalesce(pick(3).try_cast("double"), F.lit(0.0)).alias("covered"))
    return rows.where("total_ms is not null")


# Endings of the sidecars that are written often and seldom, of superseded and half-written ones; the object of
# annotations; kinds whose last field is a colour or a text.
OFTEN, SELDOM = ("yjf", "azw3f", "mbs", "tas", "pdt"), ("yjr", "azw3r", "mbp1", "tal", "pds")
CACHE = "annotation.cache.object"
COLOURED, WORDED = ("bookmark", "highlight", "underline", "circle", "pin"), ("note",)


def files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(folder, often, seldom)``: of each folder's sidecars the two to read, by name alone.

    A name can hold an infix of 32 hex digits, the profile that wrote it. Of several seldom written ones the profile most
    of all have comes first, then any profile, then the last by name; of several often written ones the last.
    """
    name = F.substring_index(F.col(path), "/", -1)
    ending = F.substring_index(name, ".", -1)
    infix = F.nullif(F.regexp_extract(name, r"([0-9a-f]{32})\.[^.]+$", 1), F.lit(""))
    rows = paths.select(F.col(path).alias("path"), F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder"), ending.alias("ending"), infix.alias("infix")).where(F.col("folder").endswith(".sdr"))
    seldom = rows.where(F.col("ending").isin(*SELDOM))
    profile = seldom.where("infix is not null").groupBy("infix").count().orderBy(F.desc("count"), "infix").limit(1).select(F.col("infix").alias("__p"))
    ranked = seldom.join(F.broadcast(profile), seldom["infix"] == F.col("__p"), "left")  # one row
    rank = F.when(F.col("__p").isNotNull(), 3).when(F.col("infix").isNotNull(), 2).otherwise(1)
    best = ranked.groupBy("folder").agg(F.max(F.struct(rank.alias("r"), "path"))["path"].alias("seldom"))
    often = rows.where(F.col("ending").isin(*OFTEN)).groupBy("folder").agg(F.max("path").alias("often"))
    return often.join(best, "folder", "full")


def place(anchor: Column) -> Column:
    """The number behind an anchor's last colon."""
    return F.substring_index(anchor, ":", -1).try_cast("long")


def annotations(values: DataFrame) -> DataFrame:
    """``(file, no, kind, start, end, created, modified, flags, colour, body)``: the annotations of decoded sidecars, by their place.

    ``start`` and ``end`` are positions, ``created`` and ``modified`` epoch milliseconds on the device's clock. One that
    lacks a field or has one of another type is left out.
    """
    shape = r"^annotation\.cache\.object\[(\d+)\]\.saved\.avl\.interval\.tree\[(\d+)\]\.annotation\.personal\.([a-z_]+)\[(\d)\]$"
    part = lambda i: F.regexp_extract("path", shape, i)
    rows = values.where(F.col("path").rlike(shape)).select("file", (part(1).cast("long") * 1_000_000 + part(2).cast("long")).alias("no"), part(3).alias("kind"), part(4).cast("int").alias("k"), "value")
    field = lambda i: F.max(F.when(F.col("k") == i, F.col("value")))
    found = rows.groupBy("file", "no", "kind").agg(*(field(i).alias(f"f{i}") for i in range(6)))
    last = F.coalesce("f5", F.lit(""))
    out = found.select(
        "file", "no", "kind", place(F.col("f0")).alias("start"), place(F.col("f1")).alias("end"), F.col("f2").try_cast("long").alias("created"), F.col("f3").try_cast("long").alias("modified"),
        F.coalesce("f4", F.lit("")).alias("flags"), F.when(F.col("kind").isin(*COLOURED), last).otherwise("").alias("colour"), F.when(F.col("kind").isin(*WORDED), last).otherwise("").alias("body"), "f0", "f1",
    )
    return out.where("f0 is not null and f1 is not null and created is not null and modified is not null").drop("f0", "f1")


def rosters(values: DataFrame) -> DataFrame:
    """``(file, trusted)``: whether a sidecar could be read and says which annotations exist, if only that there are none."""
    return values.groupBy("file").agg((F.bool_or(F.col("path") == CACHE) & ~F.bool_or(F.col("path") == "error")).alias("trusted"))
