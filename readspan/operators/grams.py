"""Which texts hold which: all runs of characters of a text at a cost that goes with its length, met by equality."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.operators.lineage import pinned

#: Characters in a row over which texts meet, the length from which a text's grams leave SPARE of its characters out, and the widest window of grams.
GRAM, SHORT, SPARE, WIDEST = 12, 8, 3, 64
#: Hashes that a task lists at a time.
SLICE = 1 << 16
#: Grams, or groups, up to which they are sent to all tasks, and texts of both sides up to which a group's are compared with each other.
FEW_GRAMS, FEW_TEXTS = 100_000, 128
# An odd factor and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the factor and of its inverse, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, f, np.uint64)))) for f in (_FACTOR, _INVERSE))


def hashes(text: str, size: int, powers: _Powers) -> np.ndarray:
    """A hash of every ``size`` characters in a row of ``text``, from its running sums: one pass, whatever the size."""
    letters = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    n = len(letters)
    if size <= 0 or n < size:
        return np.zeros(0, np.int64)
    powers.upto(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * powers.up[:n])))
    return _mixed((sums[size:] - sums[:-size]) * powers.down[: n - size + 1]).view(np.int64)


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_hashes(text: str, words: int, powers: _Powers) -> np.ndarray:
    """A hash of every ``words`` words in a row of ``text``, whatever white space parts them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.diff(np.concatenate(([False], ~_SPACE[data], [False])).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(start) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    powers.upto(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)])))
    one = _mixed((sums[end] - sums[start]) * powers.down[start])
    row = np.zeros(n, np.uint64)
    for k in range(words):
        row = row * np.uint64(_FACTOR) + one[k : k + n]
    return _mixed(row).view(np.int64)


def _least(of):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        powers = _Powers()
        for texts, sizes in batches:
            yield pd.Series([int(h.min()) if len(h := of(t or "", n, powers)) else None for t, n in zip(texts, sizes, strict=True)], dtype="Int64")

    return F.pandas_udf(run, "bigint").asNondeterministic()


def least_gram(text: Column, size: Column) -> Column:
    """The smallest hash of ``size`` characters in a row of ``text``, which every text that holds it has too; null for shorter ones.

    As a key of a join it isn't worked out again in the filters that Spark infers from one: those stay above it.
    """
    return _least(hashes)(text, size)


def all_grams(text: Column, size: Column, window: Column) -> Column:
    """The hashes of ``size`` characters in a row of ``text`` that are the smallest of some ``window`` of them in a row.

    A text of ``window`` grams or more that ``text`` holds has its smallest among them, as the grams about it stand there too;
    those of a wider window are some of a narrower one's.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        powers = _Powers()
        for texts, sizes, windows in batches:
            yield pd.Series([np.unique(_smallest(hashes(t or "", n, powers), w)) for t, n, w in zip(texts, sizes, windows, strict=True)])

    return F.pandas_udf(run, "array<bigint>").asNondeterministic()(text, size, window)


def _smallest(row: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` numbers in a row."""
    if len(row) < window:
        return row[:0]
    done = 1
    while done < window:
        step = min(done, window - done)
        row = np.minimum(row[:-step], row[step:])
        done += step
    return row


def least_words(text: Column, words: int = 3) -> Column:
    """The smallest hash of ``words`` words in a row of ``text``; null if it has fewer."""
    return _least(word_hashes)(text, F.lit(words))


def listed_words(texts: DataFrame, keys: list[str], text: str, words: int = 3) -> DataFrame:
    """``keys`` of ``texts`` and ``__k``: a row for each different hash of ``words`` words in a row of ``text``.

    Texts are read one by one and their hashes go on SLICE rows at a time, so a task holds one Arrow batch and one text's sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            column, ids, places, found, n = batch.column(len(keys)), batch.select(keys), [], [], 0
            for i in range(len(column)):
                row = np.unique(word_hashes(column[i].as_py() or "", words, powers))
                for lo in range(0, len(row), SLICE):
                    part = row[lo : lo + SLICE]
                    places.append(np.full(len(part), i))
                    found.append(part)
                    n += len(part)
                    if n >= SLICE:
                        yield _rows(ids, places, found)
                        places, found, n = [], [], 0
            if n:
                yield _rows(ids, places, found)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # Python workers outlive their tasks
            trim(0)

    rows = texts.select(*keys, text)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, __k long")


def _rows(ids: pa.RecordBatch, places: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(np.concatenate(places))
    return pa.RecordBatch.from_arrays([c.take(at) for c in ids.columns] + [pa.array(np.concatenate(found))], names=[*ids.schema.names, "__k"])


def holding(short: DataFrame, long: DataFrame, group: list[str]) -> DataFrame:
    """``(s, l)``: ids of texts of ``short`` and those of ``long`` (each: ``group``, id, body) of the same group that hold them, from the middle of a word too. A text holds itself; empty ones hold and are held by none.

    In a group of FEW_TEXTS or fewer, each text of a side meets those of the other: that is less to move than their grams, and no more than
    that number a text. Larger groups meet by grams (``_by_grams``), so no large group's pairs are listed.
    """
    short, long = short.where("body <> ''"), long.where("body <> ''")
    sizes = short.select(*group).unionByName(long.select(*group)).groupBy(*group).count()
    large = pinned(sizes.where(F.col("count") > FEW_TEXTS).select(*group))
    n = large.limit(FEW_GRAMS + 1).count()
    if n == 0:
        return _all_pairs(short, long, group)
    large = F.broadcast(large) if n <= FEW_GRAMS else large
    rest, found = (f(*(side.join(large, group, how) for side in (short, long)), group) for f, how in ((_all_pairs, "left_anti"), (_by_grams, "left_semi")))
    return rest.unionByName(found)


def _all_pairs(short: DataFrame, long: DataFrame, group: list[str]) -> DataFrame:
    """``holding`` by comparing all texts of a group."""
    met = short.select(*group, F.col("id").alias("s"), F.col("body").alias("__s")).join(long.select(*group, F.col("id").alias("l"), F.col("body").alias("__l")), group)
    return met.where(F.col("__l").contains(F.col("__s"))).select("s", "l", "__s", "__l")


def _by_grams(short: DataFrame, long: DataFrame, group: list[str]) -> DataFrame:
    """``holding`` by grams.

    A text is looked for by the one of its grams with the smallest hash, so common beginnings bring none together. Its grams have GRAM
    characters, fewer in a short text, and a text is found by the smallest of each window as long as the least that is looked for:
    of long texts a part of the grams is listed. Only ids and hashes are joined; texts are fetched for what met and compared in
    full. Grams that are looked for are broadcast while they are few, else both sides are shuffled.
    """
    n = F.length("body")
    size = F.when(n < SHORT, n).otherwise(F.least(n - SPARE, F.lit(GRAM)))
    asked = short.withColumn("__n", size).select(*group, F.col("id").alias("s"), "__n", (n - F.col("__n") + 1).alias("__w"), least_gram(F.col("body"), F.col("__n")).alias("__g"))
    sizes = asked.groupBy(*group, "__n").agg(F.least(F.min("__w"), F.lit(WIDEST)).alias("__w"))  # GRAM numbers a group at most
    index = long.join(sizes, group).where(n >= F.col("__n") + F.col("__w") - 1).select(*group, F.col("id").alias("l"), "__n", all_grams(F.col("body"), F.col("__n"), F.col("__w")).alias("__gs"))
    index = index.select(*group, "l", "__n", F.explode("__gs").alias("__g"))
    keys = [*group, "__n", "__g"]
    wanted = pinned(asked.select(*keys).distinct())
    if wanted.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS:
        index = pinned(index.join(F.broadcast(wanted), keys, "left_semi"))
    met = asked.join(index, keys).select("s", "l").distinct()
    met = met.join(short.select(F.col("id").alias("s"), F.col("body").alias("__s")), "s").join(long.select(F.col("id").alias("l"), F.col("body").alias("__l")), "l")
    return met.where(F.col("__l").contains(F.col("__s"))).select("s", "l", "__s", "__l")
