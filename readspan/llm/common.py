"""Helpers that several operators share: checkpoints, joins on hot keys, word hashes and components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space ends a word; every other byte belongs to one.
SPACES = b" \t\n\r\x0b\x0c"
#: Bytes of text that one numpy pass works on, so that a task's memory doesn't depend on its batches.
SLICE_BYTES = 1 << 20


def use_checkpoints(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only a local session that has none (as in tests) takes a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that a lost executor costs no recomputation: the rows of ``df`` with its partitions and their order."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, for loops and small results.

    A checkpoint keeps Spark's estimates of sizes, which multiply at every join until a loop's numbers fill the driver's
    memory; a table has its own size. Rows keep no order.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then the memory it is done with goes back to the system, as Python workers outlive their tasks."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


#: Ids (8 bytes each) up to which dropped rows are broadcast rather than joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't in the one column of ``dropped``; rows with a null id stay."""
    dropped = cut(dropped.toDF("__dropped").distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, docs[id_col].cast("long") == dropped["__dropped"], "left_anti")


# ---------------------------------------------------------------- hashes of words, on the bytes of Arrow columns


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # ASCII capitals
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BYTE = seeded(256, 11)[_FOLD]
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


class Words:
    """The words of a run of texts: ``hash``, ``doc`` (index of the text), ``start`` and ``end`` (byte offsets in the text), ``count`` (words a text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        base = int(offsets[0])
        data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
        inside = ~_IS_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = offsets[:-1][np.diff(offsets) > 0]
            first[begins] = inside[begins]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        length = end - start
        if len(start):
            at = np.cumsum(length) - length
            place = (np.arange(int(length.sum())) - np.repeat(at, length)) & 0xFFFF
            self.hash = mix(np.add.reduceat(_BYTE[data[inside]] * _POWER[place], at) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.doc = np.searchsorted(offsets, start, "right") - 1
        self.start, self.end = start - offsets[self.doc], end - offsets[self.doc]
        self.count = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` words in a row and the text of each. A text of fewer words has one: all its words."""
        factor = seeded(k, 23) | np.uint64(1)
        n = len(self.hash)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total[: max(n - j, 0)] += self.hash[j:] * factor[j]
        whole = np.zeros(n, bool)
        if n >= k:
            whole[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        short = self.first[:-1][(self.count > 0) & (self.count < k)]
        for i in short:  # at most k words each
            words = self.hash[i : self.first[self.doc[i] + 1]]
            total[i] = (words * factor[: len(words)]).sum() + np.uint64(len(words))
        whole[short] = True
        return mix(total[whole]), self.doc[whole]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Rows ``lo`` to ``hi`` and their words, about SLICE_BYTES of text at a time (a longer text by itself)."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, Words(data, offsets[lo : hi + 1])
        lo = hi


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node that it is linked with.

    Each round gives every node its smallest neighbour as parent, follows parents to their roots and contracts
    the graph to the roots. Stars, as the operators make them, end after one or two rounds. Only counts reach
    the driver; each round is written to the checkpoint folder. Null ends, loops and repeated edges are allowed.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
        while True:
            up = parents.select(F.col("node").alias("p"), F.col("p").alias("g"))
            step = stored(parents.join(up, "p").select("node", "p", "g"))
            moved = step.where("p <> g").limit(1).count()
            parents = step.select("node", F.col("g").alias("p"))
            if not moved:
                break
        if labels is None:
            labels = parents.select("node", F.col("p").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), "p")
            labels = stored(labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        ends = parents.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        edges = edges.join(ends, "a").select("pa", "b")
        ends = parents.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = stored(edges.join(ends, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
