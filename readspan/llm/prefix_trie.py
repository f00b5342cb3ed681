"""Prefix tries over conversations: which openings are shared, by how many, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import cut, freed
from readspan.llm.ordered import changes, running, small

#: Nodes that one task's tries hold about; a subtrie of more is divided by its next turn.
UNIT_NODES = 50_000
#: Below this a subtrie isn't divided, however many tasks there are.
LEAST_NODES = 256
#: Fixed value: the digest of nothing.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_KEY, _PARENT = ["k1", "k2"], ["p1", "p2"]
_SUMMED = "k1 long, k2 long, p1 long, p2 long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, at, digest, bytes)``: every turn's place in its conversation from 0, without its text.

    Turns stand by ``turn``, null first, ties by their digest. Null roles and texts count as empty. Rows without an id are in no
    conversation and are left out. A conversation of any length is spread over ranges.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.md5(said.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = running(rows.withColumn("one", F.lit(1).cast("long")), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")], ["one"], ["conv_id"])
    return rows.select("conv_id", F.col("one_before").alias("at"), "digest", "bytes")


def rebuilt(numbered: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """``numbered`` with each conversation's first turns taken from the first of its family, and ``(conv_id)`` of all conversations.

    Of conversation c the first h turns are those of c - c % ``family`` (all if it has fewer, none if it doesn't exist), with h the
    CRC-32 of c in decimal modulo ``most`` + 1; its own turns after its first h follow.
    """
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = own.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.least(F.col("n"), F.lit(most)).alias("base_n"))
    convs = cut(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")))
    first = numbered.where(F.col("at") < most).withColumnRenamed("conv_id", "base").join(convs, "base").where(F.col("at") < F.col("lent"))
    rest = numbered.join(convs, "conv_id").where(F.col("at") >= F.col("h")).withColumn("at", F.col("lent") + F.col("at") - F.col("h"))
    columns = ["conv_id", "at", "digest", "bytes"]
    return first.select(columns).unionByName(rest.select(columns)), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, at, digest, bytes) with the node each ends at: its key (k1, k2), its parent's (p1, p2) and ``depth``.

    A key is the 128-bit sum of hashes of (place, turn) up to it, so that the key of every prefix is a running sum, which a
    long conversation's ranges work out side by side. The root's key is (0, 0).
    """
    hashed = [F.xxhash64(F.lit(i), "at", "digest").alias(f"x{i}") for i in (1, 2)]
    rows = running(turns.select("conv_id", "at", "bytes", F.lit(1).cast("long").alias("one"), *hashed), [F.col("conv_id"), F.col("at")], ["one", "x1", "x2"], ["conv_id"])
    return rows.select("conv_id", F.col("one_upto").alias("depth"), "bytes", *(F.col(f"x{i}_upto").alias(f"k{i}") for i in (1, 2)), *(F.col(f"x{i}_before").alias(f"p{i}") for i in (1, 2)))


def _tries(nodes: pd.DataFrame) -> pd.DataFrame:
    """The subtries of one part: dictionaries from turn to child, and sums from the leaves up without recursion."""
    at = {k: i for i, k in enumerate(zip(nodes.k1, nodes.k2, strict=True))}
    up = [at.get(k, -1) for k in zip(nodes.p1, nodes.p2, strict=True)]
    children: list[dict[tuple[int, int], int]] = [{} for _ in up]
    tops = []
    for k, i in at.items():
        if up[i] < 0:
            tops.append(i)
        else:
            children[up[i]][k] = i
    conv = nodes.conv_id.tolist()
    saved = ((nodes.n_convs - 1) * nodes.bytes).tolist()
    leaves = [0] * len(up)
    for top in tops:
        stack = [(top, iter(children[top].values()))]
        while stack:
            i, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(children[child].values())))
                continue
            stack.pop()
            leaves[i] = leaves[i] or 1
            if stack:
                leaves[up[i]] += leaves[i]
                saved[up[i]] += saved[i]
    out = nodes[[*_KEY, *_PARENT]].copy()
    out["top"] = [i < 0 for i in up]
    out["conv_id"], out["depth"] = nodes.conv_id, nodes.depth
    out["parent_conv_id"] = pd.array([conv[i] if i >= 0 else None for i in up], "Int64")
    out["n_convs"], out["n_children"], out["n_leaves"], out["saved_tokens"] = nodes.n_convs, [len(c) for c in children], leaves, saved
    return out


def _below(summed: DataFrame) -> DataFrame:
    """What the tops in ``summed`` hand to their parents."""
    return summed.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))


def _divided(nodes: DataFrame, rows: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """``nodes`` with the top (u1, u2) of the part each belongs to, parts of at most ``limit`` nodes; and the paths above divided ones, from the root down.

    A part is what stands below a first turn. While a part is too large, the path that all of it shares is taken off and what is left is
    parted by the turn after it: the node at that depth of a conversation that ends below or at the node.
    """
    first = rows.where("depth = 1").select("conv_id", F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    parts = cut(nodes.join(first, "conv_id"))
    done: list[DataFrame] = []
    paths: list[DataFrame] = []
    while True:
        sizes = parts.groupBy("u1", "u2").agg(F.count("*").alias("size"), F.max("n_convs").alias("whole")).where(F.col("size") > limit).select("u1", "u2", "whole")
        large = cut(sizes)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, parts]), paths
        large = small(large)
        done.append(parts.join(large.select("u1", "u2"), ["u1", "u2"], "left_anti"))
        moved = parts.join(large, ["u1", "u2"])
        path = cut(moved.where("n_convs = whole").drop("whole"))
        paths.append(path)
        ends = small(path.groupBy("u1", "u2").agg(F.max("depth").alias("last")))
        left = moved.drop("whole").join(ends, ["u1", "u2"]).where(F.col("depth") > F.col("last")).drop("u1", "u2").withColumn("next", F.col("last") + 1).drop("last")
        place = rows.select("conv_id", F.col("depth").alias("next"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
        parts = cut(left.join(place, ["conv_id", "next"]).drop("next"))


def _ends(last: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of ``last`` (k1, k2, conv_id): the digest of a node's ids, in order and with commas between.

    Sorted ranges join ids to texts of a batch each, and one task a node hashes its texts one after the other, as a digest has to be made.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            if batch.num_rows:
                starts = np.concatenate(([0], np.flatnonzero(changes(batch, _KEY)) + 1))
                ids = list(map(str, batch.column("conv_id").to_pylist()))
                joined = [",".join(ids[a:b]) for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True)]
                low = batch.column("conv_id").take(pa.array(starts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in _KEY), low, pa.array(np.full(len(starts), n)), pa.array(joined)], names=["k1", "k2", "low", "n", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if key == (k1, k2):
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["k1", "k2", "ends_sha256"])

    ranged = last.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = ranged.mapInArrow(freed(texts), "k1 long, k2 long, low long, n long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low", "n").mapInArrow(freed(digests), "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a node of the trie over ``turns`` (conv_id, at from 0, digest, bytes) of ``convs`` (conv_id): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Copies of a prefix are counted first, so that a conversation that many repeat is one path. Nodes are dealt into parts by a hash
    of their first turn's node, and each part builds its tries in ``applyInPandas``. A first turn's subtrie of more than ``limit`` nodes
    (by default a task's share of all, within LEAST_NODES and UNIT_NODES) is dealt by its next turn, again and again, until
    every part fits; the paths above add up what their parts return. ``conv_id`` is the node's smallest member; the root is
    a row if there is any conversation. An empty table gives no rows.
    """
    spark = turns.sparkSession
    convs = cut(convs)
    rows = cut(prefixes(turns))
    value = lambda c: F.first(c).alias(c)
    nodes = cut(rows.groupBy(*_KEY, "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *map(value, [*_PARENT, "bytes"])))
    total, tasks = nodes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = limit or min(UNIT_NODES, max(LEAST_NODES, total // tasks))
    parts, paths = _divided(nodes, rows, limit)
    buckets = max(tasks, -(-total // UNIT_NODES))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("u1", "u2"), F.lit(buckets)))
    summed = cut(dealt.groupBy("bucket").applyInPandas(_tries, _SUMMED))

    above: list[DataFrame] = []
    tops = summed.where("top")
    for path in reversed(paths):
        below = _below(tops)
        path = path.join(below, _KEY, "left").withColumn("down", -F.col("depth"))
        own = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("s", F.lit(0))
        path = path.withColumns({"one": F.lit(1).cast("long"), "own": own, "ends": F.coalesce("l", F.lit(0))})
        path = running(path, [F.col("u1"), F.col("u2"), F.col("down")], ["one", "own", "ends"], ["u1", "u2"])
        path = path.select(
            *_KEY, *_PARENT, ((F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2"))).alias("top"), "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.when(F.col("one_before") == 0, F.coalesce("c", F.lit(0))).otherwise(1).alias("n_children"), F.greatest("ends_upto", F.lit(1)).alias("n_leaves"), F.col("own_upto").alias("saved_tokens"),
        )
        path = cut(path)
        above.append(path)
        tops = tops.unionByName(path.where("top"))
    firsts = tops.where("depth = 1")
    smallest, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    n_children, n_leaves, saved = firsts.agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    root = [(0, 0, 0, 0, True, smallest, 0, None, n_convs, n_children, n_leaves or 1, saved or 0)] if n_convs else []
    root = spark.createDataFrame(root, _SUMMED)

    inner = summed.where("not top")
    outer = reduce(DataFrame.unionByName, [summed.where("top"), *above])
    upper = reduce(DataFrame.unionByName, [root, *above]).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    outer = outer.drop("parent_conv_id").join(small(upper), _PARENT).select(inner.columns)
    whole = reduce(DataFrame.unionByName, [inner, outer, root])
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *_KEY)).alias("m")).select("conv_id", "m.k1", "m.k2")
    last = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in _KEY))
    ended = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    return whole.join(_ends(last), _KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ended)


def family_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """``prefix_trie`` over conversations rebuilt from their families (see ``rebuilt``); other columns are ignored."""
    turns, convs = rebuilt(numbered_turns(turns, id_col, turn_col, role_col, text_col))
    return prefix_trie(turns, convs, limit)
