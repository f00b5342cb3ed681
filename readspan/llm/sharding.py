"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one local permutation sorts, on average.
ROWS_A_PART = 200_000
#: Rows that one hypergeometric draw takes from, at most.
BLOCK_ROWS = 10**9


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each part sends to each shard: a draw from all ways to deal the rows uniformly.

    Shard sizes differ by one at most. numpy draws from fewer than BLOCK_ROWS rows; a larger table is dealt in
    blocks of parts below that, each evenly over the shards.
    """
    rng, out, done, lo = np.random.default_rng(seed), np.zeros((len(counts), shards), dtype=np.int64), 0, 0
    while lo < len(counts):
        hi, block = lo + 1, counts[lo]
        while hi < len(counts) and block + counts[hi] < BLOCK_ROWS:
            block, hi = block + counts[hi], hi + 1
        left = np.array([(done + block - s + shards - 1) // shards - (done - s + shards - 1) // shards for s in range(shards)])
        for i in range(lo, hi):
            out[i] = rng.multivariate_hypergeometric(left, counts[i], method="marginals")
            left -= out[i]
        done, lo = done + block, hi
    return out


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``: a uniform shuffle whose shards' row counts differ by one at most.

    Rows are dealt to parts by a hash of id and text and counted; the driver draws the exact part-to-shard counts
    (parts x shards numbers); each part permutes its rows by a seeded key and cuts that order at the drawn
    counts; the rows are exchanged and each shard is permuted again by a second key. That last sort goes by
    ranges of the key, so that a shard is never one task. Only ids, sizes and checksums are shuffled. Everything
    depends on the rows and the seed alone, so a recomputed task gives the same rows.

    Null text has no bytes: size 1. Rows that repeat an id are rows of their own, null ids too. An
    empty table gives no rows; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = lambda salt: F.xxhash64(F.col(id_col), F.crc32(text), F.lit(seed), F.lit(salt))
    total = docs.count()
    parts = max(16, -(-total // ROWS_A_PART))
    dealt = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(key("part"), F.lit(parts)).alias("part"),
        key("first").alias("k1"),
        key("second").alias("k2"),
    )
    counts = dict(dealt.groupBy("part").count().collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    bounds = docs.sparkSession.createDataFrame([(p, [int(x) for x in row]) for p, row in enumerate(np.cumsum(matrix, 1))], "part long, bounds array<long>")
    local = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("k1", "id", "text_crc32", "size")))
    sent = local.join(F.broadcast(bounds), "part").select(  # one row a part, of `shards` numbers
        "id", "size", "text_crc32", "k2", F.size(F.filter("bounds", lambda b: b < F.col("r"))).alias("shard")
    )
    ranges = max(16, -(-total // shards // ROWS_A_PART))
    sent = sent.withColumn("range", F.floor((F.shiftrightunsigned("k2", 32) * ranges) / F.lit(2**32)).cast("int"))
    held = sent.groupBy("shard", "range").count()
    before = held.select("shard", "range", (F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count")).alias("before"))
    order = Window.partitionBy("shard", "range").orderBy("k2", "id", "text_crc32", "size")
    return sent.withColumn("place", F.row_number().over(order)).join(F.broadcast(before), ["shard", "range"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot")
    )
