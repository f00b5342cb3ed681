"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import cut, stored
from readspan.llm.ordered import running, small

#: A packet is at most this part of its source's target, so that where the mix ends, no source is further from its target.
PARTS = 1000
#: Copies of a row that one array lists.
BLOCK = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, rank, start, target)`` for ``sizes`` (source, size long).

    Sources stand by code point, null last, and take ``weights`` in turn. Targets share ``share`` times all sizes by weight;
    one that would be over ``most`` times its source's size stops there, and the excess is shared again. With sources
    sorted by that limit a weight, the level at which sharing ends follows from running sums, without rounds: it is
    the first level under its own source's limit. ``start`` is the size of all sources before.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(sources, [F.col("source").asc_nulls_last()], ["one", "source_size"])
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights)).cast("int") + 1).cast("long")
    ranked = ranked.select("source", "source_size", F.col("one_before").alias("rank"), F.col("source_size_before").alias("start"), turn.alias("weight"), (F.col("source_size") * most).alias("cap"))
    ranked = stored(ranked, "sources")
    total, heavy = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ratio = F.col("cap") / F.col("weight")
    filled = running(ranked.withColumn("ratio", ratio), [F.col("ratio"), F.col("rank")], ["cap", "weight"])
    level = (F.lit(float(total * share)) - F.col("cap_before")) / (F.lit(heavy) - F.col("weight_before"))
    (top,) = filled.select(F.max(F.when(level <= F.col("ratio"), level))).first()
    cap = F.col("cap").cast("double")
    target = cap if top is None else F.least(cap, F.lit(top) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", "start", target.alias("target"))


def _copies(n: Column) -> tuple[Column, Column]:
    """Arrays to explode one after the other for the numbers from 0 to ``n`` - 1: starts of blocks, then (from a column ``b``) their numbers."""
    return F.sequence(F.lit(0).cast("long"), n - 1, F.lit(BLOCK).cast("long")), F.sequence("b", F.least(F.col("b") + BLOCK, n) - 1)


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, first_at.

    ``size`` counts words (ends at ASCII white space; null: 0). Each source queues its documents in the order of a digest
    of their ids, ``most`` times over. A document is sent in packets, most of them whole documents, of at most a
    thousandth of its source's target; a packet's virtual finish time is the words that its source has queued up to its end
    over the source's target. All packets are sorted by that time over ranges and the mix ends at ``share`` times all
    sizes, in the middle of a packet if need be. ``taken`` counts a document's words before that end and
    ``first_at`` is the place of its first word in the mix (null if it takes none).

    No texts are shuffled. Null sources are one source. Rows that repeat an id, a source and a size are queued one after the
    other; null ids are digested like an empty one. Documents without words take none. Reruns give the same rows. An
    empty table gives no rows; other columns are ignored.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size")))
    sources = source_targets(sized, weights, share, most)
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    by_source = small(sources.withColumnRenamed("source", "__source"))
    rows = sized.where("size > 0").groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(by_source, F.equal_null("source", "__source")).withColumns({"words": F.col("size") * F.col("n"), "digest": digest}).drop("source", "__source")
    queued = running(rows, [F.col("rank"), F.col("digest"), F.col("id"), F.col("size")], ["words"]).withColumn("at", F.col("words_before") - F.col("start"))

    queued = queued.withColumn("packet", F.greatest(F.lit(1), F.floor(F.col("target") / PARTS)).cast("long"))
    keys = ["id", "size", "n", "source_size", "target", "rank", "at", "words"]
    sent = queued.select(*keys, "packet", F.explode(F.array(*(F.lit(p).cast("long") for p in range(most)))).alias("turn"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.col("packet"))).alias("from"))
    end = F.least(F.col("from") + F.col("packet"), F.col("words"))
    finish = (F.col("turn") * F.col("source_size") + F.col("at") + end) / F.col("target")
    sent = sent.select(*keys, "turn", (end - F.col("from")).alias("length"), finish.alias("finish"), "from")
    order = [F.col(c) for c in ("finish", "rank", "turn", "at", "from")]
    sent = running(sent, order, ["length"])
    took = F.greatest(F.lit(0), F.least(F.col("length"), F.lit(budget) - F.col("length_before")))
    first = F.min(F.when((F.col("from") == 0) & (F.col("turn") == 0) & (F.col("length_before") < budget), F.col("length_before")))
    per_turn = [F.sum(F.when(F.col("turn") == p, took).otherwise(0)).alias(f"took{p}") for p in range(most)]
    done = sent.groupBy(*keys).agg(first.alias("first_at"), *per_turn)

    blocks, numbers = _copies(F.col("n"))
    done = done.withColumn("b", F.explode(blocks)).withColumn("copy", F.explode(numbers))
    own = [F.greatest(F.lit(0), F.least(F.col("size"), F.col(f"took{p}") - F.col("copy") * F.col("size"))) for p in range(most)]
    taken = sum(own[1:], own[0])
    out = [F.col("id").alias(id_col), F.col("size"), F.col("source_size"), F.col("target")]
    begins = F.when((F.col("copy") == 0) & (taken > 0), F.col("first_at")).cast("long")
    wordless = sized.where("size = 0").join(by_source, F.equal_null("source", "__source"))
    return done.select(*out, taken.cast("long").alias("taken"), begins.alias("first_at")).unionByName(
        wordless.select(*out, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_at"))
    )
