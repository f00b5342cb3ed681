"""Exact dedup by content sort: sampled splitters, sorted ranges, neighbours compared in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import cut, freed, without

#: Characters of a text that splitters hold.
PREFIX = 64
_RUNS = "id long, keep_id long, group_size long, text_sha256 string, edge boolean, head boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text, then by id with the one to keep first. Only the ids of the open run are held."""
    names = [c.split()[0] for c in _RUNS.split(", ")]
    text, sha, ids, first = None, "", [], True

    def copied(part: pa.Array) -> pa.Array:
        return pa.concat_arrays([part.slice(0, 0), part])  # a slice would hold its whole batch, texts too

    def rows(ids: pa.Array, at: np.ndarray, sizes: np.ndarray, sha: pa.Array, edge: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(at)), pa.array(sizes), sha, pa.array(edge), pa.array(head)], names=names)

    def closed(edge: bool) -> pa.RecordBatch:
        flat = pa.concat_arrays(ids)
        n = len(flat)
        return rows(flat, np.zeros(n, np.int64), np.full(n, n), pa.array([sha] * n, pa.string()), np.full(n, edge), np.arange(n) == 0)

    for batch in batches:
        n, texts, own = batch.num_rows, batch.column("t"), batch.column("id")
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is None or texts[0].as_py() != text
        starts = np.flatnonzero(new)
        begin = int(starts[0]) if len(starts) else n
        if begin:
            ids.append(copied(own.slice(0, begin)))
        if not len(starts):
            continue
        if ids:
            yield closed(first)
            first = False
        last = int(starts[-1])
        if last > begin:
            sizes = np.diff(starts)
            edge = np.zeros(last - begin, bool)
            edge[: sizes[0]] = first
            first = False
            yield rows(own.slice(begin, last - begin), np.repeat(starts[:-1] - begin, sizes), np.repeat(sizes, sizes), batch.column("sha").slice(begin, last - begin), edge, new[begin:last])
        text, sha, ids = texts[last].as_py(), batch.column("sha")[last].as_py(), [copied(own.slice(last))]
    if ids:
        yield closed(True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Sampled splitters deal texts into ranges, ordered by their first PREFIX characters and then by hash, so that
    the sample of long texts stays small; within a range Spark's external sort puts equal texts side by side and
    neighbours are compared in full. The id belongs to the splitters too, so that a group of any size
    is spread over ranges; the first and last run of each range (two rows a range, the only ones that can go on
    in another range) are then joined by their hash.

    ``keep`` is ``smallest`` or ``largest``; ``normalise`` maps the text column (no change by default). Null
    counts as empty text; empty texts are one group. Rows that repeat an id and text all name that id; only one
    row of a group is kept if ids are unique. A row without an id stays only if no row of its group has one. An empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    rows = rows.withColumns({"sha": F.sha2(F.encode("t", "UTF-8"), 256), "start": F.left("t", F.lit(PREFIX))})
    ranged = rows.repartitionByRange("start", "sha", order).sortWithinPartitions("start", "sha", "t", order)
    runs = cut(ranged.select("id", "t", "sha").mapInArrow(freed(_runs), _RUNS))
    best = F.min("keep_id") if keep == "smallest" else F.max("keep_id")
    joined = runs.where("edge and head").groupBy("text_sha256").agg(best.alias("k"), F.sum("group_size").alias("n"))
    out = runs.join(F.broadcast(joined), "text_sha256", "left")  # at most two rows a range
    inner = F.col("edge")
    keep_id = F.when(inner, F.col("k")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(inner, F.col("n")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.equal_null("id", keep_id).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat an id stay or go together."""
    copies = exact_duplicates(docs, id_col, text_col, keep).where("not kept").select(id_col)
    return without(docs, copies, id_col)
