"""How the sources of a language differ in their words: exact rankings of sources and terms."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readspan.llm.common import SLICE_BYTES, cut, freed, text_buffers
from readspan.llm.ordered import BROADCAST_ROWS

#: Rows of counts that a task gathers before it sums them up and hands them on.
HELD_ROWS = 600_000
#: Fixed value: what shares are parts of.
SCALE = 1_000_000_000
_COUNTS = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long, total long, head boolean"
_PARTIAL = "kind string, lang string, source string, item string, p long, value long"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # ASCII capitals
_INSIDE = np.arange(256) >= 128
_INSIDE[65:91] = _INSIDE[97:123] = True


def _database() -> duckdb.DuckDBPyConnection:
    """In memory only, so that a task writes to no disk of its own."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The text that each term of a run of texts stands in, and the terms: letters of ASCII in lower case and all other characters of more than one byte."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        some = np.diff(offsets) > 0
        begins, ends = offsets[:-1][some], offsets[1:][some] - 1
        first[begins], last[ends] = inside[begins], inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    letters = _FOLD[data[inside]]
    terms = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return np.searchsorted(offsets, start, "right") - 1, terms


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's whole texts, a slice of texts at a time; a text is never divided, so that it counts once for a term."""
    con, groups, names = _database(), {}, []
    con.execute("create table held (g integer, term varchar, n bigint, docs bigint)")
    rows = 0

    def summed() -> Iterator[pa.RecordBatch]:
        named = pa.table({"g": pa.array(range(len(names)), pa.int32()), "lang": pa.array([x[0] for x in names], pa.string()), "source": pa.array([x[1] for x in names], pa.string())})
        con.register("named", named)
        out = con.sql("select lang, source, term, n, docs from (select g, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by all) join named using (g)")
        yield from out.to_arrow_table().to_batches(max_chunksize=20_000)
        con.execute("truncate held")

    for batch in batches:
        data, offsets = text_buffers(batch.column("t"))
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        own = np.fromiter((groups.setdefault(x, len(groups)) for x in zip(lang, source, strict=True)), np.int32, batch.num_rows)
        names.extend(list(groups)[len(names) :])
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
            doc, terms = _terms(data, offsets[lo : hi + 1])
            con.register("terms", pa.table({"g": own[lo:hi][doc], "doc": doc.astype(np.int32), "term": terms}))
            con.execute("insert into held select g, term, sum(n)::bigint, count(*) from (select any_value(g) as g, term, count(*) as n from terms group by doc, term) group by g, term")
            con.unregister("terms")
            lo = hi
            rows = con.execute("select count(*) from held").fetchall()[0][0]
            if rows >= HELD_ROWS:
                yield from summed()
                rows = 0
    if rows:
        yield from summed()
    con.close()


def _shard(sql: str, then: str, columns: str):
    """A task that loads its shard by ``sql`` from the table ``rows`` and returns the rows of ``then``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return

        def whole() -> Iterator[pa.RecordBatch]:
            yield batch
            yield from batches

        con = _database()
        con.register("rows", pa.RecordBatchReader.from_batches(batch.schema, whole()))
        con.execute(sql)
        con.unregister("rows")
        for out in con.sql(then).to_arrow_table().to_batches(max_chunksize=20_000):
            yield out.select(names)
        con.close()

    return freed(run)


_MERGE = "create table c as select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from rows group by all"
_KEEP = """
    select lang, source, term, n, sum(n) over t ::bigint as total, row_number() over (partition by lang, term order by source) = 1 as head
    from c window t as (partition by lang, term) qualify sum(docs) over t >= {least}
"""
_RATE = f"""
    create table k as
    select lang, source, term,
      (1 + {SCALE}::hugeint * (n + 1) // (size + terms))::bigint as p,
      (1 + {SCALE}::hugeint // (size + terms))::bigint as z,
      (1 + {SCALE}::hugeint * (total + 1) // (lang_size + terms))::bigint as q
    from rows
"""
#: What pairs of sources share, what a source has of each share, and the first terms of each source. Joined by term, so only sources that have it meet, and summed up at once.
_SUMS = """
    with pair as (
      select a.lang, a.source, b.source as item,
        sum((a.p-b.p)*(a.p-b.p)//b.p - (a.p-b.z)*(a.p-b.z)//b.z - (a.z-b.p)*(a.z-b.p)//b.p + (a.z-b.z)*(a.z-b.z)//b.z)::bigint as value
      from k a join k b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all)
    select 'pair' as kind, lang, source, item, null::bigint as p, value from pair
    union all select 'own', lang, source, null, p, count(*) from k group by lang, source, p
    union all select 'term', lang, source, term, null, value from (select lang, source, term, (p-q)*(p-q)//q as value from k where p > q)
      qualify row_number() over (partition by lang, source order by value desc, term) <= {top}
"""


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for every source of a language, its distance to each other source (part ``pair``) and the terms that it has most above the language (part ``term``, ``top`` of them).

    Terms are runs of letters, ASCII capitals folded; each language keeps those in at least ``least`` of its documents. A
    group's share of a term is 1 + floor(10⁹ (count + 1) / (its kept words + kept terms)), and a value is the sum, or the
    term's own, of floor((p - q)² / q). All numbers are whole.

    Tasks count their texts in DuckDB; sums of counts are dealt into shards by a hash of language and term, where DuckDB
    merges them, keeps terms, and sums up pairs. Only sources that have a term meet at it: the rest of a pair's sum
    follows from how many terms a source has of each share, because the other's share of a term it lacks is always the
    same. Spark adds the partial sums up and ranks them. A frequent term is one row a source and task; a large source
    or language is spread over all shards. Sources and languages are joined from a table with one row a group, which is
    broadcast up to ``broadcast_rows`` groups (pairs are its square, so more have no readable result) and shuffled beyond.

    Null texts, languages and sources count as empty. Groups without kept terms are listed; a language without kept terms has values of 0
    and no terms. An empty table gives no rows; other columns are ignored.
    """
    empty = F.lit("")
    read = docs.select(F.coalesce(lang_col, empty).alias("lang"), F.coalesce(source_col, empty).alias("source"), F.coalesce(text_col, empty).alias("t"))
    counts = read.mapInArrow(freed(_count), _COUNTS)
    merged = counts.repartition("lang", "term").mapInArrow(_shard(_MERGE, _KEEP.format(least=least), _KEPT), _KEPT)
    kept = cut(merged)

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum(F.col("head").cast("long")).alias("terms"))
    groups = read.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "lang_size", "terms"])
    zero = F.when(F.col("terms") > 0, 1 + F.expr(f"{SCALE}L div greatest(size + terms, 1L)"))
    groups = cut(groups.withColumn("z", zero))
    few = groups.count() <= broadcast_rows
    held = F.broadcast(groups) if few else groups

    rated = kept.drop("head").join(held.drop("z"), ["lang", "source"])
    rated = rated if few else rated.repartition("lang", "term")
    sums = cut(rated.select("lang", "source", "term", "n", "total", "size", "terms", "lang_size").mapInArrow(_shard(_RATE, _SUMS.format(top=top), _PARTIAL), _PARTIAL))

    own = sums.where("kind = 'own'").groupBy("lang", "source", "p").agg(F.sum("value").alias("n")).join(held.select("lang", "source", "z"), ["lang", "source"])
    other = held.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.col("terms"))
    gap = lambda p, q: F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")
    mine = F.sum(F.col("n") * (gap("p", "y") - gap("z", "y"))).alias("mine")
    theirs = F.sum(F.col("n") * (gap("y", "p") - gap("y", "z"))).alias("theirs")
    sided = own.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(mine, theirs)
    sided = cut(sided)
    base = groups.join(other.drop("terms"), "lang").where("source <> item")
    pairs = (
        base.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * gap("z", "y")).otherwise(0).alias("value"))
        .unionByName(sums.where("kind = 'pair'").select("lang", "source", "item", "value"))
        .unionByName(sided.select("lang", "source", "item", F.col("mine").alias("value")))
        .unionByName(sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value")))
    )
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(sums.where("kind = 'term'").select("lang", "source", "item", "value"), "term", top))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
