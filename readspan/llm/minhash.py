"""Near-duplicate documents by DartMinHash signatures, banded joins and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import components, cut, folder, freed, mix, seeded, slices, without

#: Words in a shingle.
WORDS = 5
#: Jaccard similarity from which two documents are near duplicates.
LEAST = 0.8
#: 25 bands of 5: a pair at 0.8 shares a band with probability 0.99995, at 0.5 with 0.55, at 0.3 with 0.06.
BANDS, ROWS = 25, 5
#: Tasks over which the members of one group are spread for verification.
SALTS = 256
#: Texts of a bucket that meet as many others at a time.
BLOCK = 256

_ONE = np.uint64(1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``n`` signatures of ``k`` coordinates of weighted sets; two agree in a coordinate with probability their weighted Jaccard similarity.

    Every element has a plane of weight by rank, cut into regions of weight [0, 1), [1, 2), [2, 4), ... Darts fall
    on a region at a rate of its width per unit of rank, at places that hashes of element and region fix for
    every set. A set meets the darts under its element's weight; each goes to a hashed coordinate, which keeps
    its earliest. Darts are thrown up to the rank where about k(ln k + 2) are met, and further for sets that
    still have an empty coordinate. Elements may repeat: their darts are the same. A set without elements has
    all coordinates zero.
    """
    if weights is None:
        region, width, low, weight = elements, None, None, None
        total = np.bincount(owner, minlength=n).astype(np.float64)
    else:
        some = weights > 0
        elements, owner, weights = elements[some], owner[some], weights[some].astype(np.float64)
        total = np.bincount(owner, weights, minlength=n)
        cells = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
        cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
        region = mix(np.repeat(elements, cells) + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        owner, weight = np.repeat(owner, cells), np.repeat(weights, cells)
        low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
        width = np.where(cell == 0, 1.0, low)
    best = np.full(n * k, np.inf)
    reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0)
    open_sets = total > 0
    while open_sets.any():
        active = np.flatnonzero(open_sets[owner])
        rank, dart = np.zeros(len(active)), np.uint64(0)
        while len(active):
            step = max(1, min(512, 40_000 // len(active)))  # darts of a region at a time
            h = mix(region[active][:, None] + (np.arange(step, dtype=np.uint64) + dart + _ONE)[None] * np.uint64(0x9E3779B97F4A7C15))
            gaps = -np.log(_uniform(h))
            if width is not None:
                gaps /= width[active][:, None]
            gaps[:, 0] += rank  # one dart after the other from the carried rank, so that step changes no bit of a rank
            ranks = np.cumsum(gaps, 1)
            met = ranks <= reach[owner[active]][:, None]
            if weight is not None:
                at = low[active][:, None] + width[active][:, None] * _uniform(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                hit = met & (at < weight[active][:, None])
            else:
                hit = met
            i, j = np.nonzero(hit)
            coordinate = (mix(h[i, j] + np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, owner[active[i]] * k + coordinate, ranks[i, j])
            go = met[:, -1]
            active, rank, dart = active[go], ranks[go, -1], dart + np.uint64(step)
        open_sets = open_sets & np.isinf(best.reshape(n, k)).any(1)
        reach = np.where(open_sets, reach * 2, reach)
    best[np.isinf(best)] = 0
    return best.view(np.uint64).reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One long for each band of each signature."""
    factor = seeded(rows, 31) | _ONE
    parts = (signatures.reshape(len(signatures), bands, rows) * factor).sum(2, dtype=np.uint64)
    return mix(parts + seeded(bands, 37)).view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(id, digest, words, bands)`` of every document, in one pass over the texts."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in slices(batch.column("t")):
                hashes, owner = words.shingles(WORDS)
                keys = band_keys(dart_signatures(hashes, owner, words.n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest").cast(pa.binary()), pa.array(words.count), lists], schema=schema)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows_ = docs.select("id", F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"), text.alias("t"))
    return rows_.mapInArrow(freed(run), "id long, digest binary, words long, bands array<long>")


def bucketed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, t)`` of the documents in ``ids``, written to the shared folder: the only shuffle of all texts."""
    path = folder(docs.sparkSession, "bucketed")
    docs.select("id", F.coalesce("text", F.lit("")).alias("t")).join(ids.distinct(), "id", "left_semi").write.parquet(path)
    return docs.sparkSession.read.schema("id long, t string").parquet(path)


def held_elsewhere(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, n, c, shared)``: of a text's n different shingles, the c in ``shared`` are also in a text of another label; texts without any are left out.

    Only those can be shared with a partner of another label, so two such texts with o = min(c, c') have a
    similarity of o / (o + (n - c) + (n' - c')) at most. One aggregation over shingles, without pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, words in slices(batch.column("t")):
                hashes, owner = words.shingles(WORDS)
                by = np.lexsort((hashes, owner))
                hashes, owner = hashes[by], owner[by]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[new], owner[new]
                n = np.bincount(owner, minlength=words.n)[owner] if len(owner) else owner
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + owner]), pa.array(n.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["id", "n", "s"])

    rows = cut(texts.mapInArrow(freed(run), "id long, n int, s long").join(labels, "id"))
    shared = rows.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.bitwise_not("s").alias("k"))
    met = rows.withColumn("k", F.bitwise_not("s")).join(shared, "k").groupBy("id")
    return met.agg(F.min("n").alias("n"), F.collect_set("s").alias("shared")).withColumn("c", F.size("shared"))


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a part of the true cells that still links all that they link: fewer than rows plus columns."""
    rows, columns = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_rows, open_columns = near.any(1), near.any(0)
    while open_rows.any():
        edge = np.flatnonzero(open_rows)[:1]
        open_rows[edge] = False
        while len(edge):
            new = np.flatnonzero(near[edge].any(0) & open_columns)
            open_columns[new] = False
            rows, columns = np.append(rows, edge[near[np.ix_(edge, new)].argmax(0)]) if len(new) else rows, np.append(columns, new)
            edge = np.flatnonzero(near[:, new].any(1) & open_rows)
            open_rows[edge] = False
            rows, columns = np.append(rows, edge), np.append(columns, new[near[np.ix_(edge, new)].argmax(1)]) if len(edge) else columns
    return rows, columns


def linked_in_blocks(rest: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of different labels in one bucket whose similarity is ``least``, as many of them as join what they all join.

    A bucket is cut into blocks of about BLOCK texts and every two blocks meet in one group, whose common
    shingles are counted for all pairs at once by a product of incidence matrices. A group hands on a spanning forest,
    fewer links than it has texts.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).select(F.bitwise_not("key").alias("k"), "blocks")
    rows = rest.withColumn("k", F.bitwise_not("key")).join(sizes, "k").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "label", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(held, "id")

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, labels, n = (group[c].to_numpy() for c in ("id", "label", "n"))
        count = group["shared"].map(len).to_numpy()
        flat, owner = np.concatenate(group["shared"].to_list()), np.repeat(np.arange(len(group)), count)
        _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        several = often[code] > 1
        code, owner = np.unique(code[several], return_inverse=True)[1], owner[several]
        left, right = (np.flatnonzero(group["own"].to_numpy() == k) for k in (keys[1], keys[2]))
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
            part = (code >= lo) & (code < lo + 4096)
            held_by = np.zeros((len(group), 4096), np.float32)
            held_by[owner[part], code[part] - lo] = 1
            both += held_by[left] @ held_by[right].T
        near = (both > 0) & (both >= least * (n[left][:, None] + n[right][None] - both)) & (labels[left][:, None] != labels[right][None])
        i, j = spanning(near)
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("key", "x", "y").applyInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets of shingles have a Jaccard similarity of ``least``.

    ``texts`` (id, t) are joined with the pairs' ends; then each ``a`` meets its ``b`` in sorted partitions, spread by a
    salt so that an ``a`` with very many partners is no single task. A task holds one ``a`` and a slice of text.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    ends = pairs.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("kind")).unionByName(
        pairs.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("kind")).distinct()
    )
    rows = texts.join(ends, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, base = None, None
        for batch in batches:
            a, b, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "id", "kind"))
            found = []
            for lo, hi, words in slices(batch.column("t")):
                hashes, owner = words.shingles(WORDS)
                first = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    own = np.unique(hashes[first[i - lo] : first[i - lo + 1]])
                    if kind[i] == 0:
                        head, base = a[i], own
                        continue
                    assert head == a[i]
                    small, large = sorted((len(own), len(base)))
                    if small and small >= least * large:
                        both = len(np.intersect1d(own, base, assume_unique=True))
                        if both >= least * (len(own) + len(base) - both):
                            found.append((a[i], b[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], schema=schema)

    return rows.select("a", "id", "kind", "t").mapInArrow(freed(run), "a long, b long").distinct()


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows ``(key, id, label)`` of buckets that hold several labels."""
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    several = several.select(F.bitwise_not("key").alias("k"))
    return labelled.withColumn("k", F.bitwise_not("key")).join(several, "k").select("key", "id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``(id, class_id, n_links, kept)``; ``class_id`` is the smallest id of its class.

    Two documents are linked if their texts are equal, or if the sets of their five-word shingles (ASCII case
    folded, split at white space; a shorter text is one shingle) reach ``least`` and they share a band. Classes
    are the components of links; ``n_links`` counts the links that were found between a document's text and different
    ones (enough to join each class, not all there are), ``kept`` marks a class's smallest id.

    Equal texts count as one from the start. In each bucket of a band every text is compared with the bucket's
    smallest. Texts that this leaves in different classes are compared with each other in blocks, but for those
    that can't reach ``least`` because too few of their shingles are in any text of another class, as one count
    over shingles tells. So no link inside a bucket is missed, while a large group of copies costs one
    comparison a member and bucket.

    Null text counts as empty. Texts without words are linked only with equal texts. Rows that repeat an id are
    one document with several rows. A row without an id is in the class of the rows with its text that have one, and not kept;
    a text that only such rows have is compared with none: their ``class_id`` is null and they are kept. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = cut(signed(docs, bands, rows))
    copies = sigs.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = sigs.where("words > 0").join(copies.select(F.col("rep").alias("id"), F.col("digest").alias("d2")), "id").where("digest = d2")
    members = cut(reps.dropDuplicates(["id"]).select("id", F.explode("bands").alias("key")))
    buckets = members.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    linked = members.withColumn("k", F.bitwise_not("key")).join(buckets.select(F.bitwise_not("key").alias("k"), "a", "n"), "k")
    linked = cut(linked.select("key", "id", "a", "n"))
    texts = bucketed_texts(docs, linked.select("id"))
    stars = linked.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = cut(verified(stars, texts, least))
    classes = components(links)
    # what the stars leave apart within a bucket
    labelled = linked.where("n > 2").join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = cut(labelled.select("key", "id", F.coalesce("component", "id").alias("label")))
    rest = cut(_mixed(labelled))
    labels = cut(rest.select("id", "label").distinct())
    held = cut(held_elsewhere(texts.join(labels.select("id"), "id", "left_semi"), labels).where(F.col("c") >= least * F.col("n")))
    rest = cut(_mixed(rest.join(held.select("id"), "id", "left_semi")))
    links = cut(links.unionByName(linked_in_blocks(rest, held, least)))
    classes = components(links)
    # a star's centre ends very many links: they are counted in parts first
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
    ends = ends.groupBy("id", F.pmod(F.xxhash64("o"), F.lit(SALTS)).alias("salt")).count().groupBy("id").agg(F.sum("count").alias("count"))
    per_text = copies.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").join(ends.select(F.col("id").alias("rep"), "count"), "rep", "left")
    per_text = cut(per_text.select("digest", F.coalesce("component", "rep").alias("class_id"), F.coalesce("count", F.lit(0)).cast("long").alias("n_links")))
    out = sigs.select("id", "digest").join(per_text, "digest")
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", F.equal_null("id", "class_id").alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with all their columns. Rows without an id stay."""
    copies = near_duplicates(docs, id_col, text_col, **settings).where("not kept").select(id_col)
    return without(docs, copies, id_col)
