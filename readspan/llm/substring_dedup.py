"""Passages that repeat across documents: content-cut paragraphs, MinHash bands, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.llm import minhash
from readspan.llm.common import Words, components, cut, freed, mix, seeded, slices, stored

#: Words in a shingle and in a paragraph, and shingles from which each paragraph start is chosen. A passage of 51
#: words holds a whole paragraph wherever it stands: 24 + 4 words until the first start, 23 in the paragraph.
WORDS, PARAGRAPH, CHOICE = 5, 23, 24
#: A paragraph's bands join two each of its SMALLEST smallest different shingles: a single one is often a common phrase.
#: Of two paragraphs at 0.8, each of different shingles, neither has more than two of 19 that the other lacks, so the two
#: smallest common ones are among both's four smallest and the two share a band for certain. Where shingles repeat within
#: a paragraph three may lack; then a band is shared with probability 0.996 at least.
SMALLEST = 4
#: Jaccard similarity of paragraphs that count as one.
LEAST = 0.8
#: Numbers (8 bytes each, 96 MB in all) in rows up to which ids, spans or requests are broadcast to the texts rather than joined by a shuffle.
BROADCAST_NUMBERS = 12_000_000
#: Contents of a key up to which all its pairs are compared at once.
SMALL = 64
#: A content's sketch: the last byte of each of its SKETCH smallest shingles in order, then its band. Of two contents at 0.8
#: neither has more than three shingles that the other lacks, so SKETCH - 3 of these bytes agree for certain.
SKETCH, AGREE = 7, 4
#: Contents of a key up to which a task compares all sketches; a larger key is first divided by a third shingle.
LARGE = 1024
_SHINGLES = PARAGRAPH - WORDS + 1
_BANDS = list(combinations(range(SMALLEST), 2))
_NONE = np.uint64(2**64 - 1)


def _sliding(best: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``n`` in a row."""
    width = 1
    while width * 2 <= n:
        x, width = best(x[: len(x) - width], x[width:]), width * 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def paragraphs(words: Words, places_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, position, keys, content, sketch)`` of each paragraph: the text's index, the first word's place, the band keys, a hash of all words and SKETCH bytes.

    A paragraph starts at each shingle that has the smallest hash of some CHOICE shingles in a row, so equal
    passages are cut alike whatever stands around them. ``keys`` has a row a paragraph; a band without shingles is 0.
    With ``places_only`` keys and sketches have no columns.
    """
    n = len(words.hash)
    if n < PARAGRAPH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros((0, len(_BANDS)), np.uint64), np.zeros(0, np.uint64), np.zeros((0, SKETCH), np.uint8))
    factor = seeded(WORDS, 23) | np.uint64(1)
    total = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        total += words.hash[j : n - WORDS + 1 + j] * factor[j]
    shingle = mix(total)
    doc = words.doc
    order = mix(shingle + np.uint64(41))
    span = CHOICE + WORDS - 1
    starts = np.zeros(0, np.int64)
    if n >= span:
        best = _sliding(np.minimum, order, CHOICE)
        whole = doc[: len(best)] == doc[span - 1 : span - 1 + len(best)]
        # a shingle is chosen if it equals the minimum of a whole window that holds it: no such minimum is greater
        edge = np.zeros(CHOICE - 1, np.uint64)
        most = _sliding(np.maximum, np.concatenate((edge, np.where(whole, best, 0).astype(np.uint64), edge)), CHOICE)
        starts = np.flatnonzero(most == order)
    starts = starts[starts + PARAGRAPH <= n]
    starts = starts[doc[starts] == doc[starts + PARAGRAPH - 1]]
    powers = seeded(PARAGRAPH, 29) | np.uint64(1)
    content = np.zeros(len(starts), np.uint64)
    for j in range(PARAGRAPH):
        content += words.hash[starts + j] * powers[j]
    content, place = mix(content), starts - words.first[doc[starts]]
    if places_only:
        return doc[starts], place, np.zeros((len(starts), 0), np.uint64), content, np.zeros((len(starts), 0), np.uint8)
    ranks = mix(shingle + np.uint64(43))
    own = np.sort(np.lib.stride_tricks.sliding_window_view(ranks, _SHINGLES)[starts], axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = _NONE
    own = np.sort(own, axis=1)[:, :SKETCH] if (own[:, 1:] == _NONE).any() else own[:, :SKETCH]
    sketch = (own & np.uint64(255)).astype(np.uint8)
    keys = np.zeros((len(starts), len(_BANDS)), np.uint64)
    for k, (i, j) in enumerate(_BANDS):
        keys[:, k] = mix(mix(own[:, i]) + own[:, j])
        # a single shingle is one band
        keys[(own[:, i] == _NONE) | (own[:, j] == _NONE) & (i + j > 1), k] = 0
    return doc[starts], place, keys, content, sketch


def cut_paragraphs(docs: DataFrame) -> DataFrame:
    """``(id, pos, content)`` of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, words in slices(batch.column("t")):
                doc, pos, _, content, _ = paragraphs(words, places_only=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc]), pa.array(pos.astype(np.int32)), pa.array(content.view(np.int64))], names=["id", "pos", "content"])

    return docs.mapInArrow(freed(run), "id long, pos int, content long")


_ROWS = "key long, content long, id long, sketch long, large boolean"


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether AGREE of the bytes of each ``x`` (..., SKETCH) are in ``y``; some may agree by chance, none is missed."""
    return (x[..., :, None] == y[..., None, :]).any(-1).sum(-1) >= AGREE


class _Contents:
    """Rows sorted by key and content, one a content: its key, least and greatest document and sketch."""

    def __init__(self, key: np.ndarray, content: np.ndarray, lo: np.ndarray, hi: np.ndarray, sketch: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))) if len(key) else np.zeros(0, np.int64)
        self.key, self.content, self.sketch = key[first], content[first], sketch[first]
        self.lo, self.hi = (np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)) if len(first) else (lo, hi)

    def part(self, lo: int, hi: int) -> _Contents:
        return _Contents(*(x[lo:hi] for x in (self.key, self.content, self.lo, self.hi, self.sketch)))

    def joined(self, key: np.ndarray, content: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> _Contents:
        old = self.key, self.content, self.lo, self.hi, self.sketch
        return _Contents(*(np.concatenate(x) for x in zip(old, (key, content, ids, ids, sketch), strict=True)))

    def rows(self) -> pa.RecordBatch:
        """One row a content and document that ``lo`` and ``hi`` name."""
        two = np.flatnonzero(self.lo < self.hi)
        at = np.concatenate((np.arange(len(self.key)), two))
        columns = self.key[at], self.content[at], np.concatenate((self.lo, self.hi[two])), self.sketch[at]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.ones(len(at), bool))], names=["key", "content", "id", "sketch", "large"])

    def split(self, large: int) -> tuple[_Contents, _Contents]:
        """Keys of up to ``large`` contents, and larger ones."""
        begin = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(self.key)))
        if not (size > large).any():
            return self, self.part(0, 0)
        over = np.repeat(size > large, size)
        return tuple(_Contents(*(x[some] for x in (self.key, self.content, self.lo, self.hi, self.sketch))) for some in (~over, over))

    def partnered(self) -> pa.RecordBatch:
        """The contents whose sketch agrees with that of another content of the key that is first in another document."""
        found = np.zeros(len(self.key), bool)
        begin = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(self.key)))
        sketch = np.ascontiguousarray(self.sketch).view(np.uint8).reshape(-1, 8)[:, :SKETCH]
        apart = lambda i, j: self.lo[i] != self.lo[j]
        some = np.repeat((size > 1) & (size <= SMALL), size)
        step = 1
        left = np.flatnonzero(some)
        while len(left):
            left = left[left + step < len(self.key)]
            left = left[self.key[left] == self.key[left + step]]
            for i in np.array_split(left, -(-len(left) // 16384)) if len(left) else ():
                j = i + step
                met = _agree(sketch[i], sketch[j]) & apart(i, j)
                found[i[met]] = True
                found[j[met]] = True
            step += 1
        for a, n in zip(begin[size > SMALL], size[size > SMALL], strict=True):
            every = np.arange(a, a + n)
            for i in np.array_split(every, -(-n // 64)):
                met = _agree(sketch[i][:, None], sketch[every][None]) & apart(i[:, None], every[None]) & (i[:, None] != every[None])
                found[i] |= met.any(1)
        key, content = self.key[found], self.content[found]
        nothing = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), nothing, nothing, pa.array(np.zeros(len(key), bool))], names=["key", "content", "id", "sketch", "large"])


def _met(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and content. Of keys up to ``large`` contents the partnered ones go on; rows of larger keys go on as they are, marked."""
    empty = np.zeros(0, np.int64)
    wait, over = _Contents(empty, empty, empty, empty, empty), None
    for batch in batches:
        key, content, ids, sketch = (batch.column(c).to_numpy() for c in ("key", "content", "id", "sketch"))
        if over is not None:
            n = int(np.searchsorted(key, over, "right"))
            if n:
                yield _Contents(key[:n], content[:n], ids[:n], ids[:n], sketch[:n]).rows()
            key, content, ids, sketch = key[n:], content[n:], ids[n:], sketch[n:]
        if not len(key):
            continue
        over = None
        wait = wait.joined(key, content, ids, sketch)
        last = int(np.searchsorted(wait.key, wait.key[-1]))
        if last:
            few, many = wait.part(0, last).split(large)
            yield few.partnered()
            yield many.rows()
            wait = wait.part(last, len(wait.key))
        if len(wait.key) > large:
            over = wait.key[-1]
            yield wait.rows()
            wait = wait.part(0, 0)
    yield wait.partnered()


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("key", "content", "id", "sketch").repartition("key").sortWithinPartitions("key", "content")


def shared_bands(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """``(key, content)``: contents that share a band key with one first held by another document that their sketch doesn't rule out.

    Contents that the same document holds first are mostly one passage cut a word or two apart. To link them would change
    nothing, as that document keeps both and all others lose both.

    A key's rows stand together in sorted partitions and pass as a stream, so that bands cost one shuffle. A slice of
    text hands on two rows a content at most, whatever its copies. A key of over ``large`` contents is divided by a third
    shingle, which near contents share too, before sketches are compared; what is still as large goes on whole.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, words in slices(batch.column("t")):
                doc, _, keys, content, sketch = paragraphs(words)
                if not len(doc):
                    continue
                own = ids[lo + doc]
                by = np.lexsort((own, content))
                new = np.concatenate(([True], content[by][1:] != content[by][:-1]))
                end = np.append(new[1:], True)
                by = by[new | (end & (own[by] != own[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]))]
                row, band = np.nonzero(keys[by])
                row = by[row]
                packed = np.concatenate((sketch[row], band[:, None].astype(np.uint8)), 1)
                columns = keys[row, band].view(np.int64), content[row].view(np.int64), own[row], np.ascontiguousarray(packed).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "content", "id", "sketch"])

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = np.array(_BANDS)
        for batch in batches:
            key, sketch = batch.column("key").to_numpy(), batch.column("sketch").to_numpy()
            parts = np.ascontiguousarray(sketch).view(np.uint8).reshape(-1, 8)
            own = pair[parts[:, SKETCH]]
            for k in range(SMALLEST + 2):  # the three smallest common shingles are among both's six smallest
                some = np.flatnonzero((own != k).all(1))
                third = mix(key[some].view(np.uint64) + mix(parts[some, k].astype(np.uint64) + np.uint64(53)))
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(third.view(np.int64)), part.column("content"), part.column("id"), part.column("sketch")], names=["key", "content", "id", "sketch"])

    rows = docs.mapInArrow(freed(bands), "key long, content long, id long, sketch long")
    met = partial(_met, large=large)
    first = stored(_sorted(rows).mapInArrow(freed(met), _ROWS), "met")
    many = first.where("large")
    if many.isEmpty():
        return first.select("key", "content")
    parts = many.select("key", "content", "id", "sketch").mapInArrow(freed(divided), "key long, content long, id long, sketch long")
    second = stored(_sorted(parts).mapInArrow(freed(met), _ROWS).select("key", "content").distinct(), "met")
    return first.where("not large").select("key", "content").unionByName(second)


def _few(rows: DataFrame, lists: Column) -> bool:
    """Whether ``rows`` (cut or stored) and the ``lists`` in them hold BROADCAST_NUMBERS numbers at most."""
    rows_, items = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return 2 * rows_ + 4 * items <= BROADCAST_NUMBERS


def _with_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``docs`` joined with ``asked`` (one row an id): by broadcast if ``asked`` is small, else by a shuffle."""
    asked = cut(asked)
    return docs.join(F.broadcast(asked) if _few(asked, F.col("asked")) else asked, "id")


def _requests(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, pa.StructArray]:
    """The requests of rows ``lo`` to ``hi``: the row of each, from 0, and the requests."""
    part = column.slice(lo, hi - lo)
    return np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy())), part.flatten()


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def _shingle_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``(content, shingles)`` of paragraphs asked for by (id, pos, content)."""
    rows = _with_texts(docs, asked.groupBy("id").agg(F.collect_list(F.struct("pos", "content")).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = seeded(WORDS, 23) | np.uint64(1)
        for batch in batches:
            for lo, hi, words in slices(batch.column("t")):
                row, asked_ = _requests(batch.column("asked"), lo, hi)
                if not len(row):
                    continue
                at = words.first[row] + asked_.field("pos").to_numpy()
                own = words.hash[at[:, None] + np.arange(PARAGRAPH)]
                total = np.zeros((len(row), _SHINGLES), np.uint64)
                for j in range(WORDS):
                    total += own[:, j : j + _SHINGLES] * factor[j]
                total.sort(axis=1)
                new = np.ones(total.shape, bool)
                new[:, 1:] = total[:, 1:] != total[:, :-1]
                yield pa.RecordBatch.from_arrays([asked_.field("content"), _lists(total[new].view(np.int64), new.sum(1))], names=["content", "shingles"])

    return rows.select("t", "asked").mapInArrow(freed(run), "content long, shingles array<long>")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_contents(members: DataFrame, keepers: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between contents of ``members`` (key, content) that share a key and have Jaccard similarity ``least``.

    Linked contents are all those, up to components, that different documents hold first: in keys of up to LARGE contents
    all pairs are compared. In larger ones every content meets the key's smallest; those that this and the other keys
    leave in different components are compared in blocks, but for those of whose shingles too few are in a content of the
    key in another component. ``keepers`` (content, id, pos) tells where a content stands first.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("key").alias("k"), "n")
    some = cut(members.withColumn("k", F.bitwise_not("key")).join(sizes, "k").select("key", "content", "n"))
    if some.isEmpty():
        return some.select(F.col("content").alias("a"), F.col("content").alias("b"))
    asked = keepers.join(some.select("content").distinct(), "content").select("id", "pos", "content")
    sets = stored(_shingle_sets(docs, asked).dropDuplicates(["content"]).join(asked.select("content", F.col("id").alias("lo")), "content"), "sets")
    links = stored(_linked_in_small(some.where(F.col("n") <= LARGE).select("key", "content").join(sets, "content"), least), "links")
    large = cut(some.where(F.col("n") > LARGE).select("key", "content"))
    if large.isEmpty():
        return links
    lead = large.groupBy("key").agg(F.min("content").alias("a")).select(F.bitwise_not("key").alias("k"), "a")
    stars = large.withColumn("k", F.bitwise_not("key")).join(lead, "k").where("content <> a").select("a", F.col("content").alias("b")).distinct()
    stars = stars.join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("own")), "b").withColumn("k", F.bitwise_not("a"))
    stars = stars.join(sets.select(F.bitwise_not("content").alias("k"), F.col("shingles").alias("base")), "k").where(_jaccard(F.col("own"), F.col("base")) >= least)
    links = stored(links.unionByName(stars.select("a", "b")), "links")
    labelled = large.join(components(links).select(F.col("node").alias("content"), "component"), "content", "left")
    rest = cut(minhash._mixed(labelled.select("key", F.col("content").alias("id"), F.coalesce("component", "content").alias("label"))))
    held = sets.select(F.col("content").alias("id"), F.size("shingles").alias("n"), F.col("shingles").alias("shared"))
    # a pair's common shingles are in contents of two components of the key
    rows = cut(rest.join(held, "id").select("key", "id", "label", "n", F.explode("shared").alias("s")).withColumn("k", F.xxhash64("key", "s")))
    shared = rows.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.bitwise_not("k").alias("j"))
    able = rows.withColumn("j", F.bitwise_not("k")).join(shared, "j").groupBy("key", "id", "label").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    rest = stored(minhash._mixed(able.where(F.col("c") >= least * F.col("n")).select("key", "id", "label")), "rest")
    return stored(links.unionByName(minhash.linked_in_blocks(rest, held, least)), "links")


def _linked_in_small(rows: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of all pairs of ``rows`` (key, content, shingles, lo) in one key whose similarity is ``least`` and whose ``lo`` differs.

    Many keys are compared at a time in sorted partitions; one of over SMALL contents by itself, and hands on as many
    pairs as join its classes.
    """

    def linked(part: pa.Table) -> pa.RecordBatch:
        key, content, first = (part.column(c).to_numpy() for c in ("key", "content", "lo"))
        shingles = part.column("shingles").combine_chunks()
        size = np.diff(shingles.offsets.to_numpy())
        row = np.repeat(np.arange(len(key)), size)
        sets = np.zeros((len(key), _SHINGLES), np.int64)
        sets[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = shingles.flatten().to_numpy()
        blank = _SHINGLES - size
        a, b, apart = [], [], 1
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(begin, len(key)))
        few = np.repeat(n <= SMALL, n)
        for at, many in zip(begin[n > SMALL], n[n > SMALL], strict=True):
            j = np.arange(at, at + many)
            near = np.zeros((many, many), bool)
            for i in np.array_split(j, -(-many // 16)):
                both = (sets[i][:, None, :, None] == sets[j][None, :, None, :]).sum((2, 3)) - blank[i][:, None] * blank[j]
                near[i - at] = (both >= least * (size[i][:, None] + size[j] - both)) & (first[i][:, None] != first[j])
            x, y = minhash.spanning(near)
            a.append(np.minimum(content[j[x]], content[j[y]]))
            b.append(np.maximum(content[j[x]], content[j[y]]))
        while True:
            left = np.flatnonzero((key[:-apart] == key[apart:]) & few[apart:])
            if not len(left):
                break
            left = left[first[left] != first[left + apart]]
            for i in np.array_split(left, -(-len(left) // 8192)) if len(left) else ():
                j = i + apart
                both = (sets[i][:, :, None] == sets[j][:, None, :]).sum((1, 2)) - blank[i] * blank[j]
                near = both >= least * (size[i] + size[j] - both)
                a.append(np.minimum(content[i], content[j])[near])
                b.append(np.maximum(content[i], content[j])[near])
            apart += 1
        pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if wait is None else pa.concat_tables([wait, part])
            key = part.column("key").to_numpy()
            if len(key):
                whole = int(np.searchsorted(key, key[-1]))
                wait = part.slice(whole)
                if whole:
                    yield linked(part.slice(0, whole))
        if wait is not None and wait.num_rows:
            yield linked(wait)

    rows = rows.select("key", "content", "shingles", "lo").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(freed(run), "a long, b long").distinct()


def _contexts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``(id, at, side, context)``: hashes of up to CHOICE + WORDS words left (``side`` -1, nearest first) or right of place ``at``."""
    rows = _with_texts(docs, ends.groupBy("id").agg(F.collect_list(F.struct("at", "side")).alias("asked")))
    reach = np.arange(CHOICE + WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, hi, words in slices(batch.column("t")):
                row, asked = _requests(batch.column("asked"), lo, hi)
                if not len(row):
                    continue
                at, side = asked.field("at").to_numpy(), asked.field("side").to_numpy()
                place = np.where(side[:, None] < 0, at[:, None] - 1 - reach, at[:, None] + reach)
                inside = (place >= 0) & (place < words.count[row][:, None])
                context = words.hash[np.where(inside, words.first[row][:, None] + place, 0)].view(np.int64)
                columns = pa.array(ids[lo + row]), asked.field("at"), asked.field("side"), _lists(context[inside], inside.sum(1))
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "at", "side", "context"])

    return rows.select("id", "t", "asked").mapInArrow(freed(run), "id long, at int, side int, context array<long>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(id, start, end, class_id)``: word spans of documents that repeat a passage of another document.

    A passage's class is the component of its paragraphs; the occurrence in the smallest id stays, every other
    document's is a span. At both ends a span is carried on as far as the words are those beside the kept
    occurrence. Words are split at ASCII white space and compared with ASCII case folded. A passage that repeats
    only within one document is no span. ``class_id`` is the kept occurrence's document.

    Each distinct paragraph content is one row from the first aggregation on, so a passage that very many
    documents share costs one row a document, and no pairs of documents are made.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("id is not null")
    flat = cut_paragraphs(docs)
    members = stored(shared_bands(docs), "members")
    alike = members.select("content").distinct().withColumn("alike", F.lit(True))
    # only contents that several documents have, or that share a band, go on
    classes = flat.groupBy("content").agg(F.min(F.struct("id", "pos")).alias("keeper"), F.max("id").alias("hi")).join(alike, "content", "left")
    classes = cut(classes.select("content", "keeper", F.col("keeper.id").alias("lo"), "hi", "alike").where("alike or lo < hi"))
    links = near_contents(members, classes.where("alike").select("content", "keeper.id", "keeper.pos"), docs, least)
    near = components(links)
    grouped = classes.join(near.select(F.col("node").alias("content"), "component"), "content", "left")
    grouped = cut(grouped.select("content", "keeper", "lo", "hi", F.coalesce("component", "content").alias("component")))
    best = grouped.groupBy("component").agg(F.min("keeper").alias("best"), F.max("hi").alias("top")).where("best.id < top")
    # equal words of the kept document are the nearest occurrence, else the component's first
    kept = grouped.join(best, "component").select(F.bitwise_not("content").alias("c"), F.when(F.col("lo") == F.col("best.id"), F.col("keeper")).otherwise(F.col("best")).alias("best"))
    hits = flat.withColumn("c", F.bitwise_not("content")).join(kept, "c").where("id <> best.id")
    hits = hits.select("id", F.col("pos").alias("start"), (F.col("pos") + PARAGRAPH).alias("end"), F.col("best.id").alias("k_id"), F.col("best.pos").alias("k_pos"))
    runs = cut(_merged(hits))
    # carry each end on while the words agree with those beside the kept occurrence
    left = runs.select("id", F.col("start").alias("at"), F.lit(-1).alias("side"), F.col("l_id").alias("k_id"), F.col("l_pos").alias("k_at"))
    right = runs.select("id", F.col("end").alias("at"), F.lit(1).alias("side"), F.col("r_id").alias("k_id"), (F.col("r_pos") + PARAGRAPH).alias("k_at"))
    ends = cut(left.unionByName(right))
    asked = ends.select("id", "at", "side").unionByName(ends.select(F.col("k_id").alias("id"), F.col("k_at").alias("at"), "side")).distinct()
    around = cut(_contexts(docs, asked).dropDuplicates(["id", "at", "side"]))
    own = around.select("id", "at", "side", F.col("context").alias("own"))
    other = around.select(F.xxhash64("id", "at", "side").alias("k"), F.col("id").alias("k_id"), F.col("at").alias("k_at"), "side", F.col("context").alias("other"))
    both = ends.join(own, ["id", "at", "side"]).withColumn("k", F.xxhash64("k_id", "k_at", "side")).join(other, ["k", "k_id", "k_at", "side"])
    same = F.aggregate(
        F.arrays_zip("own", "other"),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, x: F.struct(
            (acc["n"] + (acc["go"] & F.equal_null(x["own"], x["other"]) & x["own"].isNotNull()).cast("int")).alias("n"),
            (acc["go"] & F.equal_null(x["own"], x["other"])).alias("go"),
        ),
    )["n"]
    more = both.groupBy("id", "at", "side").agg(F.max(same).alias("n"))
    before = more.where("side < 0").select("id", F.col("at").alias("start"), F.col("n").alias("n_left"))
    after = more.where("side > 0").select("id", F.col("at").alias("end"), F.col("n").alias("n_right"))
    out = runs.join(before, ["id", "start"], "left").join(after, ["id", "end"], "left")
    return out.select(
        "id",
        (F.col("start") - F.coalesce("n_left", F.lit(0))).alias("start"),
        (F.col("end") + F.coalesce("n_right", F.lit(0))).alias("end"),
        F.col("l_id").alias("class_id"),
    )


def _merged(hits: DataFrame) -> DataFrame:
    """``(id, start, end, l_id, l_pos, r_id, r_pos)``: hits of a document that touch or overlap, as one, with the kept places of its first and last."""
    w = Window.partitionBy("id").orderBy("start", "k_id", "k_pos")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("id", "run").agg(F.min(F.struct("start", "k_id", "k_pos")).alias("l"), F.max(F.struct("end", "k_id", "k_pos")).alias("r"))
    return runs.select("id", "l.start", "r.end", F.col("l.k_id").alias("l_id"), F.col("l.k_pos").alias("l_pos"), F.col("r.k_id").alias("r_id"), F.col("r.k_pos").alias("r_pos"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text_col``, and ``n_removed_words``, ``n_spans``, ``class_ids``.

    White space before a removed passage goes with it; all other characters stay. Null text counts as empty and
    stays null; documents without repeats are unchanged; a document that is nothing but repeats becomes empty.
    Rows that repeat an id are cut alike, rows with a null id stay whole. Other columns are kept as they are; raises if
    ``docs`` has a column by one of the three new names. An empty table gives no rows.
    """
    clash = {"n_removed_words", "n_spans", "class_ids"}.intersection(map(str.lower, docs.columns))
    if clash:
        raise ValueError(f"docs has columns by the names of new ones: {sorted(clash)}")
    spans = repeated_spans(docs, id_col, text_col, least)
    per_doc = spans.groupBy(F.col("id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"), F.sort_array(F.collect_set("class_id")).alias("__classes"))
    per_doc = cut(per_doc)
    per_doc = F.broadcast(per_doc) if _few(per_doc, F.col("__spans")) else per_doc
    joined = docs.join(per_doc, docs[id_col].cast("long") == per_doc["__id"], "left")

    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted in batches:
            out = []
            for lo, _, words in slices(texts):
                for i in range(words.n):
                    text, spans_ = texts[lo + i].as_py(), wanted[lo + i].as_py()
                    if not text or not spans_:
                        out.append(text)
                        continue
                    data, at, parts, base = text.encode("utf-8"), 0, [], words.first[i]
                    for s in spans_:
                        a, b = max(s["start"], 0), min(s["end"], words.first[i + 1] - base)
                        if a < b:
                            begin, end = int(words.end[base + a - 1]) if a else 0, int(words.end[base + b - 1])
                            parts.append(data[at : max(at, begin)])
                            at = max(at, end)
                    out.append((b"".join(parts) + data[at:]).decode("utf-8"))
            yield pa.array(out, pa.string())

    changed = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.arrow_udf(cut_out, "string")(F.col(text_col), F.col("__spans")))
    n = F.aggregate(F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    more = {text_col: changed, "n_removed_words": n, "n_spans": F.greatest(F.size("__spans"), F.lit(0)), "class_ids": F.coalesce("__classes", F.array().cast("array<long>"))}
    return joined.withColumns(more).drop("__id", "__spans", "__classes")
