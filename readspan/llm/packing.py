"""Best-fit packing, planned on the histogram of lengths."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import cut, freed

#: Words that a Python worker remembers before it starts anew.
MEMO_WORDS = 200_000
_PIECES = "id long, piece int, start long, length long, ids_crc32 long"

#: Below this code point letters, digits and lower case are alike in every Unicode version and nothing combines.
_SIMPLE_END = 0x180
#: Control characters, the soft hyphen, the capital whose lower case is two characters, and all beyond.
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad\u0130\u0180-\U0010ffff]")
_CHARS = {kind: "".join(map(re.escape, (c for c in map(chr, range(_SIMPLE_END)) if unicodedata.category(c)[0] == kind))) for kind in "LN"}
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_CHARS['L']}]+|[{_CHARS['N']}]|[^\s{_CHARS['L']}{_CHARS['N']}]+")
_PLAIN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTES = _PLAIN | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds:
    """Ids of texts, as little-endian 32-bit numbers, by a tokenizer of lower-case words that drops white space.

    Such a tokenizer treats each of its words by itself, so a word's ids are looked up once they are known. Texts
    with characters on which Unicode versions differ, or that may combine, are left to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        memo, words = self.memo, _WORD.findall(text.lower())
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            tokenize = self.tokenizer.model.tokenize
            for w in set(words).difference(memo):
                shown = w if w.isascii() else "".join(map(_BYTES.__getitem__, w.encode()))
                ids = [t.id for t in tokenize(shown)]
                memo[w] = struct.pack(f"<{len(ids)}I", *ids)
            return b"".join(map(memo.__getitem__, words))


@cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut at every ``size`` tokens. Ids may be null."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("t")):
                ids = known.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                of, piece, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), piece.cast(pa.int32()), start, length, crc], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(freed(run), _PIECES)


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts[length]`` pieces of each length in sequences of ``size``.

    The longest piece left opens a sequence, and the longest that still fits follows, again and again; the same
    filling is used as often as the counts allow, so the work goes with the number of lengths, not of pieces.
    Rows: (length, first rank, first sequence, offset, pieces side by side, sequences), ranks counted within a
    length: rank r takes sequence ``first + (r - first rank) // side`` at ``offset + (r - first rank) % side * length``.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    rank = dict.fromkeys(lengths, 0)
    plan, sequence = [], 0
    while lengths:
        room, filling = size, []
        hi = len(lengths)
        while room and hi:
            at = bisect_right(lengths, room, 0, hi) - 1
            if at < 0:
                break
            n = lengths[at]
            side = min(room // n, left[n])
            filling.append((n, side))
            room, hi = room - n * side, at
        times = min(left[n] // side for n, side in filling)
        offset = 0
        for n, side in filling:
            plan.append((n, rank[n], sequence, offset, side, times))
            offset += n * side
            rank[n] += side * times
            left[n] -= side * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
        sequence += times
    return plan


def best_fit_pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` (id, piece, length and more) with ``sequence_id`` and ``offset``.

    Pieces are sorted by (length, id, piece) over ranges, so that no length, however frequent, is one task; a
    piece's rank within its length follows from its place and from how many of its length earlier ranges hold.
    The driver sees one number for each length of each range (lengths plus ranges at most) and plans on the sums.
    An empty table gives no rows; rows that repeat an id and piece take slots of their own, null ids too. Raises if a
    column has the name of a new one, or if a length is null, under 1 or over ``size``.
    """
    clash = {"sequence_id", "offset"}.intersection(map(str.lower, pieces.columns))
    if clash:
        raise ValueError(f"pieces has columns by the names of new ones: {sorted(clash)}")
    ranged = cut(pieces).repartitionByRange("length", "id", "piece").sortWithinPartitions("length", "id", "piece")
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()))
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for part, n, c in sorted(map(tuple, ranged.groupBy("__range", "length").count().collect())):
        if n is None or not 0 < n <= size:
            raise ValueError(f"a piece has length {n}; sequences hold {size}")
        before[part, n] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + c
    plan = np.array(sorted(best_fit_plan(counts, size)), dtype=np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 44 | plan[:, 1]  # lengths and ranks together

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy().astype(np.int64)
            part = batch.column("__range")[0].as_py()
            starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            sizes = np.diff(np.append(starts, len(n)))
            base = []
            for at, c in zip(starts, sizes, strict=True):
                k = int(n[at])
                base.append(before[part, k] + seen.get(k, 0))
                seen[k] = seen.get(k, 0) + int(c)
            rank = np.repeat(base, sizes) + np.arange(len(n)) - np.repeat(starts, sizes)
            slot = plan[np.searchsorted(keys, n << 44 | rank, "right") - 1]
            rest = rank - slot[:, 1]
            more = slot[:, 2] + rest // slot[:, 4], slot[:, 3] + rest % slot[:, 4] * n
            kept = batch.drop_columns(["__range"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, more)], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranged.mapInArrow(freed(place), ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents. Null text counts as empty and still takes its end id."""
    return best_fit_pack(token_pieces(docs, tokenizer, size, end_id, id_col, text_col), size).withColumnRenamed("id", id_col)
