"""SentencePiece encoding by suffix-array matching of all pieces, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import freed

_SPACE = "▁"
_WORD = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
#: Words that a Python worker remembers, and characters of new words that one index covers.
MEMO_WORDS, INDEX_CHARS = 500_000, 200_000
#: Characters of text that are encoded at a time (one longer text by itself).
BATCH_CHARS = 2_000_000
#: Characters from which a word is merged by a heap of its own rather than with the others.
LONG_WORD = 128
_NONE = np.int32(2**31 - 1)
_OUT = "id long, n_tokens long, ids binary, decoded string"


class Codec:
    """Encodes and decodes as the model's BPE does: of all neighbours that make a piece the best-scored merge first, the leftmost of equals.

    No piece crosses from other characters to a space mark, so a word, its space marks before it, is encoded by
    itself; ids of known words are looked up. New words are laid end to end and their suffixes (at characters,
    as deep as the longest piece) sorted; every piece is found in that array by binary search; the occurrences,
    sorted by position, are the edges that merging relaxes. A character that is no piece becomes its bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        if any(_SPACE in self.pieces[i].lstrip(_SPACE) for i in normal):
            raise ValueError("a piece crosses from text to a space mark; words can't be encoded by themselves")
        raw = [self.pieces[i].encode() for i in normal]
        self.depth = max(map(len, raw))
        self.width = max(len(self.pieces[i]) for i in normal)
        self.raw, self.raw_bytes = np.array(raw, dtype=f"S{self.depth}"), np.array([len(x) for x in raw])
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.piece_id = np.array(normal, np.int32)
        self.piece_chars = np.array([len(self.pieces[i]) for i in normal])
        scores = np.array([sp.get_score(i) for i in normal])
        # single characters are merged from nothing; of other pieces rank and length name one, also where scores are equal
        self.rank = (np.unique(np.where(self.piece_chars > 1, -scores, np.inf), return_inverse=True)[1]).astype(np.int32)
        singles = self.piece_chars == 1
        self.rank[singles] += np.arange(int(singles.sum()), dtype=np.int32)
        names = self.rank.astype(np.int64) * (self.width + 1) + self.piece_chars
        by = np.argsort(names)
        self.names, self.named = names[by], self.piece_id[by].astype(np.int64)
        if (self.names[1:] == self.names[:-1]).any():
            raise ValueError("pieces of equal score and length; a rank doesn't name its piece")
        self.memo: dict[str, bytes] = {}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each word, and by character and length of a piece there its rank.

        A word of more than INDEX_CHARS characters is indexed in windows that overlap by the longest piece, so that the
        suffixes that are sorted at a time don't depend on it; what is kept of it is one number a character and length.
        """
        first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        rank = np.full((int(first[-1]), self.width + 1), _NONE, np.int32)
        if first[-1] <= 2 * INDEX_CHARS:
            self._index("".join(words), first[1:], rank)
            return first, rank
        (word,) = words  # a long word comes by itself
        for lo in range(0, len(word), INDEX_CHARS):
            part = word[lo : lo + INDEX_CHARS + self.width]
            found = np.full((len(part), self.width + 1), _NONE, np.int32)
            self._index(part, np.array([len(part)]), found)
            rank[lo : lo + INDEX_CHARS] = found[: min(INDEX_CHARS, len(part))]
        return first, rank

    def _index(self, text: str, word_ends: np.ndarray, rank: np.ndarray) -> None:
        """Sort the suffixes of some words laid end to end, find every piece in them, and note its rank where it stands."""
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
        ends = np.append(at, len(data))[word_ends]
        left = np.repeat(ends, np.diff(np.concatenate(([0], word_ends)))) - at
        depth = min(self.depth, int(left.max(initial=1)))
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(depth, np.uint8))), depth)[at]
        rows[np.arange(depth) >= left[:, None]] = 0
        suffixes = rows.view(f"S{depth}").ravel()
        pieces, low, high = self._bounds(depth)
        order = np.argsort(suffixes)
        ordered = suffixes[order]
        lo, hi = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "right")
        count = hi - lo
        hit = np.repeat(pieces, count)
        where = order[np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        edges = np.sort(where.astype(np.int64) << 32 | hit)  # by position
        where, hit = edges >> 32, edges & 0xFFFFFFFF
        rank[where, self.piece_chars[hit]] = self.rank[hit]

    def _bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of at most ``depth`` bytes, and the first and last text of so many bytes that begins with each."""
        if depth not in self.bounds:
            some = np.flatnonzero(self.raw_bytes <= depth)
            low = self.raw[some].astype(f"S{depth}")
            high = np.where(np.arange(depth) < self.raw_bytes[some][:, None], np.ascontiguousarray(low).view(np.uint8).reshape(-1, depth), 255).astype(np.uint8)
            self.bounds[depth] = some, low, high.view(f"S{depth}").ravel()
        return self.bounds[depth]

    def relax(self, first: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the tokens of words that begin at ``first``: each round merges one pair in every word."""
        n = int(first[-1])
        start, length = np.arange(n), np.ones(n, np.int64)
        word = np.repeat(np.arange(len(first) - 1), np.diff(first))
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def value(i: np.ndarray) -> np.ndarray:
            j = np.minimum(i + 1, len(start) - 1)
            both = length[i] + length[j]
            fits = (j > i) & (word[i] == word[j]) & (both <= self.width)
            return np.where(fits, rank[start[i], np.minimum(both, self.width)], _NONE)

        r = value(np.arange(n))
        while len(start):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(r, heads)
            sizes = np.diff(np.append(heads, len(start)))
            over = np.repeat(best == _NONE, sizes)
            if over.any():
                done.append((start[over], length[over]))
                start, length, word, r = start[~over], length[~over], word[~over], r[~over]
                if not len(start):
                    break
                sizes, best = sizes[best != _NONE], best[best != _NONE]
            hits = np.flatnonzero(r == np.repeat(best, sizes))
            hits = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))]
            length[hits] += length[hits + 1]
            keep = np.ones(len(start), bool)
            keep[hits + 1] = False
            start, length, word, r = start[keep], length[keep], word[keep], r[keep]
            hits -= np.arange(len(hits))
            r[hits] = value(hits)
            before = hits[hits > 0] - 1
            r[before] = value(before)
        if not done:
            return start, length
        start, length = np.concatenate([s for s, _ in done]), np.concatenate([x for _, x in done])
        by = np.argsort(start, kind="stable")
        return start[by], length[by]

    def relax_long(self, lo: int, hi: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word, by a heap; a link or two and a length for each character."""
        n = hi - lo
        length, prev, after = array("i", [1]) * n, array("i", range(-1, n - 1)), array("i", [*range(1, n), -1])
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (both := length[i] + length[j]) <= self.width and (r := int(rank[lo + i, both])) != _NONE:
                heapq.heappush(heap, (r, i, both))

        two = rank[lo : hi - 1, 2]
        heap += zip(two[two != _NONE].tolist(), np.flatnonzero(two != _NONE).tolist(), repeat(2))
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not length[i] or j < 0 or length[i] + length[j] != both:
                continue
            length[i], length[j], after[i] = both, 0, after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            offer(prev[i])
            offer(i)
        lengths = np.frombuffer(length, np.int32).astype(np.int64)
        start = np.flatnonzero(lengths)
        return lo + start, lengths[start]

    def learn(self, words: list[str]) -> None:
        """Ids of new words into the memo."""
        lo = 0
        while lo < len(words):
            hi, chars = lo, 0
            while hi < len(words) and (hi == lo or chars + len(words[hi]) <= INDEX_CHARS):
                chars, hi = chars + len(words[hi]), hi + 1
            part = words[lo:hi]
            first, rank = self.edges(part)
            if max(map(len, part)) < LONG_WORD:
                start, length = self.relax(first, rank)
            else:
                found = [self.relax_long(a, b, rank) if b - a >= LONG_WORD else self.relax(np.array([0, b - a]), rank[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                found = [(s + (0 if b - a >= LONG_WORD else a), x) for (s, x), a, b in zip(found, first[:-1], first[1:], strict=True)]
                start, length = np.concatenate([s for s, _ in found]), np.concatenate([x for _, x in found])
            name = rank[start, length].astype(np.int64) * (self.width + 1) + length
            place = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            token = np.where(self.names[place] == name, self.named[place], -1)
            cuts = np.searchsorted(start, first)
            unknown = np.flatnonzero(token < 0)
            flat = token.astype("<u4").tobytes()
            odd = set((np.searchsorted(cuts, unknown, "right") - 1).tolist())
            for w, text in enumerate(part):
                a, b = int(cuts[w]), int(cuts[w + 1])
                if w not in odd:
                    self.memo[text] = flat[4 * a : 4 * b]
                    continue
                out = []
                for i in range(a, b):
                    if token[i] >= 0:
                        out.append(int(token[i]))
                    else:
                        out += self.byte_ids[list(text[int(start[i] - first[w])].encode())].tolist()
                self.memo[text] = struct.pack(f"<{len(out)}I", *out)
            lo = hi

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [_WORD.findall(t) for t in self.model.normalize(texts)]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new: set[str] = set()
        for words in split:
            new.update(words)
        self.learn(sorted(new.difference(self.memo), key=len))
        out = [b"".join(map(self.memo.__getitem__, words)) for words in split]
        for w in new:
            if len(w) >= LONG_WORD:  # seldom met again
                self.memo.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        """The text: pieces and bytes in turn, space marks as spaces, without the one that encoding puts first."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(_SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` of every whole text; ``ids`` are little-endian 32-bit numbers.

    Null text counts as empty and has no ids. No shuffle; rows that repeat are encoded alike. A space mark
    (U+2581) inside a text decodes to a space, as with the model itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model)
        for batch in batches:
            texts, at = batch.column("t"), 0
            while at < len(texts):
                part, chars = [], 0
                while at + len(part) < len(texts) and (not part or chars <= BATCH_CHARS):
                    part.append(texts[at + len(part)].as_py())
                    chars += len(part[-1])
                ids = known.encode(part)
                columns = batch.column("id").slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([known.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "n_tokens", "ids", "decoded"])
                at += len(part)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(freed(run), _OUT).withColumnRenamed("id", id_col)
