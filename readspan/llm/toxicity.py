"""Toxicity by averaged subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import freed, mix, seeded

_WORD = re.compile(r"\w+")
#: Words whose sums a task remembers before it starts anew.
MEMO_WORDS = 100_000
#: Characters of text that are scored, and words that are cut into n-grams at a time.
CHUNK_CHARS, CHUNK_WORDS = 500_000, 20_000


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled sample that training reads; texts are read whole there and in scoring.

    A bucket that fewer than ``least_docs`` sampled texts hold is not trained: it adds nothing to a score, though
    it counts in the average. The average runs over the n-grams of a text's different words and ``padding`` empty
    ones, so that neither a word said a hundred times nor a text of few words decides by itself. ``decay`` pulls trained rows towards zero. Small samples are passed more often, for ``least_steps`` mini-batches.
    """

    rows: int = 6000
    buckets: int = 1 << 18
    dim: int = 4
    shortest: int = 3
    longest: int = 6
    least_docs: int = 8
    padding: int = 300
    decay: float = 0.0
    epochs: int = 6
    least_steps: int = 700
    batch: int = 64
    rate: float = 1.5
    calibration: int = 5
    seed: int = 5


def words(text: str) -> list[str]:
    """The different words of a text, in order of their first place."""
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def subwords(ws: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word, its ends marked, and how many each has; a shorter word is one n-gram."""
    if not ws:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    chars = mix(np.frombuffer("".join(f"<{w}>" for w in ws).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(ws)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    begin = np.cumsum(size) - size
    factor = seeded(s.longest, 61) | np.uint64(1)
    total, found, of = np.zeros(len(chars), np.uint64), [], []
    for k in range(1, s.longest + 1):
        total[: max(len(chars) - k + 1, 0)] += chars[k - 1 :] * factor[k - 1]
        at = np.flatnonzero(left >= k) if k >= s.shortest else begin[size == k]
        found.append(mix(total[at] + np.uint64(k)) % np.uint64(s.buckets))
        of.append(owner[at])
    of_ = np.concatenate(of)
    by = np.argsort(of_, kind="stable")
    return np.concatenate(found)[by].astype(np.int32), np.bincount(of_, minlength=len(ws))


def _chunks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Some texts at a time, CHUNK_CHARS or one longer."""
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > CHUNK_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


@dataclass(frozen=True)
class Model:
    """The trained network folded for scoring: it is linear, so each bucket adds one number to the log-odds."""

    settings: Settings
    bucket_logit: np.ndarray
    bias: float

    def score(self, texts: Iterator[str], memo: dict[str, tuple[float, int]]) -> np.ndarray:
        """The score of each text; ``memo`` holds the sums of words met before."""
        out = []
        for part in _chunks(texts):
            split = [words(t) for t in part]
            new = {w for ws in split for w in ws if w not in memo}
            if new:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                    new = {w for ws in split for w in ws}
                flat, size = subwords(list(new), self.settings)
                sums = np.add.reduceat(self.bucket_logit[flat], np.cumsum(size) - size)
                memo.update(zip(new, zip(sums.tolist(), size.tolist(), strict=True), strict=True))
            for ws in split:
                total = n = 0
                for a, b in map(memo.__getitem__, ws):
                    total += a
                    n += b
                out.append(total / max(n + self.settings.padding, 1) + self.bias)
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -700, 700)))


class Vocabulary:
    """The different words of some texts and the buckets of each, in one flat array; texts are arrays of word numbers."""

    def __init__(self, texts: list[str], s: Settings):
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t in texts]
        every = list(number)
        parts = [subwords(every[lo : lo + CHUNK_WORDS], s) for lo in range(0, len(every), CHUNK_WORDS)]
        self.grams = np.concatenate([np.zeros(0, np.int64), *(size for _, size in parts)])
        self._set(np.concatenate([np.zeros(0, np.int32), *(flat for flat, _ in parts)]), self.grams)

    def _set(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.first = flat, np.concatenate(([0], np.cumsum(sizes)))

    def buckets(self, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some words, and for each the place of its word in ``ws``."""
        sizes = self.first[ws + 1] - self.first[ws]
        owner = np.repeat(np.arange(len(ws)), sizes)
        return self.flat[np.arange(len(owner)) + np.repeat(self.first[ws] - (np.cumsum(sizes) - sizes), sizes)], owner

    def keep(self, often: np.ndarray) -> None:
        """Only the buckets that ``often`` marks; ``grams`` still counts all."""
        some = often[self.flat]
        owner = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        self._set(self.flat[some], np.bincount(owner[some], minlength=len(self.grams)))


def train(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """A network trained on most rows; every ``calibration``-th row sets the bias instead.

    The bias is moved to the middle of the logits between which the cut makes the fewest errors on those rows; they
    say nothing if they are of one label.
    """
    apart = np.arange(len(texts)) % s.calibration == 0
    labels = np.asarray(labels, dtype=np.int64)
    model = fit_network([t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart], s)
    y = labels[apart]
    if not len(y) or y.min() == y.max():
        return model
    p = np.clip(model.score((t for t, a in zip(texts, apart, strict=True) if a), {}), 1e-300, 1 - 1e-16)
    logit = np.log(p / (1 - p))
    by = np.argsort(logit, kind="stable")
    logit, y = logit[by], y[by]
    errors = np.concatenate(([0], np.cumsum(y))) + (len(y) - y.sum()) - np.concatenate(([0], np.cumsum(1 - y)))
    best = np.flatnonzero(errors == errors.min())
    edge = np.concatenate(([logit[0] - 1], logit, [logit[-1] + 1]))
    cut = float(np.median([(edge[k] + edge[k + 1]) / 2 for k in best]))
    return Model(s, model.bucket_logit, model.bias - cut)


def fit_network(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """Embeddings and softmax together, by mini-batches with Adagrad. Without rows of both labels the score is the label's share.

    A text is kept as its different words and a word as its buckets, so memory goes with the vocabulary.
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = (labels.sum() + 1) / (len(labels) + 3)  # without any evidence nothing is toxic
    if not len(labels) or labels.min() == labels.max():
        return Model(s, np.zeros(s.buckets), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(s.seed)
    known, held = Vocabulary(texts, s), np.zeros(s.buckets, np.int32)
    for ws in known.texts:
        held[np.unique(known.buckets(ws)[0])] += 1
    weight = np.array([1 / max(int(known.grams[ws].sum()) + s.padding, 1) for ws in known.texts], np.float32)
    known.keep(held >= s.least_docs)
    table = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (s.dim, 2)).astype(np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    sum_table, sum_out, sum_bias = np.full(s.buckets, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    steps = -(-len(texts) // s.batch)
    for _ in range(max(s.epochs, -(-s.least_steps // steps))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), s.batch):
            batch = order[lo : lo + s.batch]
            y, size = labels[batch], np.array([len(known.texts[i]) for i in batch])
            ws, place = np.unique(np.concatenate([known.texts[i] for i in batch]), return_inverse=True)
            doc, share_of = np.repeat(np.arange(len(batch)), size), np.repeat(weight[batch], size)
            ids, owner = known.buckets(ws)
            at = np.flatnonzero(np.bincount(ids, minlength=s.buckets))
            word = np.stack([np.bincount(owner, table[ids, j], len(ws)) for j in range(s.dim)], 1)
            h = np.stack([np.bincount(doc, word[place, j] * share_of, len(batch)) for j in range(s.dim)], 1).astype(np.float32)
            logits = h @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            d_out, d_bias, d_h = h.T @ g, g.sum(0), g @ out.T
            d_word = np.stack([np.bincount(place, d_h[doc, j] * share_of, len(ws)) for j in range(s.dim)], 1)
            d_rows = np.stack([np.bincount(ids, d_word[owner, j], s.buckets)[at] for j in range(s.dim)], 1).astype(np.float32) + s.decay * table[at]
            sum_table[at] += (d_rows**2).mean(1)
            table[at] -= s.rate * d_rows / np.sqrt(sum_table[at])[:, None]
            sum_out += d_out**2
            out -= s.rate * d_out / np.sqrt(sum_out)
            sum_bias += d_bias**2
            bias -= s.rate * 0.1 * d_bias / np.sqrt(sum_bias)
    table[held < s.least_docs] = 0
    return Model(s, (table.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64)), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``settings.rows`` labelled rows that aren't held out, chosen by a hash of their id.

    The sample, whose size is bounded, is trained on in one task, so that the driver only gets one number a bucket.
    Rows without a label or text are left out; of rows that repeat an id the smallest text and the largest label count.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("i"))
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(settings.rows)
    )
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    sample = rows.where("t is not null").groupBy("i", "y").agg(F.min("t").alias("t")).repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        got = pd.concat(parts).sort_values("i") if parts else pd.DataFrame({"i": [], "y": [], "t": []})
        model = train(got["t"].tolist(), got["y"].to_numpy(), settings)
        yield pd.DataFrame({"logits": [model.bucket_logit.tobytes()], "bias": [model.bias]})

    made = sample.mapInPandas(freed(run), "logits binary, bias double").first()
    if made is None:  # an empty sample
        return train([], np.zeros(0, np.int64), settings)
    return Model(settings, np.frombuffer(made["logits"], np.float64), made["bias"])


def score_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score (0 to 1) of ``text_col`` as a column. Null and empty texts score as no words: the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[float, int]] = {}
        for texts in batches:
            yield pd.Series(shared.value.score(("" if t is None else t for t in texts), memo))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return freed(run)(batches)

    return F.pandas_udf(score, "double")(F.col(text_col))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from whole texts alone; raises if ``docs`` has a column of that name."""
    if score_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"{score_col} is a column already; name another score_col")
    return docs.withColumn(score_col, score_of(docs, model, text_col))
