"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word borders) and itself,
hashed into buckets; each bucket has an embedding, a window of words has the
mean of its embeddings, and a linear softmax over the mean gives two classes.
Embeddings and softmax are trained jointly in numpy by AdaGrad.  A document is
as toxic as its most toxic window (multiple-instance learning: the windows that
stand for a document are chosen anew by the model after each round), and a
logistic fit of the training documents' highest windows makes the score.  A
mean over all of a long document's words would drown its few toxic ones.

As the softmax is linear, a bucket's part in a window's logit is one number, so
scoring a word sums the numbers of its buckets.

The model is fitted on a bounded sample: of either class the ``MAX_TRAIN``
labelled documents with the smallest hash of their id, among those that are not
held out and have at most ``MAX_TRAIN_CHARS`` characters.  Every document is
scored whole.

Defined results: a null, empty or blank text gets the score of a document of
average harmlessness; null labels are left out, and so are contradictory ones
for the same id; repeated rows are repeated; without both classes among the
labels every score is 0; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.subwords import blocks

MAX_TRAIN = 2_000
MAX_TRAIN_CHARS = 10_000
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 4
THRESHOLD = 0.7
ROUNDS = 4
EPOCHS = 3
SEED = 7
MEMO = 400_000


def held_out(id_col: str):
    """Whether crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner): the hashed n-grams of all words, and the word that each belongs to."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    limit = np.repeat(ends, sizes)
    mixed = (codes + np.uint64(0x9E37)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    buckets, owners = [], []
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        total = total[: max(0, len(codes) - n + 1)] * np.uint64(0x100000001B3) + mixed[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(np.arange(len(total)) + n <= limit[: len(total)])
            buckets.append(total[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            owners.append(owner[inside])
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed * (np.arange(len(codes), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes) + np.uint64(1)), dtype=np.uint64)])
    buckets.append(prefix[ends] - prefix[ends - sizes])
    owners.append(np.arange(len(words)))
    hashed = np.concatenate(buckets)
    hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashed >> np.uint64(64 - 18)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """part: each bucket's part in the logit; a, b: logistic fit of a document's highest window; blank: logit of no words."""

    part: np.ndarray
    bias: float
    a: float
    b: float
    blank: float

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * logits + self.b, -50, 50)))


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def window_logits(part: np.ndarray, number: np.ndarray, sizes: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(logit of the window that starts at each word, first word of each document) for concatenated documents."""
    ends = np.cumsum(sizes)
    stop = np.minimum(np.arange(len(part)) + WINDOW, np.repeat(ends, sizes))
    sums, counts = np.concatenate([[0.0], np.cumsum(part)]), np.concatenate([[0], np.cumsum(number)])
    begin = np.arange(len(part))
    return (sums[stop] - sums[begin]) / np.maximum(counts[stop] - counts[begin], 1) + bias, ends - sizes


def train(texts: list[str], toxic: np.ndarray) -> Model | None:
    """Fit a model, or None without both classes."""
    toxic = np.asarray(toxic, np.int64)
    vocabulary: dict[str, int] = {}
    flat, sizes, keep = array("i"), [], []
    for i, text in enumerate(texts):
        words = split_words(text)
        if words:
            keep.append(i)
            sizes.append(len(words))
            flat.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    toxic = toxic[keep]
    if len(set(toxic.tolist())) < 2:
        return None
    flat, sizes = np.frombuffer(flat, np.int32), np.array(sizes, np.int64)
    first, doc_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    words = list(vocabulary)
    bucket, number = [], []
    for at in range(0, len(words), 10_000):  # a part at a time, for the driver's memory
        found, owner = word_features(words[at : at + 10_000])
        bucket.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        number.append(np.bincount(owner))
    del words, vocabulary
    bucket, number = np.concatenate(bucket), np.concatenate(number)
    begin = np.cumsum(number) - number

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = number[words]
        at = np.arange(int(n.sum())) + np.repeat(begin[words] - (np.cumsum(n) - n), n)
        return bucket[at], n

    def highest(part: np.ndarray, bias: float, top: int) -> np.ndarray:
        """The first words of each document's ``top`` highest windows that don't overlap."""
        per_word = np.add.reduceat(part[bucket], begin)
        logits, _ = window_logits(per_word[flat], number[flat], sizes, bias)
        chosen = []
        for _ in range(top):
            best = np.lexsort((logits, doc_of))[np.cumsum(sizes) - 1]
            chosen.append(best[np.isfinite(logits[best])])
            for d in range(1 - WINDOW, WINDOW):
                at = best + d
                ok = (at >= first) & (at < first + sizes)
                logits[at[ok]] = -np.inf
        return np.concatenate(chosen)

    # Which windows stand for a document at first: by the log-odds of documents that hold a bucket.
    seen, totals = np.zeros((2, BUCKETS)), np.bincount(toxic, minlength=2)
    for own, low, size in zip(toxic.tolist(), first.tolist(), sizes.tolist(), strict=True):
        seen[own, np.unique(spread(np.unique(flat[low : low + size]))[0])] += 1
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))

    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    base = np.zeros(2, np.float32)
    past = [np.full_like(x, 1e-6) for x in (table, soft, base)]
    part, bias = odds, 0.0
    for step in range(ROUNDS):
        top = highest(part, bias, 3)
        positive = highest(part, bias, 1)
        positive = positive[toxic[doc_of[positive]] == 1]
        some = rng.integers(0, len(flat), 4 * len(sizes))
        negative = np.concatenate([top, some])
        negative = negative[toxic[doc_of[negative]] == 0]
        windows = np.concatenate([np.repeat(positive, max(1, len(negative) // max(1, len(positive)) // 2)), negative])
        label = np.concatenate([np.ones(len(windows) - len(negative), np.int64), np.zeros(len(negative), np.int64)])
        for _ in range(EPOCHS):
            mixed = rng.permutation(len(windows))
            for at in range(0, len(mixed), 256):
                own = mixed[at : at + 256]
                start = windows[own]
                stop = np.minimum(start + WINDOW, first[doc_of[start]] + sizes[doc_of[start]])
                span = stop - start
                words = flat[np.arange(int(span.sum())) + np.repeat(start - (np.cumsum(span) - span), span)]
                ids, n = spread(words)
                row = np.repeat(np.repeat(np.arange(len(own)), span), n)
                size = np.bincount(row, minlength=len(own)).astype(np.float32)[:, None]
                mean = np.add.reduceat(table[ids], np.searchsorted(row, np.arange(len(own)))) / size
                logits = mean @ soft + base
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), label[own]] -= 1
                p /= len(own)
                back = (p @ soft.T / size)[row]
                used, place = np.unique(ids, return_inverse=True)
                grad = np.stack([np.bincount(place, back[:, k], len(used)) for k in range(DIM)], 1)
                for value, total, g, at_rows in ((soft, past[1], mean.T @ p, slice(None)), (base, past[2], p.sum(0), slice(None)), (table, past[0], grad, used)):
                    total[at_rows] += g * g
                    value[at_rows] -= 0.3 * g / np.sqrt(total[at_rows])
        difference = soft[:, 1] - soft[:, 0]
        part, bias = (table @ difference).astype(np.float64), float(base[1] - base[0])
    per_word = np.add.reduceat(part[bucket], begin)
    logits, begins = window_logits(per_word[flat], number[flat], sizes, bias)
    best = np.maximum.reduceat(logits, begins)
    a, b = _logistic(best, toxic)
    return Model(part.astype(np.float32), bias, a, b, float(best[toxic == 0].mean()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by penalised Newton steps."""
    scale = float(x.std()) or 1.0
    z = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    w, penalty = np.zeros(2), np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        w = w - np.linalg.solve(hessian, z.T @ (p - y) + penalty @ w)
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


class _Words(dict):
    """Word -> row of the arrays of summed parts and feature numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.parts, self.numbers = np.zeros(0), np.zeros(0, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO:
            self.forget()
        fresh = list(set(words).difference(self))
        if fresh:
            bucket, owner = word_features(fresh)
            self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
            self.parts = np.concatenate([self.parts, np.bincount(owner, self.model.part[bucket], len(fresh))])
            self.numbers = np.concatenate([self.numbers, np.bincount(owner, minlength=len(fresh))])
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def score_texts(model: Model | None, texts: list[str | None], memo: _Words | None) -> np.ndarray:
    """Scores of whole texts."""
    if model is None:
        return np.zeros(len(texts))
    docs = [split_words(t) for t in texts]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    full = np.flatnonzero(sizes)
    logits = np.full(len(docs), model.blank)
    if len(full):
        rows = memo.rows([w for d in docs for w in d])
        found, begins = window_logits(memo.parts[rows], memo.numbers[rows], sizes[full], model.bias)
        logits[full] = np.maximum.reduceat(found, begins)
    return model.score(logits)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on the bounded sample of labelled documents that are not held out."""
    label = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    label = label.agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("least = most").select("id", F.col("most").alias("toxic"))
    sized = docs.where(F.length(text_col) <= MAX_TRAIN_CHARS)
    known = sized.select(F.col(id_col).alias("id")).distinct()
    labelled = label.join(known, "id")
    sample = labelled.limit(0)
    for kind in (F.col("toxic") == 1, F.col("toxic") == 0):
        sample = sample.union(labelled.where(kind).orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN))
    # The sample has at most 2 * MAX_TRAIN rows of (id, label).
    rows = sized.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # Of an id with several texts, the smallest is taken, so the model is the same at every run.
    found = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    return train(found["text"].tolist(), found["toxic"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words(shared.value) if shared.value is not None else None
        for texts in batches:
            parts = [score_texts(shared.value, part, memo) for part in blocks(texts.tolist())]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = docs.withColumns({"held_out": held_out(id_col), "score": toxicity(F.col(text_col))})
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
