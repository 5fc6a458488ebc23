"""Quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its words, their character
n-grams and its word pairs, all found by hashing; a softmax over two classes
follows. numpy stochastic gradient descent fits vectors and softmax together.
The softmax is linear in the average, so for scoring every vector is reduced
once to its contribution to the log-odds: results are those of the full model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled documents that the model is fitted on."""

    max_rows: int = 4_000
    bits: int = 17
    gram_sizes: tuple[int, ...] = (3, 4)
    dim: int = 8
    epochs: int = 12
    rate: float = 0.5
    seed: int = 11
    cache_words: int = 200_000
    slice_chars: int = 1_000_000


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # 2**bits x dim
    softmax: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def contributions(self) -> np.ndarray:
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def word_features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of its character n-grams, word by word, and how many each word has."""
    mask = np.uint32((1 << s.bits) - 1)
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [own & mask], [np.arange(len(words))]
    for n in s.gram_sizes:
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint32)
        for i in range(n):
            h = h * np.uint32(16777619) ^ chars[i : len(chars) - n + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] >> np.uint32(32 - s.bits)) & mask)
        owners.append(owner[: len(h)][inside])
    flat, who = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return flat[order], np.bincount(who, minlength=len(words))


def pair_buckets(own: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of neighbouring word pairs; immediate repeats of a word share one bucket."""
    a, b = own[:-1].astype(np.uint32), own[1:].astype(np.uint32)
    h = (a * np.uint32(2654435761)) ^ (b * np.uint32(40503) + np.uint32(1))
    h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917)
    return np.where(a == b, 0, h >> np.uint32(32 - s.bits)).astype(np.int64)


def document_features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares, which sum to 1; empty for texts without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, at, count = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
    flat, sizes = word_features(list(distinct), s)
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in distinct), np.uint32, len(distinct))
    pairs = pair_buckets(own[at], s)
    buckets = np.concatenate([flat, pairs])
    weights = np.concatenate([np.repeat(count, sizes), np.ones(len(pairs), np.int64)])
    found, where = np.unique(buckets, return_inverse=True)
    share = np.bincount(where, weights=weights)
    return found, share / share.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate. No rows give the constant 0.5."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    softmax, bias = np.zeros((s.dim, 2)), np.zeros(2)
    steps = max(1, s.epochs * len(rows))
    for step in range(s.epochs * len(rows)):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        found, share = rows[order[step % len(rows)]]
        if not len(found):
            continue
        rate = s.rate * (1 - step / steps)
        mean = share @ vectors[found]
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[int(labels[order[step % len(rows)]])] -= 1
        back = softmax @ p
        softmax -= rate * np.outer(mean, p)
        bias -= 0.1 * rate * p
        vectors[found] -= (rate * np.minimum(share * len(share), 20.0)[:, None] * back / 20.0).astype(np.float32)
    return Model(vectors, softmax, bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.max_rows`` labelled documents whose id meets ``usable``; exact copies count once.

    Features are made in tasks; the driver receives those of the bounded sample alone.
    """
    sample = labelled_sample(docs, labels, label, usable, settings.max_rows, doc_id, text, settings.seed)
    once = sample.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [document_features(t, settings) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "found": [f.astype(np.int32).tobytes() for f, _ in made], "share": [x.astype(np.float32).tobytes() for _, x in made]})

    rows = once.mapInPandas(features, "id string, label int, found binary, share binary").toPandas().sort_values("id", kind="stable")
    made = [(np.frombuffer(f, np.int32), np.frombuffer(x, np.float32)) for f, x in zip(rows["found"], rows["share"])]
    return fit(made, rows["label"].to_numpy(), settings)


class Scorer:
    """Scores texts with the reduced model; sums of words already seen are kept for up to cache_words words."""

    def __init__(self, contributions: np.ndarray, bias: float, s: Settings):
        self.c, self.bias, self.s = contributions, bias, s
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.sums = self.sizes = np.zeros(0)
        self.own = np.zeros(0, np.uint32)

    def learn(self, new: list[str]):
        flat, sizes = word_features(new, self.s)
        sums = np.add.reduceat(self.c[flat], np.r_[0, np.cumsum(sizes)[:-1]])
        own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in new), np.uint32, len(new))
        self.sums, self.sizes, self.own = np.r_[self.sums, sums], np.r_[self.sizes, sizes], np.r_[self.own, own]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of a slice of texts."""
        if len(self.at) > self.s.cache_words:
            self.clear()
        known, lists = len(self.at), []
        for t in texts:
            at = self.at
            lists.append([at.setdefault(w, len(at)) for w in t.lower().split()])
        if len(self.at) > known:
            self.learn(list(self.at)[known:])
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int64, lengths.sum())
        doc = np.repeat(np.arange(len(lists)), lengths)
        total = np.bincount(doc, weights=self.sums[ids], minlength=len(lists))
        size = np.bincount(doc, weights=self.sizes[ids], minlength=len(lists))
        if len(ids) > 1:
            same = doc[:-1] == doc[1:]
            pairs = self.c[pair_buckets(self.own[ids], self.s)[same]]
            total += np.bincount(doc[:-1][same], weights=pairs, minlength=len(lists))
            size += np.bincount(doc[:-1][same], minlength=len(lists))
        raw = self.bias + np.divide(total, size, out=np.zeros(len(lists)), where=size > 0)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def sliced(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Whole texts in runs of about ``chars`` characters, so that what a run unpacks into stays small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, high for good quality) and ``predicted`` (1 if score >= threshold).

    Null and empty texts have no features and get the score of the bias; texts
    are read whole, however long. Every row is scored alone, so repeated rows
    repeat their score, and an empty table gives an empty table. Other columns
    pass through; columns named like the two results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.contributions(), float(model.bias[1] - model.bias[0])))  # 2**bits numbers
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value, settings)
        for batch in texts:
            parts = [scorer.scores(part) for part in sliced(list(batch), settings.slice_chars)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scores = F.pandas_udf(run, "double")
    out = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("score", scores(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
