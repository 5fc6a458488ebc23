"""Toxicity by a factorization machine over hashed terms.

``score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` where
``x_i`` says whether hashed term ``i`` occurs in the text. Terms are the words,
their beginnings, and beginnings that occur twice or three times, so inflected
forms of one stem count together. The factors learn pairs, such as an insult
next to a group mention, that additive weights miss.
Terms are screened on the labelled sample, so that the many rare terms of a
long text add no noise to its score: a term is fitted if its association with
the label is significant, or if it is so among the texts that hold one of the
strongest such terms, as a group mention may be that is common in clean texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
HASH_BITS = 26
#: Lengths of the word beginnings that serve as terms.
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled documents that the model is fitted on, max_terms its size.

    A term must stand in min_docs of them and reach min_chi2 by itself, or next
    to one of the ``partners`` strongest terms.
    """

    max_rows: int = 10_000
    max_terms: int = 4_096
    min_docs: int = 8
    min_chi2: float = 30.0
    partners: int = 64
    rank: int = 8
    epochs: int = 20
    rate: float = 0.1
    l2: float = 1e-5
    batch: int = 256
    threshold: float = 0.7
    seed: int = 7


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted term hashes
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, found: np.ndarray) -> float:
        """The machine's output for the positions of a text's fitted terms."""
        v = self.v[found]
        s = v.sum(0)
        return float(self.bias + self.w[found].sum() + 0.5 * (s @ s - (v * v).sum()))


def _hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) >> (32 - HASH_BITS)


def hashed_terms(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased words and of their beginnings, by number of occurrences up to three."""
    words = Counter(WORD.findall(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    terms = list(words)
    terms += [f"{p}*" for p in stems]
    terms += [f"{p}**" for p, n in stems.items() if n > 1]
    terms += [f"{p}***" for p, n in stems.items() if n > 2]
    return np.unique(np.fromiter(map(_hashed, terms), np.int32, len(terms)))


class Scorer:
    """Scores texts; what each word adds is kept for up to ``cache_words`` words.

    A word adds the position of its own term and those of its beginnings that
    have a fitted term; most words add nothing.
    """

    def __init__(self, model: Model, cache_words: int = 200_000):
        self.model, self.cache_words = model, cache_words
        self.at = {int(t): i for i, t in enumerate(model.terms)}
        self.words: dict[str, tuple] = {}
        self.stems: dict[str, tuple] = {}

    def learn(self, word: str) -> tuple:
        stems = []
        for k in STEMS:
            if len(word) > k:
                p = word[:k]
                if p not in self.stems:
                    self.stems[p] = tuple(self.at.get(_hashed(p + stars), -1) for stars in ("*", "**", "***"))
                if max(self.stems[p]) >= 0:
                    stems.append(p)
        own = self.at.get(_hashed(word), -1)
        return (own, stems) if own >= 0 or stems else ()

    def found(self, text: str) -> np.ndarray:
        """Sorted positions of the text's fitted terms: those of ``hashed_terms`` that the model has."""
        if len(self.words) > self.cache_words:
            self.words, self.stems = {}, {}
        words, known = Counter(WORD.findall(text.lower())), self.words
        positions: set[int] = set()
        stems: Counter = Counter()
        for w, n in words.items():
            adds = known.get(w)
            if adds is None:
                adds = known[w] = self.learn(w)
            if adds:
                positions.add(adds[0])
                for p in adds[1]:
                    stems[p] += n
        for p, n in stems.items():
            positions.update(self.stems[p][: min(n, 3)])
        positions.discard(-1)
        return np.array(sorted(positions), np.int64)

    def score(self, text: str) -> float:
        raw = min(max(self.model.raw(self.found(text)), -30.0), 30.0)
        return 1 / (1 + math.exp(-raw))


def _copies_once(rows: list[np.ndarray], bands: int = 4, minima: int = 14) -> np.ndarray:
    """Positions of rows that share no band of hash minima with an earlier row: near copies count once."""
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, (bands * minima, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen, first = set(), []
    for at, terms in enumerate(rows):
        mixed = terms.astype(np.uint64)
        least = (a * mixed + (a >> np.uint64(7))).min(1) if len(mixed) else a[:, 0]
        keys = {(band, least[band * minima : (band + 1) * minima].tobytes()) for band in range(bands)}
        if not keys & seen:
            first.append(at)
        seen |= keys
    return np.array(first, np.int64)


def _chi_squared(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that stand in ``min_docs`` rows or more, and how strongly the label depends on them."""
    if not len(rows) or y.min() == y.max():
        return np.zeros(0, np.int32), np.zeros(0)
    terms, n = np.unique(np.concatenate(rows), return_counts=True)
    often = n >= s.min_docs
    terms, n = terms[often], n[often].astype(float)
    positive, count = np.unique(np.concatenate([r for r, label in zip(rows, y) if label]), return_counts=True)
    n1 = np.zeros(len(terms))
    held = _positions(positive, terms)
    n1[np.isin(terms, positive)] = count[held]
    N, N1 = float(len(y)), float(y.sum())
    a, b, c, d = n1, n - n1, N1 - n1, N - N1 - n + n1
    return terms, N * (a * d - b * c) ** 2 / np.maximum(n * (N - n) * N1 * (N - N1), 1e-9)


def _significant(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> np.ndarray:
    """Sorted hashes whose occurrence depends on the label, alone or next to a partner; the strongest max_terms."""
    terms, chi2 = _chi_squared(rows, y, s)
    strength = dict(zip(terms[chi2 >= s.min_chi2].tolist(), chi2[chi2 >= s.min_chi2].tolist()))
    for partner in sorted(strength, key=lambda t: (-strength[t], t))[: s.partners]:
        holding = [i for i, r in enumerate(rows) if len(r) and r[min(np.searchsorted(r, partner), len(r) - 1)] == partner]
        terms, chi2 = _chi_squared([rows[i] for i in holding], y[holding], s)
        for t in np.flatnonzero(chi2 >= s.min_chi2):
            strength.setdefault(int(terms[t]), float(chi2[t]))
    return np.sort(np.array(sorted(strength, key=lambda t: (-strength[t], t))[: s.max_terms], np.int32))


def _positions(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(terms) or not len(hashes):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return at[terms[at] == hashes]


def fit(rows: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Adagrad on the logistic loss. No rows give the constant score 0.5, one class a constant score."""
    y = labels.astype(float)
    if len(rows):
        one = _copies_once(rows)
        rows, y = [rows[i] for i in one], y[one]
    terms = _significant(rows, y, s)
    rng = np.random.default_rng(s.seed)
    k = len(terms)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    bias, w, v = float(np.log(rate / (1 - rate))), np.zeros(k), rng.normal(0, 0.05, (k, s.rank))
    if not k:
        return Model(terms, bias, w, v)
    found = [_positions(terms, r) for r in rows]
    gw, gv, gb = np.full(k, 1e-6), np.full((k, s.rank), 1e-6), 1e-6
    for _ in range(s.epochs):
        order = rng.permutation(len(found))
        for start in range(0, len(order), s.batch):
            part = order[start : start + s.batch]
            sizes = np.fromiter((len(found[i]) for i in part), np.int64, len(part))
            flat = np.concatenate([found[i] for i in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            vf = v[flat]
            total = np.zeros((len(part), s.rank))
            np.add.at(total, doc, vf)
            square, linear = np.zeros(len(part)), np.zeros(len(part))
            np.add.at(square, doc, (vf * vf).sum(1))
            np.add.at(linear, doc, w[flat])
            raw = bias + linear + 0.5 * ((total * total).sum(1) - square)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            dw, dv = s.l2 * w, s.l2 * v
            np.add.at(dw, flat, err[doc])
            np.add.at(dv, flat, err[doc][:, None] * (total[doc] - vf))
            db = err.sum()
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= s.rate * dw / np.sqrt(gw)
            v -= s.rate * dv / np.sqrt(gv)
            bias -= s.rate * db / np.sqrt(gb)
    return Model(terms, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.max_rows`` labelled documents whose id meets ``usable``.

    Near copies among them count once, as a group of copies would make its own
    words significant: a row that shares a band of 14 hash minima with an
    earlier one is left out of the fit, never out of the scoring.
    The terms are hashed in tasks; the driver receives the hashes of that bounded sample alone.
    """
    sample = labelled_sample(docs, labels, label, usable, settings.max_rows, doc_id, text, settings.seed)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "terms": [hashed_terms(t).tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(terms, "id string, label int, terms binary").toPandas().sort_values("id", kind="stable")
    return fit([np.frombuffer(t, np.int32) for t in rows["terms"]], rows["label"].to_numpy(), settings)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null and empty texts have no terms and get the score of the bias; texts are
    read whole, however long. Every row is scored alone, so repeated rows repeat
    their score, and an empty table gives an empty table. Other columns pass
    through; columns named like the two results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_terms rows at most
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    scores = F.pandas_udf(run, "double")
    out = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("score", scores(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
