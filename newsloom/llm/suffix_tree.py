"""Language-model scoring with a probabilistic suffix tree over words.

The root holds the smoothed unigram distribution. A context of up to ``depth``
words that the training texts hold ``min_count`` times is a candidate node; it
is retained if its next-word distribution diverges from that of its suffix: if
the training likelihood gained by it exceeds a BIC penalty. A node keeps the
next words that follow it ``min_count`` times, discounts them, and gives the
rest to its suffix. A token is scored in the state of the longest retained
suffix of its history. The floors are absolute, so the tree grows with the
corpus, and no task and no driver ever holds it whole.

Texts are cut into slices of whole documents, whose tokens are kept as numbers
of the slice's own word list; words under the floor share a number. What a slice must know of the corpus it asks by
key: its distinct words or word sequences, hashed to 64 bits, are dealt with
its own counts to parts by hash, a part adds up what all slices sent, and each
slice gets the sums of its keys back. A slice sends a key once, so a frequent
word weighs no more than a rare one. Level by level, only sequences whose two
shorter parts are frequent enough are asked for. What a node's test needs are
sums over its next words; every slice adds its share, and the part decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: The end of a text, and the history before its first word. No word holds a blank.
END = b"\n"
U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    depth: int = 2  # words of the longest context
    min_count: int = 2
    discount: float = 0.5
    slice_chars: int = 8_000_000
    spare_bits: int = 24  # two of the corpus's sequences share a key with a chance of 2 ** -spare_bits for each sequence
    part_keys: int = 2_000_000  # keys that meet in a part, on average


def _packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, those of equal weight together, compressed."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    planes = np.empty(flat.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        plane[:] = flat[:, i]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    flat = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        flat[:, i] = plane
    return flat.view(kind).ravel()


def _mixed(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    h = (a ^ (a >> U64(29))) * U64(0x9E3779B97F4A7C15) + (np.atleast_1d(np.asarray(b, U64)) ^ U64(salt)) * U64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> U64(32))) * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(29))


def _sliced(docs: DataFrame, kind: str, s: Settings) -> DataFrame:
    """(slice, learn, sizes, ids, words, n_learn, n_all, docs): runs of rows of ``docs`` (doc_id, text, learn), tokens as places in ``words``."""

    def cut(ids: pa.Array, texts: pa.Array, learn: pa.Array, number: int) -> pa.RecordBatch:
        texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.string()), "")  # copied: some kernels misread slices
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        coded = parts.flatten().dictionary_encode()
        words = [w.encode("utf-8", "replace") for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        at = coded.indices.to_numpy()
        real = at != words.index(b"") if b"" in words else np.ones(len(at), bool)  # blanks at an end of a text
        doc, at = doc[real], at[real]
        sizes = np.bincount(doc, minlength=len(texts)) + 1
        tokens = np.full(sizes.sum(), len(words))
        tokens[np.arange(len(at)) + doc] = at
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in [*words, END]], U64)
        # the most frequent words get the smallest numbers
        count = np.bincount(tokens, minlength=len(hashes))
        order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.arange(len(order))
        flags = learn.to_numpy(zero_copy_only=False).astype(np.uint8)
        row = {
            "slice": [number], "learn": [flags.tobytes()], "sizes": [_packed(sizes.astype("<i4"))], "ids": [_packed(rank[tokens].astype("<u4"))],
            "words": [hashes[order].tobytes()], "n_learn": [int(sizes[flags > 0].sum())], "n_all": [int(sizes.sum())],
        }
        columns = [pa.array(v, t) for v, t in zip(row.values(), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays([ids]))], [*row, "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = size = 0
            for stop, n in enumerate(lengths, 1):
                size += n
                if size >= s.slice_chars or stop == len(lengths):
                    yield cut(*(batch.column(i).slice(start, stop - start) for i in range(3)), number)
                    start, size, number = stop, 0, number + 1

    return docs.mapInArrow(run, f"slice long, learn binary, sizes binary, ids binary, words binary, n_learn long, n_all long, docs array<{kind}>")


COUNT, GAIN = 0, 1000  # kinds of questions: COUNT + level, GAIN + level


@dataclass(frozen=True)
class _Size:
    n_tokens: int  # of the training texts
    key_bits: int  # of a sequence's key; words keep all 64
    part_bits: int  # first bits of a key, which name its part

    def kept(self, kind: int) -> int:
        return 64 if kind == COUNT else self.key_bits

    def short(self, kind: int, key: np.ndarray) -> np.ndarray:
        return key >> U64(64 - self.kept(kind))

    def part(self, kind: int, short: np.ndarray) -> np.ndarray:
        return (short >> U64(self.kept(kind) - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(short), np.int64)


@dataclass
class _Level:
    """Distinct sequences of level + 1 words of a slice: sequence i is sequence ctx[i] of the level below, then the last word of suffix[i]."""

    at: np.ndarray  # the sequence that ends at each token, -1 where none may be frequent
    key: np.ndarray
    n: np.ndarray  # occurrences in the slice's training texts
    ctx: np.ndarray
    suffix: np.ndarray
    c: np.ndarray | None = None  # occurrences in all training texts


class _Slice:
    def __init__(self, row, size: _Size, n_distinct: int, s: Settings):
        self.s, self.size, self.N, self.V = s, size, size.n_tokens, n_distinct
        self.sizes = _unpacked(row.sizes, "<i4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(np.frombuffer(row.learn, np.uint8), self.sizes)
        tokens, key = _unpacked(row.ids, "<u4").astype(np.int64), np.frombuffer(row.words, U64)
        none = np.zeros(0, np.int64)
        self.levels = [_Level(tokens, key, np.bincount(tokens, weights=self.learn, minlength=len(key)).astype(np.int64), none, none)]
        if getattr(row, "counts", None) is not None:
            self.levels[0].c = _unpacked(row.counts, "<i8")
        self.end = tokens[-1]
        self.answers: dict[int, list] = {}
        for a in row.answers if getattr(row, "answers", None) is not None else ():
            self.answers.setdefault(a["kind"], []).append((a["part"], a["out"]))

    def answer(self, kind: int, key: np.ndarray, dtype: str) -> np.ndarray:
        """What the parts said of each key: parts hold ranges of keys, so their answers in order are those of the sorted keys."""
        out = np.empty(len(key), dtype)
        if len(key):
            out[np.argsort(self.size.short(kind, key))] = np.concatenate([_unpacked(blob, dtype) for _, blob in sorted(self.answers[kind], key=lambda x: x[0])])
        return out

    def questions(self, kind: int, key: np.ndarray, values: np.ndarray, total: np.ndarray) -> Iterator[tuple]:
        key = self.size.short(kind, key)
        order = np.argsort(key)  # sequences of equal keys may come in any order: their answers are equal
        key, values, total = key[order], values[order], total[order]
        part = self.size.part(kind, key)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(key) else part
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            yield kind, int(part[a]), _packed(np.diff(key[a:b], prepend=U64(0))), _packed(values[a:b].ravel()), _packed(total[a:b])

    def previous(self, level: int) -> np.ndarray:
        """The sequence of ``level`` that ends before each token; the end stands before a text's first word."""
        out = np.r_[-1, self.levels[level].at[:-1]]
        out[self.starts] = self.end if level == 0 else -1
        return out

    def counted(self, level: int):
        own = self.levels[level]
        if own.c is None:
            own.c = self.answer(COUNT + level, own.key, "<i8")

    def settled(self) -> tuple[bytes, bytes, bytes]:
        """(ids, words, counts) with one number for all words of each count under the floor, as no sequence holds them."""
        own, least = self.levels[0], self.s.min_count
        often = own.c >= least
        number = np.where(often, least + np.cumsum(often) - 1, own.c)
        words = np.r_[np.zeros(least, U64), own.key[often]]
        return _packed(number[own.at].astype("<u4")), words.tobytes(), _packed(np.r_[np.arange(least), own.c[often]].astype("<i8"))

    def ask_counts(self, level: int) -> Iterator[tuple]:
        own = self.levels[level]
        yield from self.questions(COUNT + level, own.key, own.n.astype("<i4"), np.zeros(len(own.key), "<i8"))

    def grow(self):
        """The next level: sequences whose first and last parts are both frequent enough."""
        below, level = self.levels[-1], len(self.levels)
        before = self.previous(level - 1)
        may = np.flatnonzero((before >= 0) & (below.at >= 0))
        may = may[(below.c[before[may]] >= self.s.min_count) & (below.c[below.at[may]] >= self.s.min_count)]
        size = max(len(below.key), 1)
        inverse, both = pd.factorize(before[may] * size + below.at[may])
        at = np.full(len(before), -1)
        at[may] = inverse
        ctx, suffix = both // size, both % size
        n = np.bincount(inverse, weights=self.learn[may], minlength=len(both)).astype(np.int64)
        self.levels.append(_Level(at, _mixed(below.key[ctx], below.key[suffix], level), n, ctx, suffix))

    def base(self) -> np.ndarray:
        return np.log10((self.levels[0].c + 0.5) / (self.N + 0.5 * (self.V + 1)))

    def contexts(self, level: int) -> np.ndarray:
        """The sequences below ``level`` that are frequent enough to be nodes and that a token follows."""
        before, below = self.previous(level - 1), self.levels[level - 1]
        seen = np.zeros(len(below.key), bool)
        seen[before[before >= 0]] = True
        return np.flatnonzero(seen & (below.c >= self.s.min_count))

    def own_log_p(self, level: int) -> np.ndarray:
        """Discounted log10 probability of each sequence's last word after the words before it; nan for rare ones."""
        own = self.levels[level]
        total = self.levels[level - 1].c[own.ctx]
        return np.log10(np.where(own.c >= self.s.min_count, own.c - self.s.discount, np.nan) / np.maximum(total, 1))

    def ask_gains(self, level: int, below: np.ndarray) -> Iterator[tuple]:
        """This slice's share of the sums that decide on the nodes; below: log10 P(last word | suffix) of each sequence below ``level``."""
        own, log_p, nodes = self.levels[level], self.own_log_p(level), self.contexts(level)
        kept = np.flatnonzero((own.c >= self.s.min_count) & (own.n > 0))
        share, c, q = own.n[kept] / own.c[kept], own.c[kept], below[own.suffix[kept]]
        place = np.searchsorted(nodes, own.ctx[kept])
        sums = [np.bincount(place, weights=share * x, minlength=len(nodes)) for x in (10.0**q, c * (log_p[kept] - q), c, np.ones(len(kept)))]
        key = _mixed(self.levels[level - 1].key[nodes], GAIN, GAIN + level)
        yield from self.questions(GAIN + level, key, np.stack(sums, 1).astype("<f4"), self.levels[level - 1].c[nodes].astype("<i8"))

    def alphas(self, level: int) -> np.ndarray:
        """log10 back-off weight of each sequence below ``level`` as a node; nan where it is not retained."""
        nodes = self.contexts(level)
        out = np.full(len(self.levels[level - 1].key), np.nan)
        out[nodes] = self.answer(GAIN + level, _mixed(self.levels[level - 1].key[nodes], GAIN, GAIN + level), "<f4")
        return out

    def log_p(self, level: int, below: np.ndarray) -> np.ndarray:
        """log10 P(last word | longest retained suffix up to this depth) of each sequence of ``level``, from that of the level below."""
        own, q = self.levels[level], below[self.levels[level].suffix]
        alpha, p = self.alphas(level)[own.ctx], self.own_log_p(level)
        return np.where(np.isnan(alpha), q, np.where(np.isnan(p), q + alpha, p))

    def scores(self) -> np.ndarray:
        out = self.base()[self.levels[0].at]
        for level in range(1, len(self.levels)):
            before, own = self.previous(level - 1), self.levels[level]
            alpha = np.r_[self.alphas(level), np.nan][before]
            p = np.r_[self.own_log_p(level), np.nan][own.at]
            out = np.where(np.isnan(alpha), out, np.where(np.isnan(p), out + alpha, p))
        return out


def _decided(total: np.ndarray, covered, gain, c, symbols, n_tokens: int, discount: float) -> np.ndarray:
    """log10 back-off weight of the nodes that pass the divergence test, nan for the others.

    c: occurrences of the kept next words, whose number is ``symbols``.
    """
    total = np.maximum(total, 1)
    alpha = np.log10(np.maximum((total - c + discount * symbols) / total, 1e-12) / np.maximum(1 - covered, 1e-12))
    gained = np.log(10) * (gain + (total - c) * alpha)
    good = (symbols > 0.5) & (covered < 1 - 1e-6) & (gained > 0.5 * np.round(symbols) * np.log(max(n_tokens, 2)))
    return np.where(good, alpha, np.nan)


def _answered(asked: DataFrame, n_tokens: int, discount: float) -> DataFrame:
    """(slice, kind, part, out, n_distinct): for each question the sums, or the node decisions, of its keys."""

    def decide(kind: int, group: list[tuple]) -> pd.DataFrame:
        keys = [np.cumsum(_unpacked(g[3], "<u8"), dtype=U64) for g in group]
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        if kind < GAIN:
            out = np.bincount(inverse, weights=np.concatenate([_unpacked(g[4], "<i4") for g in group])).astype("<i8")
            known = int((out > 0).sum())
        else:
            values = np.concatenate([_unpacked(g[4], "<f4").reshape(-1, 4) for g in group]).astype(float)
            total = np.concatenate([_unpacked(g[5], "<i8") for g in group])[first]
            out, known = _decided(total, *(np.bincount(inverse, weights=v) for v in values.T), n_tokens, discount).astype("<f4"), 0
        parts = np.split(out[inverse], np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"slice": [g[0] for g in group], "kind": kind, "part": group[0][2], "out": [_packed(p) for p in parts], "n_distinct": [known] + [0] * (len(group) - 1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if group and row[1:3] != group[0][1:3]:
                    yield decide(group[0][1], group)
                    group = []
                group.append(row)
        if group:
            yield decide(group[0][1], group)

    dealt = asked.repartition("kind", "part").sortWithinPartitions("kind", "part", "slice")
    return dealt.mapInPandas(run, "slice long, kind int, part long, out binary, n_distinct long")


def score(docs: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row per row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score, by a tree of the rows that meet ``learn`` (null: all).

    Scores are log10 probabilities of the whole text; texts are read whole,
    however long. Null and empty texts hold the end token alone. Every row
    counts and is scored alone, so repeated and null ids are no special case.
    Columns of other names are ignored; an empty table gives an empty table,
    and without training rows every token gets the unigram smoothing.
    """
    s, kind = settings, dict(docs.dtypes)[doc_id]
    flag = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    slices = stored(_sliced(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), flag.alias("learn")), kind, s))
    n_tokens, n_all, n_bytes = (int(x or 0) for x in slices.agg(F.sum("n_learn"), F.sum("n_all"), F.sum(F.length("words"))).first())
    part_bits = max(0, int(np.ceil(np.log2(max(1, 3 * n_bytes / 8 / s.part_keys)))))
    size = _Size(n_tokens, max(part_bits, min(64, int(np.ceil(np.log2(max(2, s.depth * n_all)))) + s.spare_bits)), part_bits)
    answers: list[DataFrame] = []
    n_distinct = 0

    def read(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
        for i in range(len(batch)):
            yield i, SimpleNamespace(**{name: batch.column(name)[i].as_py() for name in names})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield row, _Slice(row, size, n_distinct, s)

    def asked(level: int):
        """Questions once the counts of levels below ``level`` are known: counts of this level, decisions on the nodes two levels down."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row, x in opened(batches):
                found, q = [], None
                for done in range(level):
                    x.counted(done)
                    if done:
                        q = x.log_p(done - 1, q) if done > 1 else x.base()
                    if done < level - 1 or level <= s.depth:
                        x.grow()
                if level <= s.depth:
                    found += x.ask_counts(level)
                if level > 1:
                    found += x.ask_gains(level - 1, q)
                yield pd.DataFrame([(row.slice, *f) for f in found], columns=["slice", "kind", "part", "keys", "values", "total"])

        return run

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, x in opened(batches):
            yield pd.DataFrame([(row.slice, *f) for f in x.ask_counts(0)], columns=["slice", "kind", "part", "keys", "values", "total"])

    def told() -> DataFrame:
        """Slices with the answers so far."""
        every = answers[0]
        for a in answers[1:]:
            every = every.unionByName(a)
        per_slice = every.groupBy("slice").agg(F.collect_list(F.struct("kind", "part", "out")).alias("answers"))
        return slices.join(per_slice, "slice", "left")  # a slice may have had nothing to ask

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in read(batch, "learn", "sizes", "ids", "words", "answers"):
                x = _Slice(row, size, 0, s)
                x.counted(0)
                new = [pa.array([v], pa.binary()) for v in (row.learn, row.sizes, *x.settled())]
                yield pa.RecordBatch.from_arrays([batch.column("slice").slice(i, 1), *new, batch.column("docs").slice(i, 1)], ["slice", "learn", "sizes", "ids", "words", "counts", "docs"])

    schema = "slice long, kind int, part long, keys binary, values binary, total binary"
    answers.append(stored(_answered(slices.drop("docs").mapInPandas(first, schema), n_tokens, s.discount)))
    n_distinct = int(answers[0].agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0])
    whole = slices
    slices = stored(told().mapInArrow(settle, f"slice long, learn binary, sizes binary, ids binary, words binary, counts binary, docs array<{kind}>"))
    drop_stored(whole, *answers)
    answers.clear()
    for level in range(1, s.depth + 2):
        source = told() if answers else slices
        answers.append(stored(_answered(source.drop("docs").mapInPandas(asked(level), schema), n_tokens, s.discount)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in read(batch, "learn", "sizes", "ids", "words", "counts", "answers"):
                x = _Slice(row, size, n_distinct, s)
                for level in range(s.depth + 1):
                    x.counted(level)
                    if level < s.depth:
                        x.grow()
                words = x.levels[0].at
                sums = [np.add.reduceat(v, x.starts) for v in ((x.levels[0].c > 0)[words].astype(np.int64), x.base()[words], x.scores())]
                columns = [batch.column("docs")[i].values, x.sizes, sums[0], np.full(len(x.sizes), n_tokens), sums[1], sums[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = stored(told().mapInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    drop_stored(slices, *answers)
    return out.withColumnRenamed("doc_id", doc_id)
