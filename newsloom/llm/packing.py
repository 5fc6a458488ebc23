"""Lexical retrieval packing of documents into token sequences.

Documents are encoded in tasks and routed by content into shards: their BM25
vectors, weighted with the corpus's document frequencies, are projected to few
dimensions and descend a tree of splits that a sample of the corpus gave, so
that a shard holds related documents at any corpus size. Each shard holds a
BM25 inverted index over the token ids of its whole documents. Every seed
document queries the index with all its terms; the unused neighbours that it
returns fill the seed's window greedily, the last one cut where the window
ends. Runs of a document that fill a window alone become sequences of their own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    end_id: int = 1
    shard_ids: int = 500_000  # ids after which a shard is closed
    k1: float = 1.2
    b: float = 0.75
    least_cut: int = 1  # a window with fewer free places is padded rather than filled with a fragment
    cache_pieces: int = 600_000
    slice_chars: int = 4_000_000
    slice_ids: int = 2_000_000
    dims: int = 128  # of the projection that routes documents
    sample: int = 40_000  # documents that the routing tree is made from
    seed: int = 7


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks of these characters need no normalization and fall into these pieces; all others go through the whole tokenizer.
SIMPLE = r"[\x21-\x26\x28-\x3b\x3d-\x40\x5b-\x7eß-öø-ÿ]+"
PIECE = r"([a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
WORD_END = "</w>"


def _byte_letters() -> dict[int, int]:
    """What byte-level models write for each byte: printable Latin-1 stands for itself, the rest for letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return dict(zip(own, own)) | {b: 256 + i for i, b in enumerate(rest)}


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat((starts - (ends - sizes)).astype(np.int64), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ChunkEncoder:
    """Token ids of texts for a tokenizer whose pre-tokenizer never joins text across ASCII blanks.

    A text's ids are then those of its blank-separated chunks in order. Chunks
    of simple characters fall into the pre-tokenizer's pieces, whose ids the
    tokenizer's model gives; other chunks go whole through the tokenizer. Ids
    of known pieces are kept; when there are more than ``cache_pieces``, those
    seen once go. The special tokens' strings count as the tokenizer takes them
    by default: as the special ids.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str, s: Settings):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.s, self.letters = s, _byte_letters()
        upper = "THE Quick NEWS"
        self.folds = self.ids_of(self.tokenizer, [upper]) == self.ids_of(self.tokenizer, [upper.lower()])  # then A-Z may be lowered first, for fewer chunks
        self.special = "|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = self.ids_of(self.tokenizer, [self.SEPARATOR])[0]
        self.clear()
        self.simple = True
        self.simple = self.folds and self.pieces_agree()
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.starts, self.sizes, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def ids_of(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces_agree(self) -> bool:
        """Whether pieces get the whole tokenizer's ids, on a probe of every simple character."""
        single = [chr(c) for c in range(33, 256) if re.fullmatch(SIMPLE, chr(c))]
        probe = single + ["".join(single), "news", "the", "3rd", "ends.", "(a-b)", "año", "straße,", "12:30", "__x__", "~!@#"]
        ids, sizes = self.encode(pa.array(probe))
        want = self.ids_of(self.tokenizer, probe)
        return [len(x) for x in want] == sizes.tolist() and [i for x in want for i in x] == ids.tolist()

    def forget(self):
        """Keep the pieces seen more than once, or none if those are too many themselves."""
        keep = np.flatnonzero(self.seen > 1)
        keep = keep if len(keep) < self.s.cache_pieces * 3 // 4 else keep[:0]
        words = list(self.at)
        self.at = {words[i]: n for n, i in enumerate(keep.tolist())}
        sizes = self.sizes[keep]
        self.flat = _gathered(self.flat, self.starts[keep], sizes)
        self.starts, self.sizes, self.seen = np.cumsum(sizes) - sizes, sizes, np.ones(len(keep), np.int64)

    def learn(self, new: list[str]):
        plain = pc.match_substring_regex(pa.array(new, pa.string()), f"^{SIMPLE}$").to_pylist() if self.simple else [False] * len(new)
        quick = [i for i, yes in enumerate(plain) if yes]
        found, order = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        written = [new[i] if new[i].isascii() else new[i].encode().decode("latin-1").translate(self.letters) for i in quick]
        for ids in self.ids_of(self.model, [" ".join(written[i : i + 2000]) for i in range(0, len(written), 2000)]):
            found.append(np.array(ids, np.uint32))
        lengths = [np.diff(np.r_[-1, np.flatnonzero(self.ends[np.concatenate(found).astype(np.int64)])])]
        order.append(np.array(quick, np.int64))
        rest = [i for i, yes in enumerate(plain) if not yes]
        apart = len(self.mark) != 1
        odd = [i for i in rest if apart or self.SEPARATOR in new[i]]
        joined = [i for i in rest if not (apart or self.SEPARATOR in new[i])]
        for ids in self.ids_of(self.tokenizer, [new[i] for i in odd]):
            found.append(np.array(ids, np.uint32))
            lengths.append(np.array([len(ids)]))
        parts = [joined[i : i + 500] for i in range(0, len(joined), 500)]
        for ids in self.ids_of(self.tokenizer, [f" {self.SEPARATOR} ".join(new[i] for i in part) for part in parts]):
            ids = np.array(ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            found.append(np.delete(ids, cuts))
            lengths.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
        sizes = np.concatenate(lengths).astype(np.int64)
        back = np.argsort(np.concatenate([*order, np.array(odd + joined, np.int64)]), kind="stable")
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.r_[self.starts, starts[back]], np.r_[self.sizes, sizes[back]]
        self.seen = np.r_[self.seen, np.zeros(len(new), np.int64)]
        self.flat = np.concatenate([self.flat, *found])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts without end ids, and each text's number of ids; null texts have none."""
        texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.string()), "")  # copied: some kernels misread slices
        if not self.folds:
            return self.encode_as_is(texts)
        lowered = pc.ascii_lower(texts)
        if not self.special or not pc.any(pc.match_substring_regex(lowered, self.special)).as_py():
            return self.encode_as_is(lowered)
        # the strings of special tokens are told from their upper-case forms, so texts that hold one keep their case
        special = pc.match_substring_regex(lowered, self.special)
        order = np.argsort(special.to_numpy(zero_copy_only=False), kind="stable")
        both = [self.encode_as_is(lowered.filter(pc.invert(special))), self.encode_as_is(texts.filter(special))]
        sizes = np.concatenate([z for _, z in both])
        starts, back = np.cumsum(sizes) - sizes, np.argsort(order, kind="stable")
        return _gathered(np.concatenate([i for i, _ in both]), starts[back], sizes[back]), sizes[back]

    def encode_as_is(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > self.s.cache_pieces:
            self.forget()
        chunks = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary
        if self.simple:
            plain = pc.match_substring_regex(distinct, f"^{SIMPLE}$")
            distinct = pc.if_else(plain, pc.replace_substring_regex(distinct, PIECE, r"\1 "), distinct)
        # an empty chunk and the end of a cut one give an empty piece, which has no ids
        pieces = pc.ascii_split_whitespace(distinct)
        per_chunk = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = pieces.flatten().dictionary_encode()
        at, known = self.at, len(self.at)
        own = np.fromiter((at.setdefault(p, len(at)) for p in pieces.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(pieces.dictionary))
        if len(at) > known:
            self.learn(list(at)[known:])
        piece = own[pieces.indices.to_numpy()]
        self.seen[own] += 1 + (np.bincount(pieces.indices.to_numpy(), minlength=len(own)) > 1)
        sizes = self.sizes[piece]
        flat = _gathered(self.flat, self.starts[piece], sizes)
        sizes = np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(per_chunk)]])
        starts, chunk = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        sizes = sizes[chunk]
        ids = _gathered(flat, starts[chunk], sizes)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]])


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def shared_encoder(path: str, s: Settings) -> ChunkEncoder:
    """One encoder per worker process, so that what it knows serves the worker's later tasks."""
    if (path, s) not in _ENCODERS:
        _ENCODERS[path, s] = ChunkEncoder(path, s)
    return _ENCODERS[path, s]


def narrowest(path: str) -> str:
    """The least little-endian type that holds every id of a tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows whose sizes sum to about ``most``."""
    start, total = 0, 0
    for stop, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, stop
            start, total = stop, 0
    if start < len(sizes):
        yield start, len(sizes)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, settings: Settings = Settings(), kind_of_id: str = "<u4") -> DataFrame:
    """(doc_id, ids binary): ids as numpy type ``kind_of_id``, the end id last; null texts count as empty."""
    path, s = tokenizer or default_tokenizer(), settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, s)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for start, stop in _runs(lengths, s.slice_chars):
                ids, sizes = encoder.encode(batch.column(1).slice(start, stop - start))
                ends = np.cumsum(sizes + 1)
                out = np.full(ends[-1], s.end_id, kind_of_id)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                blob, width = out.tobytes(), out.itemsize
                cuts = np.r_[0, ends] * width
                blobs = pa.array([blob[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), blobs], ["doc_id", "ids"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of every distinct term of each document, in that order."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    key = (np.repeat(np.arange(len(docs)), sizes) << 32) | np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    key.sort(kind="stable")
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(key)])


def _sliced(blobs, kind_of_id: str, most: int) -> Iterator[list[np.ndarray]]:
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(kind_of_id).itemsize
    for start, stop in _runs(sizes, most):
        yield [np.frombuffer(b, kind_of_id) for b in blobs[start:stop]]


def document_frequencies(ids: DataFrame, kind_of_id: str, s: Settings = Settings()) -> np.ndarray:
    """Number of documents of the corpus that hold each token id; as long as the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for part in _sliced(batch["ids"].array, kind_of_id, s.slice_ids):
                more = np.bincount(term_counts(part)[1], minlength=len(df))
                more[: len(df)] += df
                df = more
        terms = np.flatnonzero(df)
        yield pd.DataFrame({"term": terms, "df": df[terms]})

    found = ids.select("ids").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(int(found["term"].max()) + 1 if len(found) else 1, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def projected(docs: list[np.ndarray], df: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Unit vectors: the documents' weighted terms, each added to or taken from one of ``s.dims`` places."""
    rng = np.random.default_rng(s.seed)
    place, sign = rng.integers(0, s.dims, len(df)), rng.choice([-1.0, 1.0], len(df))
    doc, term, tf = term_counts(docs)
    weight = _idf(df, n)[term] * tf * (s.k1 + 1) / (tf + s.k1) * sign[term]
    x = np.bincount(doc * s.dims + place[term], weights=weight, minlength=len(docs) * s.dims).reshape(len(docs), s.dims)
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


@dataclass
class Routes:
    """Binary tree: node i sends x @ axis[i] > cut[i] to high[i], else to low[i]; a negative child -k - 1 is leaf k."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1)
        while (at >= 0).any():
            rows = np.flatnonzero(at >= 0)
            node = at[rows]
            above = np.einsum("ij,ij->i", x[rows], self.axis[node]) > self.cut[node]
            at[rows] = np.where(above, self.high[node], self.low[node])
        return -at - 1


def routes(x: np.ndarray, leaf: float, s: Settings) -> Routes:
    """Splits of a sample between two means, or at the median where those are lopsided, down to ``leaf`` documents."""
    rng = np.random.default_rng(s.seed)
    axis, cut, low, high, leaves = [], [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        own = x[rows]
        if len(rows) > 1.5 * leaf and len(rows) > 2:
            a = own[rng.integers(len(rows))]
            b = own[np.argmin(own @ a)]
            for _ in range(6):
                side = own @ (b - a) > (b @ b - a @ a) / 2
                if side.all() or not side.any():
                    break
                a, b = own[~side].mean(0), own[side].mean(0)
            line = b - a
            at = own @ line
            where = float(b @ b - a @ a) / 2
            if not 0.2 <= (at > where).mean() <= 0.8:
                where = float(np.median(at))
            above = at > where
            if above.any() and not above.all():
                here = len(cut)
                for column, value in ((axis, line), (cut, where), (low, 0), (high, 0)):
                    column.append(value)
                low[here], high[here] = split(rows[~above]), split(rows[above])
                return here
        leaves += 1
        return -leaves

    split(np.arange(len(x)))
    return Routes(np.array(axis, np.float32).reshape(len(cut), x.shape[1]), np.array(cut, np.float32), np.array(low, np.int64), np.array(high, np.int64))


def routed(ids: DataFrame, df: np.ndarray, n: int, n_ids: int, kind_of_id: str, s: Settings) -> DataFrame:
    """(doc_id, ids, shard): a leaf of the routing tree each; leaves that the sample shows to be large are dealt into parts."""
    shard_docs = max(1.0, s.shard_ids * n / max(n_ids, 1))
    if n <= 1.5 * shard_docs:
        return ids.withColumn("shard", F.lit(0).cast("long"))
    spark = ids.sparkSession
    model = spark.sparkContext.broadcast(df)  # as long as the vocabulary

    def vectors(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in blobs:
            yield pd.Series([v.tobytes() for part in _sliced(b.array, kind_of_id, s.slice_ids) for v in projected(part, model.value, n, s)], dtype=object)

    deal = F.xxhash64("doc_id", F.length("ids"), F.crc32("ids"))
    share = min(1.0, s.sample / n)
    chosen = ids.select("ids", deal.alias("h")).filter(F.pmod("h", F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    sample = chosen.select("h", F.pandas_udf(vectors, "binary")("ids").alias("x")).toPandas()  # about s.sample vectors
    x = np.array([np.frombuffer(v, np.float32) for v in sample.sort_values(["h", "x"])["x"]]).reshape(-1, s.dims)
    routes_ = routes(x, max(4.0, len(x) * shard_docs / n), s)
    held = np.bincount(routes_.leaves(x), minlength=len(routes_.cut) + 1) * n / max(len(x), 1)
    parts = np.maximum(1, np.ceil(held / (2 * shard_docs))).astype(np.int64)
    tree = spark.sparkContext.broadcast((routes_, parts, np.cumsum(parts) - parts))  # s.sample / 4 leaves at most

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        way, parts, first = tree.value
        row = TaskContext.get().partitionId() * 7919
        for batch in batches:
            leaf = [way.leaves(projected(part, model.value, n, s)) for part in _sliced(batch["ids"].array, kind_of_id, s.slice_ids)]
            leaf = np.concatenate([*leaf, np.zeros(0, np.int64)])
            # parts are dealt by the row's place in the stored table: repeated rows spread like all others
            yield batch.assign(shard=first[leaf] + (row + np.arange(len(leaf))) % parts[leaf])
            row += len(leaf)

    return ids.mapInPandas(placed, f"doc_id {dict(ids.dtypes)['doc_id']}, ids binary, shard long")


class ShardIndex:
    """BM25 inverted index over the documents of one shard; documents that are used up leave it."""

    def __init__(self, docs: list[np.ndarray], s: Settings, df_of: np.ndarray | None = None, n_all: int = 0):
        """df_of: document frequencies of the corpus of ``n_all`` documents by token id; without it the shard's own count."""
        n = len(docs)
        doc, term, tf = term_counts(docs)
        length = np.fromiter(map(len, docs), float, n)
        distinct, at, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = _idf(df, n) if df_of is None else _idf(df_of[distinct], n_all)
        weight = idf[at] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length[doc] / length.mean()))
        self.n, self.n_terms = n, len(distinct)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.terms = at
        order = np.argsort(at, kind="stable")
        self.term, self.doc, self.weight = at[order], doc[order], weight[order]
        self.held = n
        self.index()

    def index(self):
        self.starts = np.r_[0, np.cumsum(np.bincount(self.term, minlength=self.n_terms))]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties by position."""
        left = int(unused.sum())
        if left < 0.7 * self.held:  # postings of used documents go
            keep = unused[self.doc]
            self.term, self.doc, self.weight, self.held = self.term[keep], self.doc[keep], self.weight[keep], left
            self.index()
        query = self.terms[self.first[seed] : self.first[seed + 1]]
        starts, sizes = self.starts[query], self.starts[query + 1] - self.starts[query]
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], s: Settings = Settings(), df_of: np.ndarray | None = None, n_all: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each id of each document lies in one piece."""
    pieces, sequence = [], 0
    start, left = np.zeros(len(docs), np.int64), np.fromiter(map(len, docs), np.int64, len(docs))
    for d in range(len(docs)):
        while left[d] >= s.window:
            pieces.append((d, int(start[d]), s.window, sequence, 0))
            start[d], left[d], sequence = start[d] + s.window, left[d] - s.window, sequence + 1
    if not (left > 0).any():
        return pieces
    index = ShardIndex(docs, s, df_of, n_all)
    unused = left > 0
    for seed in np.argsort(-left, kind="stable"):
        if not unused[seed]:
            continue
        offset, space = 0, s.window

        def take(d: int, n: int):
            nonlocal offset, space
            pieces.append((int(d), int(start[d]), int(n), sequence, offset))
            start[d], left[d] = start[d] + n, left[d] - n
            unused[d] = left[d] > 0
            offset, space = offset + int(n), space - int(n)

        take(seed, left[seed])
        # neighbours first; documents that share no term only where those do not fill the window
        for ranked in (lambda: index.neighbours(seed, unused), lambda: np.flatnonzero(unused)):
            if space < s.least_cut:
                break
            order = ranked()
            sizes, at = left[order], 0
            while space >= s.least_cut:  # the best document that fits, then the best after it
                fits = np.flatnonzero(sizes[at:] <= space)
                if not len(fits):
                    break
                at += int(fits[0])
                take(order[at], sizes[at])
                at += 1
            if space >= s.least_cut:
                rest = order[unused[order]] if len(order) else order
                if len(rest):  # all of them are longer than the space
                    take(rest[0], space)
        sequence += 1
    return pieces


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Pieces: doc_id, start, length, ids binary, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit, those of the tokenizer with
    ``add_special_tokens=False``: a text that holds the string of a special
    token gets its special id there. Every document ends with the end id, so
    null and empty texts give one id. Pieces of a sequence stand without gaps
    from offset 0 and have at most ``window`` ids. Very long texts are cut into
    as many pieces as they need. Null ids and repeated rows are packed like any
    other row; neighbours of equal score are taken in the order of their ids. An
    empty table gives no pieces. Columns of other names are ignored.
    """
    s = settings
    kind = dict(docs.dtypes)[doc_id]
    path = tokenizer or default_tokenizer()
    narrow = narrowest(path)  # what is shuffled is half as wide for up to 65,536 ids
    width = np.dtype(narrow).itemsize

    def packed(ids: list, blobs: list, sequence: int) -> tuple[pd.DataFrame, int]:
        rows = [np.frombuffer(b, narrow) for b in blobs]
        out = pd.DataFrame(pack_shard(rows, s, shared.value, n), columns=["d", "start", "length", "sequence_id", "offset"])
        used = int(out["sequence_id"].max()) + 1
        out["sequence_id"] += sequence
        out["doc_id"] = pd.Series([ids[d] for d in out["d"]], dtype=object)
        out["doc_tokens"] = [len(rows[d]) for d in out["d"]]
        out["ids"] = [rows[d][a : a + m].astype("<u4").tobytes() for d, a, m in zip(out["d"], out["start"], out["length"])]
        return out[["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]], sequence + used

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, sequence, ids, blobs, size = None, 0, [], [], 0
        for batch in batches:
            own = [None if missing else x for x, missing in zip(batch["doc_id"], batch["doc_id"].isna())]
            for i, blob, here in zip(own, batch["ids"], batch["shard"]):
                if blobs and (here != shard or size >= s.shard_ids):
                    out, sequence = packed(ids, blobs, sequence)
                    yield out
                    ids, blobs, size = [], [], 0
                if here != shard:
                    shard, sequence = here, int(here) << 32
                ids.append(i)
                blobs.append(blob)
                size += len(blob) // width
        if blobs:
            yield packed(ids, blobs, sequence)[0]

    ids = stored(encoded(docs, doc_id, text, path, s, narrow))
    n, n_ids = ids.agg(F.count("*"), F.coalesce(F.sum(F.length("ids")), F.lit(0)) / width).first()
    shared = docs.sparkSession.sparkContext.broadcast(document_frequencies(ids, narrow, s))
    dealt = routed(ids, shared.value, n, n_ids, narrow, s).repartition("shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids"))
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInPandas(run, schema).withColumnRenamed("doc_id", doc_id)
