"""Near-duplicate documents by MinHash.

Texts become sets of word shingles; equal sets are collapsed first. Many
universal hash minima per set, cut into bands, put similar sets into common
buckets. Links are confirmed by the signature, then on the full sets, and
joined into components by large-star and small-star.

No bucket is expanded into all its pairs. First every member is compared with
the bucket's smallest id. A bucket that then still spans several components
is compared across them inside tasks: blocks of the members outside its most
frequent component with blocks of all members. Only the links that join two
components leave a task; pairs inside a component change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .components import connected_components

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """Links hold 100 * intersection >= percent * union over sets of ``width`` word shingles."""

    width: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 6
    #: How far below the threshold, in standard errors, a signature may fall and still be confirmed on the sets.
    sigmas: float = 4.5
    seed: int = 1
    block: int = 512  # members of a bucket that a task compares with as many others
    cache_words: int = 200_000
    slice_chars: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        t = self.percent / 100
        return t - self.sigmas * (t * (1 - t) / self.hashes) ** 0.5


class Shingler:
    """Sets of 64-bit shingle hashes of texts; word hashes are kept for up to ``cache_words`` words."""

    def __init__(self, s: Settings):
        self.s, self.known = s, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; of fewer words than ``width`` the whole sequence is one; without words empty."""
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII blanks count
        if not words:
            return np.zeros(0, U64)
        known = self.known
        if len(known) > self.s.cache_words:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U64, len(words))
        width = min(self.s.width, len(h))
        mixed = np.full(len(h) - width + 1, width, U64)
        for i in range(width):
            mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * U64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> U64(29)
        return np.unique(mixed)


class Hasher:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.a = rng.integers(1, 2**63, (s.hashes, 1), dtype=U64) * U64(2) + U64(1)
        self.b = rng.integers(0, 2**63, (s.hashes, 1), dtype=U64)
        self.s = s

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least multiply-shift hash of the set, for each of the hash functions."""
        least = np.full(self.s.hashes, 2**64 - 1, U64)
        for start in range(0, len(shingles), 2048):
            np.minimum(least, (self.a * shingles[start : start + 2048] + self.b).min(1), out=least)
        return (least >> U64(32)).astype(np.uint32)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.s.bands, self.s.rows).astype(U64)
        h = np.arange(1, self.s.bands + 1, dtype=U64)
        for i in range(self.s.rows):
            h = (h ^ rows[:, i]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(32)
        return h.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, buckets): a row per document; sig and buckets are null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, hasher = Shingler(s), Hasher(s)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                sizes, digests, sigs, buckets = [], [], [], []
                seen: dict[bytes, tuple] = {}
                for t in part["text"]:
                    found = shingler.shingles(t)
                    digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                    if len(found) and digest not in seen:
                        sig = hasher.signature(found)
                        seen[digest] = (sig.tobytes(), hasher.buckets(sig))
                    sig, own = seen.get(digest, (None, None))
                    sizes.append(len(found))
                    digests.append(digest)
                    sigs.append(sig)
                    buckets.append(own)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_shingles": sizes, "digest": digests, "sig": sigs, "buckets": buckets})

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_shingles long, digest binary, sig binary, buckets array<long>")


def _agreeing(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sizes allow a link and whose signatures agree often enough for one."""

    def agreement(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).mean()) for a, b in zip(left, right)], dtype="float64")

    agree = F.pandas_udf(agreement, "double")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("x"), "x").join(side("p"), "p")
    sizes = F.least("n_x", "n_p") * 100 >= F.greatest("n_x", "n_p") * s.percent
    return both.filter(sizes).filter(agree("sig_x", "sig_p") >= s.least_agreement).select("x", "p")


def _confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose full sets are similar enough, as edges (u, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, right = Shingler(s), None, None
        for batch in batches:
            u, v = [], []
            for x, p, tx, tp in zip(batch["x"], batch["p"], batch["text_x"], batch["text_p"]):
                if p != last:  # rows of one p mostly stand together
                    last, right = p, shingler.shingles(tp)
                left = shingler.shingles(tx)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= s.percent * (len(left) + len(right) - common):
                    u.append(x)
                    v.append(p)
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    both = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x").join(texts.select(F.col("node").alias("p"), F.col("text").alias("text_p")), "p")
    return both.mapInPandas(run, "u long, v long")


def _joined_across(members: DataFrame, slim: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Edges (u, v) that join the parts of buckets; members: (bucket, node, part, top, n, n_out).

    ``top`` is the bucket's most frequent part, n and n_out count its members
    and those outside that part. A block of the latter and a block of all
    members are a group. Two members in different parts are confirmed on the
    full sets if the signatures allow it; their parts are one from then on.
    """
    blocks = lambda c: F.ceil(F.col(c) / s.block).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = members.withColumn("ni", blocks("n_out")).withColumn("nj", blocks("n"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    left = dealt.filter("part <> top").select("bucket", own("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("side"), "node", "part")
    right = dealt.select("bucket", every("ni").alias("i"), own("nj").alias("j"), F.lit(1).alias("side"), "node", "part")
    rows = left.unionByName(right).join(slim, "node").join(texts, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")

    def links(group: list[tuple], shingler: Shingler) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        sets: dict[int, np.ndarray] = {}

        def full(k):
            if k not in sets:
                sets[k] = shingler.shingles(group[k][8])
            return sets[k]

        side = np.array([g[3] for g in group])
        sizes = np.array([g[6] for g in group])
        sigs = np.frombuffer(b"".join(g[7] for g in group), np.uint32).reshape(len(group), -1)
        right = np.flatnonzero(side == 1)
        for a in np.flatnonzero(side == 0):
            fits = np.minimum(sizes[right], sizes[a]) * 100 >= np.maximum(sizes[right], sizes[a]) * s.percent
            agree = (sigs[right] == sigs[a]).mean(1)
            for b in right[fits & (agree >= s.least_agreement)]:
                x, y = find(group[a][5]), find(group[b][5])
                if x != y:
                    common = len(np.intersect1d(full(a), full(b), assume_unique=True))
                    if 100 * common >= s.percent * (len(full(a)) + len(full(b)) - common):
                        root[x] = y
                        yield int(group[a][4]), int(group[b][4])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, group, key = Shingler(s), [], None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False, name=None):
                if row[:3] != key:
                    found += links(group, shingler) if group else []
                    group, key = [], row[:3]
                group.append(row)
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
        if group:
            yield pd.DataFrame(list(links(group, shingler)), columns=["u", "v"], dtype="int64")

    return rows.select("bucket", "i", "j", "side", "node", "part", "n_shingles", "sig", "text").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row per document.

    ``component_id`` is the smallest document id reachable over links, the
    document's own included, and ``kept`` marks the document with that id.
    Ids are whole numbers. Documents without words (null, empty or blank texts)
    link with nothing. Rows that repeat an id count as one document whose links
    are those of its smallest text; a row with a null id takes part in nothing,
    has a null component and is kept. An empty table gives an empty table.
    """
    s = settings
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(source, "doc_id", "text", s))
    nodes = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"), F.max("buckets").alias("buckets"))
    nodes = stored(nodes)
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("node").alias("p"), F.max("node").alias("other")).filter("p <> other").select("bucket", "p")
    shared = stored(members.join(pivots, "bucket"))
    slim = stored(nodes.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")))
    texts = stored(source.join(slim.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))

    first = shared.filter("node <> p").select(F.col("node").alias("x"), "p").distinct()
    edges = stored(_confirmed(_agreeing(first, slim, s), texts, s))
    parts = connected_components(edges)

    # buckets that still span components; of buckets with equal members one is enough
    placed = shared.join(parts.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    by_part = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    spans = by_part.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.sum("h").alias("same"), F.count("*").alias("parts")).filter("parts > 1 AND n > 2")
    spans = spans.select("bucket", "n", "same", F.col("top.part").alias("top"), (F.col("n") - F.col("top.n")).alias("n_out"))
    open_buckets = spans.groupBy("n", "same").agg(F.min(F.struct("bucket", "top", "n_out")).alias("b")).select("b.bucket", "b.top", "n", "b.n_out")
    more = stored(_joined_across(placed.select("bucket", "node", "part").join(open_buckets, "bucket"), slim, texts, s))
    first_parts, parts = parts, connected_components(parts.unionByName(more))
    drop_stored(shared, slim, texts, edges, more, first_parts)  # the result reads the signatures, nodes and parts alone

    # an exact copy reaches its node's component, whatever its own id
    own = nodes.select("digest", "node").join(parts.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").select("digest", F.coalesce("part", "node").alias("part"))
    return signed.join(own, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("part", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose document represents its group; exact repeats of a row stay together."""
    kept = near_duplicates(docs, settings=settings).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
