"""Exact vector search and text embedding."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparse import top_k

METRICS = ("cosine", "l2", "ip")
MAX_BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - cos, 1 for zero vectors; l2: squared Euclidean; ip: 1 - inner product."""
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def _matrix(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the vectors of ``dim`` numbers as a matrix, and their places; ``vectors`` holds arrays without nulls, or None."""
    whole = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    x = np.concatenate([vectors[i] for i in whole]).astype(np.float64) if whole and dim else np.empty(0)
    return np.array(whole, np.int64), x.reshape(len(whole), dim)


def _whole(vector: Column) -> Column:
    """Null for a vector that holds a null."""
    return F.when(~F.exists(vector, lambda x: x.isNull()), vector)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """1 - distance of every query (row) to every vector (column)."""
    if metric == "cosine":
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
        return np.divide(q @ x.T, norms, out=np.zeros((len(q), len(x))), where=norms > 0)
    if metric == "ip":
        return q @ x.T
    if metric == "l2":
        return np.array([1 - ((x - one) * (x - one)).sum(1) for one in q]).reshape(len(q), len(x))
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, id: str = "id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) with score = 1 - distance over the rows that meet ``where``.

    Blocks of the stated queries of at most ``MAX_BROADCAST_BYTES`` are sent to
    the corpus, whose batches are compared with them as matrices; a batch passes
    on its k best of each query (with all ties), so that no pair beyond them is
    shuffled. Rows with null, or a vector of another length or with nulls, have
    no score. Query ids are unique.
    """
    spark = corpus.sparkSession
    rows = corpus if where is None else corpus.filter(where)
    rows = rows.select(F.col(id).alias("id"), _whole(F.col(vector)).alias("v")).filter("id IS NOT NULL")
    asked = queries.select(F.col(query_id).alias("query_id"), _whole(F.col(query_vector)).alias("q")).filter("query_id IS NOT NULL AND q IS NOT NULL")
    n_bytes = asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0)).cast("long")).first()[0] * 8
    blocks = -(-n_bytes // MAX_BROADCAST_BYTES) if n_bytes else 0
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"

    def block(i: int) -> DataFrame:
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        held = own.toPandas()  # MAX_BROADCAST_BYTES on average
        by_length = [(dim, *_matrix(held["q"], dim)) for dim in sorted({len(v) for v in held["q"]})]
        shared = spark.sparkContext.broadcast([(dim, held["query_id"].to_numpy()[at], q) for dim, at, q in by_length if len(at)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, names, q in shared.value:
                    at, x = _matrix(batch["v"], dim)
                    for start in range(0, len(names) if len(at) else 0, 256):
                        found = _scores(x, q[start : start + 256], metric)
                        shown = np.round(found, 6)
                        least = -np.partition(-shown, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                        i, j = np.nonzero(shown >= least[:, None] - 2e-6)  # ties are decided later, by the exact rounding and the id
                        yield pd.DataFrame({"query_id": names[start + i], "id": batch["id"].array[at[j]], "score": found[i, j]})

        return rows.mapInPandas(run, schema)

    if not blocks:
        return spark.createDataFrame([], schema + ", rank int")
    found = block(0)
    for i in range(1, blocks):
        found = found.unionByName(block(i))
    return top_k(found, k)


Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 64) -> Callable[[], Embedder]:
    """The offline default, a substitute for a neural model: signed hashed word counts, damped and normalised."""

    def load() -> Embedder:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    row[h % dim] += 1 if h >> 31 else -1
            out = np.sign(out) * np.log1p(np.abs(out))
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return load


def embed(df: DataFrame, text: str, load: Callable[[], Embedder] | None = None, out: str = "embedding") -> DataFrame:
    """``df`` plus an array<float> per text. ``load`` runs once per worker and returns the model's function."""
    make = load or hashed_embedder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(np.asarray(model([t or "" for t in batch]), np.float32)))

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))
