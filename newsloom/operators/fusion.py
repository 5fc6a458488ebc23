"""Rank fusion, reranking, and the retrieve-rerank-answer chain over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..session import sent
from . import dense, sparse

RRF_K = 60
#: Ids of hits that are sent to all tasks at most; texts of more of them are found by shuffle.
MAX_IDS = 1_000_000


def over_fetch(k: int) -> int:
    """How many hits each retriever gives before fusion."""
    return min(3 * k, k + 30)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(query_id, id, score, rank): weighted sums of 1 / (60 + rank), rounded to 6 digits; one shuffle for both lists."""
    parts = [hits.filter(F.col("rank") <= over_fetch(k)).select("query_id", "id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("s")) for hits, w in zip((first, second), weights)]
    fused = parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return sparse.top_k(fused, k)


def overlap_score(query: Column, text: Column) -> Column:
    """The offline pair scorer, a substitute for a cross-encoder: F1 of the two texts' word sets."""
    q, t = F.array_distinct(fx.tokens(query)), F.array_distinct(fx.tokens(text))
    both = F.size(F.array_intersect(q, t))
    return F.when((F.size(q) > 0) & (F.size(t) > 0), 2.0 * both / (F.size(q) + F.size(t))).otherwise(0.0)


def rerank(hits: DataFrame, n: int, scorer: Callable[[Column, Column], Column] | None = None, query: str = "query", text: str = "text") -> DataFrame:
    """The best ``n`` hits by ``scorer(query, text)``, old score kept as ``first_score``; without a scorer the first n.

    ``scorer`` may be a column expression or a pandas UDF; ties keep the earlier rank.
    """
    if scorer is None:
        return hits.withColumn("first_score", F.col("score")).filter(F.col("rank") <= n)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.asc("first_rank"))
    scored = hits.withColumnsRenamed({"rank": "first_rank", "score": "first_score"}).withColumn("score", scorer(F.col(query), F.col(text)))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def of_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id stands in ``wanted``."""
    return rows.join(sent(wanted.select("id").distinct(), MAX_IDS), "id", "left_semi")


def with_text(hits: DataFrame, chunks: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """Hits with their text; an unknown id has an empty one. ``hits`` are read twice, so that texts without a hit stay where they are."""
    texts = of_ids(chunks.select(F.col(id).alias("id"), F.col(text).alias("text")), hits)
    return hits.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, method: str = "hybrid", index: sparse.Index | None = None, query_id: str = "query_id", text: str = "text", id: str = "id", load=None) -> DataFrame:
    """Hits by ``bm25``, ``dense`` or ``hybrid``; any other method is an error."""
    if method not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown retriever: {method!r}")
    wide = over_fetch(k) if method == "hybrid" else k
    lexical = vectors = None
    if method != "dense":
        lexical = sparse.search(index or sparse.build_index(chunks, id, text), queries, query_id, text, wide)
    if method != "bm25":
        corpus = dense.embed(chunks.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", load)
        asked = dense.embed(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")), "text", load)
        vectors = dense.search(corpus, asked, wide)
    if method == "hybrid":
        return reciprocal_rank_fusion(vectors, lexical, k)
    return lexical if method == "bm25" else vectors


def traces(hits: DataFrame) -> DataFrame:
    """(query_id, ids, contexts, scores) in rank order; a query has at most k hits."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "text", "score")))
    return hits.groupBy("query_id").agg(rows.alias("h")).select("query_id", F.col("h.id").alias("ids"), F.col("h.text").alias("contexts"), F.col("h.score").alias("scores"))


def extractive_answer(question: Column, contexts: Column) -> Column:
    """The offline generator, a substitute for a model: the context sentence that overlaps most with the question, cited."""
    sentences = F.flatten(F.transform(contexts, lambda c, i: F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.struct(overlap_score(question, s).alias("o"), (-i).alias("i"), s.alias("s")))))
    best = F.array_max(sentences)
    return F.coalesce(F.concat(best["s"], F.lit(" ["), (1 - best["i"]).cast("string"), F.lit("]")), F.lit(""))


def answered(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds citation_chunk_ids, invalid_citation_indices and the answer without marks to traces with an answer."""
    n = F.size("ids")
    cited = fx.citations(F.col(answer))
    return rows.withColumns({
        "citation_chunk_ids": F.transform(fx.valid_citations(cited, n), lambda i: F.try_element_at(F.col("ids"), i)),
        "invalid_citation_indices": fx.invalid_citations(cited, n),
        "prediction": fx.without_citations(F.col(answer)),
    })
