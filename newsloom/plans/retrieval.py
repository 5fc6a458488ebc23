"""Queries over documents, benchmark items and embeddings: search, fusion, reranking, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import dense, fusion, metrics, sparse
from ..session import sent, stored, table
from .registry import query

K = 10
#: Benchmark items whose texts are sent to all tasks at most; more of them are joined by shuffle.
MAX_ITEMS = 100_000
#: Words of items that are sent to all tasks at most.
MAX_KEYS = 200_000
KS = (1, 3, 5, 10)


def tok(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '\s+'), lambda x: x <> '')"


BM25 = rf"""
d AS (SELECT doc_id AS id, {tok('text')} AS ws FROM documents),
p AS (SELECT id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
t AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, c GROUP BY term),
a AS (SELECT avg(raw) AS avg_raw FROM t),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT query_id, id, sum(qtf * CASE WHEN raw >= 0 THEN raw ELSE 0.25 * avg_raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN t USING (term) JOIN p USING (term), c, a GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)
"""

CONTAINS = "g AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    index = sparse.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return stored(sparse.search(index, table(spark, sf_dir, "benchmark"), "item_id", "text", k))


def inner(ws: Column) -> Column:
    """The distinct words of an item that stand in a document as they are, if the item does; its edges may be parts of longer words."""
    return F.when(F.size(ws) > 2, F.array_distinct(F.slice(ws, F.lit(2), F.size(ws) - 2))).otherwise(F.array().cast("array<string>"))


def hits_and_gold(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """``bm25_hits`` and ``gold``: the search finds the candidates of gold too, so documents are cut into words twice instead of four times."""
    index = sparse.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    hits, holders = sparse.search_with_holders(index, table(spark, sf_dir, "benchmark"), "item_id", "text", k, inner)
    return stored(hits), gold(spark, sf_dir, holders)


def gold(spark: SparkSession, sf_dir: str, holders: DataFrame | None = None) -> DataFrame:
    """(query_id, id): documents that hold an item's text. Candidates come from the item's rarest inner word, as ``holders`` if a search found them; texts of other documents are not moved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    keyed = items.withColumn("ws", fx.tokens(F.col("item"))).select("query_id", "item", inner(F.col("ws")).alias("keys"))
    found = holders
    if found is None:
        found = candidates(keyed, docs.select("id", F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("key")))
    # items of one or two words have no inner word: their shortest sure parts are runs of three characters
    short = keyed.filter("size(keys) = 0")
    if short.limit(1).count():
        run = lambda text, n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
        for n in (3, 2, 1):
            own = short.filter(F.length("item") >= 3 if n == 3 else F.length("item") == n).select("query_id", "item", F.array_distinct(run(F.col("item"), n)).alias("keys"))
            found = found.unionByName(candidates(own, docs.select("id", F.explode(F.array_distinct(run(F.col("text"), n))).alias("key"))))
        found = found.unionByName(short.filter("item = ''").select("query_id").crossJoin(docs.select("id")))  # an empty text is in every document
    found = stored(found.distinct())
    return stored(found.join(items, "query_id").join(fusion.of_ids(docs, found), "id").filter(F.contains("text", F.col("item"))).select("query_id", "id"))


def candidates(keyed: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, id): documents with the rarest of an item's keys; items may share a query_id. keyed: query_id, keys; postings: id, key."""
    asked = keyed.select("query_id", "keys", F.explode("keys").alias("key"))
    held = postings.join(sent(asked.select("key").distinct(), MAX_KEYS), "key", "left_semi")
    counts = held.groupBy("key").agg(F.count("*").alias("df"))
    rarest = asked.join(counts, "key", "left").groupBy("query_id", "keys").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("k"))
    rarest = stored(rarest.filter("k.df > 0").select("query_id", F.col("k.key").alias("key")).distinct())
    return postings.join(sent(rarest, MAX_KEYS), "key").select("query_id", "id")


def samples(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(query_id, relevant, retrieved): per query with gold documents."""
    return samples_of(*hits_and_gold(spark, sf_dir, k))


def samples_of(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, relevant, retrieved) from ranked hits and gold pairs."""
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias("retrieved"))
    relevant = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("relevant"))
    return relevant.join(found, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<bigint>")))


SAMPLES = f"""
{BM25}, {CONTAINS},
h AS (SELECT query_id, list(id ORDER BY rank) AS retrieved FROM r WHERE rank <= {K} AND score > 0 GROUP BY query_id),
l AS (SELECT query_id, list(DISTINCT id) AS relevant FROM g GROUP BY query_id),
m AS (SELECT l.query_id, relevant, coalesce(retrieved, []) AS retrieved FROM l LEFT JOIN h USING (query_id))
"""


def metric_sql(k: int) -> str:
    gains = f"list_sum(list_transform(range(1, {k} + 1), lambda i: CASE WHEN list_contains(relevant, retrieved[i]) THEN 1 / log2(i + 1) ELSE 0 END))"
    ideal = f"list_sum(list_transform(range(1, least(len(relevant), {k}) + 1), lambda i: 1 / log2(i + 1)))"
    return f"""CAST(list_has_any(retrieved[:{k}], relevant) AS DOUBLE) AS hit_rate_{k},
    coalesce(list_max(list_transform(range(1, {k} + 1), lambda i: CASE WHEN list_contains(relevant, retrieved[i]) THEN 1.0 / i END)), 0.0) AS mrr_{k},
    len(list_intersect(retrieved[:{k}], relevant)) / len(relevant) AS recall_{k},
    {gains} / {ideal} AS ndcg_{k}"""


NAMES = [f"{m}_{k}" for k in KS for m in ("hit_rate", "mrr", "recall", "ndcg")]
PER_QUERY = f"{SAMPLES}, e AS (SELECT query_id, relevant, {', '.join(metric_sql(k) for k in KS)} FROM m)"


def tall_sql(source: str, names=NAMES, keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{n}' AS metric, round({n}, 9) AS value FROM {source}" for n in names)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= {K} AND score > 0")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT round(avg_raw, 9) AS avg_raw, n, round(avgdl, 9) AS avgdl, (SELECT count(*) FROM t) AS n_terms, (SELECT count(*) FROM p) AS n_postings FROM a, c")
def bm25_index_stats(spark, sf_dir):
    index = sparse.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    sizes = index.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return rounded(index.corpus.join(F.broadcast(sizes)), "avg_raw", "avgdl").select("avg_raw", "n", "avgdl", "n_terms", "n_postings")


@query(f"WITH {PER_QUERY}, v AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM e) {tall_sql('v')}")
def bm25_eval(spark, sf_dir):
    return rounded(metrics.evaluate_retrieval(samples(spark, sf_dir), KS), "value")


@query(
    f"""WITH {PER_QUERY}, x AS (SELECT e.*, coalesce(CAST(quality AS VARCHAR), 'none') AS label FROM e LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) z ON z.doc_id = list_min(relevant)),
    v AS (SELECT label, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM x GROUP BY label UNION ALL SELECT 'all', {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM x) {tall_sql('v', keys='label, ')}"""
)
def bm25_eval_by_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("first")).agg(F.max("quality").alias("label"))
    s = samples(spark, sf_dir).withColumn("first", F.array_min("relevant")).join(labels, "first", "left").withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("none")))
    return rounded(metrics.evaluate_retrieval(s, KS, group="label"), "value")


@query(f"WITH {PER_QUERY}, w AS (SELECT list_min(relevant) AS article, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM e GROUP BY 1), v AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM w) {tall_sql('v')}")
def retrieval_macro(spark, sf_dir):
    scored = metrics.per_query(samples(spark, sf_dir), KS).withColumn("article", F.array_min("relevant"))
    return rounded(metrics.macro_average(scored, "article", metrics.metric_columns(KS)), "value")


@query(f"WITH {PER_QUERY} SELECT count(*) AS queries, coalesce(max(hit_rate_10) = 0 AND count(*) > 0, false) AS suspicious FROM e")
def all_zero_diagnostic(spark, sf_dir):
    scored = metrics.per_query(samples(spark, sf_dir), KS)
    return metrics.all_zero(scored.select(F.col("hit_rate_10").alias("hit")))


@query(f"WITH {PER_QUERY} SELECT query_id, relevant[1] AS first_relevant FROM (SELECT query_id, list_sort(relevant) AS relevant FROM e WHERE recall_3 < 1 ORDER BY query_id LIMIT 20)")
def failure_cases(spark, sf_dir):
    """A report of the first 20 queries, in their order, whose first three hits lack a gold document; the limit is the feature."""
    scored = metrics.per_query(samples(spark, sf_dir), KS)
    return scored.filter("recall_3 < 1").orderBy("query_id").limit(20).select("query_id", F.array_min("relevant").alias("first_relevant"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
    r AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) DESC, vec_id) AS rank FROM q, embeddings)
    SELECT count(*) AS asked, round(avg(CAST(id = query_id AS DOUBLE)), 9) AS recall_at_1 FROM r WHERE rank = 1"""
)
def self_retrieval(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks for itself."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = dense.search(vectors.select(F.col("vec_id").alias("id"), "embedding"), asked, 1)
    return asked.join(hits, "query_id", "left").agg(F.count("*").alias("asked"), F.round(F.avg(F.coalesce(F.col("id") == F.col("query_id"), F.lit(False)).cast("double")), 9).alias("recall_at_1"))


def knn_sql(score: str, where: str = "true", select: str = "query_id, rank, id, score") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
    v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {where}),
    s AS (SELECT query_id, id, {score} AS score FROM q, v),
    r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)
    SELECT {select} FROM r WHERE rank <= {K}"""


def _knn(spark, sf_dir, metric, where=None):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = dense.search(vectors.withColumnRenamed("vec_id", "id"), asked, K, metric, where)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


COSINE = "list_cosine_similarity(v, q)"


@query(knn_sql(COSINE))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@query(knn_sql("1 - list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@query(knn_sql("list_inner_product(v, q)"))
def knn_ip(spark, sf_dir):
    return _knn(spark, sf_dir, "ip")


@query(knn_sql(COSINE, "label = 3"))
def knn_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine", F.col("label") == 3)


FUSED = f"""
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS c,
      round(1 - list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS l FROM q, embeddings),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rc, row_number() OVER (PARTITION BY query_id ORDER BY l DESC, id) AS rl FROM s),
f AS (SELECT query_id, id, round((CASE WHEN rc <= {fusion.over_fetch(K)} THEN CAST(0.7 AS DOUBLE) / (60 + rc) ELSE 0 END) + (CASE WHEN rl <= {fusion.over_fetch(K)} THEN CAST(0.3 AS DOUBLE) / (60 + rl) ELSE 0 END), 6) AS score
      FROM r WHERE rc <= {fusion.over_fetch(K)} OR rl <= {fusion.over_fetch(K)}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
"""


@query(f"WITH {FUSED} SELECT query_id, rank, id, score FROM o WHERE rank <= {K}")
def rrf_fusion(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    lists = [dense.search(vectors, asked, fusion.over_fetch(K), metric) for metric in ("cosine", "l2")]
    return fusion.reciprocal_rank_fusion(*lists, K).select("query_id", "rank", "id", "score")


OVERLAP = """
o AS (SELECT r.query_id, r.id, r.rank AS first_rank, list_distinct({q}) AS qs, list_distinct({t}) AS ts FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE r.rank <= {k} AND r.score > 0),
w AS (SELECT query_id, id, first_rank, CASE WHEN len(qs) > 0 AND len(ts) > 0 THEN 2.0 * len(list_intersect(qs, ts)) / (len(qs) + len(ts)) ELSE 0 END AS score FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, first_rank) AS rank FROM w)
""".format(q=tok("b.text"), t=tok("x.text"), k=K)


def reranked(spark, sf_dir, n=5, found=None):
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = fusion.with_text(bm25_hits(spark, sf_dir) if found is None else found, docs, "doc_id").join(sent(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), MAX_ITEMS), "query_id")
    return fusion.rerank(hits, n, fusion.overlap_score)


@query(f"WITH {BM25}, {OVERLAP} SELECT query_id, rank, id, first_rank, round(score, 6) AS score FROM z WHERE rank <= 5")
def rerank_overlap(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "rank", "id", "first_rank", F.round("score", 6).alias("score"))


def both_samples(spark, sf_dir):
    """``samples``, and the same with the reranked hits."""
    hits, pairs = hits_and_gold(spark, sf_dir)
    return samples_of(hits, pairs), samples_of(reranked(spark, sf_dir, found=hits), pairs)


@query(
    f"""WITH {BM25}, {CONTAINS}, {OVERLAP},
    aa AS (SELECT g.query_id, max(CASE WHEN r.rank <= 5 AND r.score > 0 THEN 1.0 / r.rank ELSE 0 END) AS b FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id GROUP BY 1),
    c2 AS (SELECT g.query_id, max(CASE WHEN z.rank <= 5 THEN 1.0 / z.rank ELSE 0 END) AS f FROM g LEFT JOIN z ON z.query_id = g.query_id AND z.id = g.id GROUP BY 1)
    SELECT 'mrr_5' AS metric, round(avg(b), 9) AS before, round(avg(f), 9) AS after, round(avg(f) - avg(b), 9) AS delta FROM aa JOIN c2 USING (query_id)"""
)
def delta_mrr(spark, sf_dir):
    means = [metrics.evaluate_retrieval(s, (5,)).filter("metric = 'mrr_5'") for s in both_samples(spark, sf_dir)]
    return rounded(metrics.delta(*means), "before", "after", "delta")


@query(f"WITH {BM25}, y AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM r WHERE rank <= 5 AND score > 0 GROUP BY 1) SELECT query_id, ids, list_transform(ids, lambda i: i % 2 = 0) AS even FROM y")
def retrieval_traces(spark, sf_dir):
    hits = fusion.with_text(bm25_hits(spark, sf_dir, 5), table(spark, sf_dir, "documents"), "doc_id")
    return fusion.traces(hits).select("query_id", "ids", F.transform("ids", lambda i: i % 2 == 0).alias("even"))


@query()
def hybrid_search(spark, sf_dir):
    """BM25 and hashed-vector retrieval fused: the offline form of the hybrid retriever."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return fusion.retrieve(items, docs, K, "hybrid").select("query_id", "rank", "id", "score")


@query()
def extractive_answers(spark, sf_dir):
    """Retrieve, answer from the best sentence, map its citation to a document."""
    hits = fusion.with_text(bm25_hits(spark, sf_dir, 3), table(spark, sf_dir, "documents"), "doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = fusion.traces(hits).join(sent(items, MAX_ITEMS), "query_id").withColumn("answer", fusion.extractive_answer(F.col("question"), F.col("contexts")))
    return fusion.answered(rows.withColumn("ids", F.col("ids").cast("array<string>"))).select("query_id", "citation_chunk_ids", "invalid_citation_indices", "prediction")
