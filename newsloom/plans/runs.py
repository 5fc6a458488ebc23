"""Queries over events and conversations as run logs and chat history, and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as fx
from ..operators import metrics, reports, runlog
from ..session import shared_folder, table
from . import corpus, retrieval
from .registry import SQL, query
from .retrieval import BM25, KS, NAMES, OVERLAP, SAMPLES, metric_sql, rounded, tall_sql

STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'exhausted' ELSE 'failed' END"
LATEST = f"s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, {STATUS} AS status FROM events), la AS (SELECT * FROM s WHERE rn = 1)"


def log(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "exhausted").otherwise("failed")
    return table(spark, sf_dir, "events").withColumn("status", status)


def work(spark, sf_dir):
    """Expected keys: every customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


@query(f"WITH {LATEST} SELECT user_id, event_id, status, value FROM la")
def latest_state(spark, sf_dir):
    return runlog.latest(log(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "status", "value")


@query(f"WITH {LATEST} SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM la WHERE status IN ('success', 'exhausted') AND user_id IS NOT NULL)")
def pending_work(spark, sf_dir):
    state = runlog.latest(log(spark, sf_dir), "user_id", "ts", "event_id")
    return runlog.pending(work(spark, sf_dir), state, "user_id")


@query(f"WITH {LATEST}, j AS (SELECT c_custkey, status FROM customer LEFT JOIN la ON user_id = c_custkey) SELECT count(*) AS expected, count(status) AS recorded, count(*) FILTER (status = 'success') AS successful, count(status) - count(*) FILTER (status = 'success') AS failed, count(*) - count(status) AS missing, round(count(*) FILTER (status = 'success') / count(*), 9) AS success_rate FROM j")
def coverage(spark, sf_dir):
    state = runlog.latest(log(spark, sf_dir), "user_id", "ts", "event_id")
    return rounded(runlog.coverage(work(spark, sf_dir), state, "user_id"), "success_rate")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def missing_ids(spark, sf_dir):
    return runlog.missing_ids(work(spark, sf_dir), log(spark, sf_dir).select("user_id"), "user_id")


@query(f"SELECT user_id, count(*) FILTER ({STATUS} = 'success') AS n FROM events GROUP BY user_id HAVING count(*) FILTER ({STATUS} = 'success') > 1")
def repeated_success(spark, sf_dir):
    return runlog.repeated_success(log(spark, sf_dir), "user_id")


@query("SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, sf_dir):
    out = metrics.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return rounded(out, "mean", "p50", "p95", "max", digits=6)


@query(SQL["latency_summary"])
def latency_by_selection(spark, sf_dir):
    """The same distribution, its ranks selected by ranges instead of sorted per key."""
    return rounded(metrics.latency_by_selection(table(spark, sf_dir, "events"), "value", "event_type"), "mean", "p50", "p95", "max", digits=6)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM r WHERE rn <= 3")
def chat_history(spark, sf_dir):
    return runlog.last_n(table(spark, sf_dir, "conversations"), "conv_id", 3, "turn").select("conv_id", "turn", "role", "position")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_trace(spark, sf_dir):
    """The last 200 events; the limit is the feature."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM documents")
def work_batches(spark, sf_dir):
    return runlog.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


REPORT = "t AS (SELECT event_type AS run, 'mean' AS metric, avg(value) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'max', max(value) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'n', count(*) FROM events WHERE event_type <> 'view' GROUP BY 1)"


def report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sums = events.groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.when(F.first("event_type") != "view", F.count("*")).cast("double").alias("n"))
    return metrics.tall(sums, ["mean", "max", "n"], ["run"])


@query(f"WITH {REPORT} SELECT metric, coalesce(round(max(value) FILTER (run = 'click'), 6), 0.0) AS click, coalesce(round(max(value) FILTER (run = 'view'), 6), 0.0) AS view FROM t GROUP BY metric")
def search_comparison(spark, sf_dir):
    return rounded(reports.side_by_side(report(spark, sf_dir), ["click", "view"]), "click", "view", digits=6)


@query(f"WITH {REPORT} SELECT run, round(max(value) FILTER (metric = 'mean'), 6) AS mean, round(max(value) FILTER (metric = 'max'), 6) AS max, round(max(value) FILTER (metric = 'n'), 6) AS n FROM t GROUP BY run")
def run_comparison(spark, sf_dir):
    return rounded(reports.comparison(report(spark, sf_dir), ["mean", "max", "n"]), "mean", "max", "n", digits=6)


@query(f"WITH {REPORT} SELECT 'latency' AS \"group\", metric, round(arg_max(value, CASE WHEN run = 'click' THEN '~' ELSE run END), 6) AS value FROM t WHERE metric IN ('mean', 'n') GROUP BY metric")
def dashboard_cards(spark, sf_dir):
    rows = report(spark, sf_dir).withColumn("group", F.lit("latency"))
    return rounded(reports.cards(rows, [("latency", "mean"), ("latency", "n")], "click"), "value", digits=6)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS label FROM events")
def date_formats(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.iso_z(F.col("ts")).alias("iso"), dates.label(F.col("ts")).alias("label"))


@query("SELECT count(DISTINCT conv_id) AS samples, 3 * count(DISTINCT conv_id) AS requests, CAST(ceil(count(DISTINCT conv_id) / 16) AS BIGINT) AS batches FROM conversations")
def judge_estimate(spark, sf_dir):
    """Requests and batches that judging every conversation three times takes."""
    return reports.judge_estimate(table(spark, sf_dir, "conversations").select("conv_id").distinct(), 3, 16)


@query("WITH m AS (SELECT conv_id, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text, ' ') = '') AS blank FROM conversations GROUP BY conv_id) SELECT count(*) AS conversations, sum(n) AS turns, sum(blank) AS blank, sum(ceil(n / 2)) AS requests FROM m")
def judge_requests(spark, sf_dir):
    """How many requests judging the answers of every conversation takes."""
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"))
    return each.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.sum("blank").alias("blank"), F.sum(F.ceil(F.col("n") / 2)).cast("double").alias("requests"))


@query("WITH j AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 10 AS DOUBLE) / 10 END AS v FROM documents) SELECT 'faithfulness' AS metric, round(avg(v) FILTER (NOT isnan(v)), 9) AS mean, count(v) FILTER (NOT isnan(v)) AS scored, round(count(v) FILTER (NOT isnan(v)) / count(*), 9) AS coverage FROM j")
def judge_means(spark, sf_dir):
    v = F.when(F.col("doc_id") % 7 == 0, float("nan")).when(F.col("doc_id") % 5 == 0, None).otherwise((F.col("doc_id") % 10) / 10.0)
    rows = table(spark, sf_dir, "documents").select(F.create_map(F.lit("faithfulness"), v).alias("scores"))
    return rounded(metrics.judge_means(rows), "mean", "coverage")


SHORT_KS = (1, 3, 5)  # a reranked list has five hits
SHORT = [f"{m}_{k}" for k in SHORT_KS for m in ("hit_rate", "mrr", "recall", "ndcg")]
MEANS = lambda names: ", ".join(f"avg({n}) AS {n}" for n in names)
COVERED = ["expected", "recorded", "successful", "failed", "missing", "success_rate"]
ANSWERED, CITED = ["n", "exact_match", "f1"], [f"citation_{c}" for c in ("validity", "precision", "recall", "f1", "coverage")]


def group_sql(group: str, rows: str) -> str:
    return f"SELECT 'bm25' AS run, {group} AS \"group\", metric, value FROM ({rows})"


@query(
    f"""WITH {SAMPLES}, {OVERLAP}, h2 AS (SELECT query_id, list(id ORDER BY rank) AS retrieved FROM z WHERE rank <= 5 GROUP BY 1),
    m2 AS (SELECT l.query_id, relevant, coalesce(h2.retrieved, []) AS retrieved FROM l LEFT JOIN h2 USING (query_id)),
    e AS (SELECT query_id, relevant, {', '.join(metric_sql(k) for k in KS)} FROM m), e2 AS (SELECT query_id, {', '.join(metric_sql(k) for k in SHORT_KS)} FROM m2),
    v AS (SELECT {MEANS(NAMES)} FROM e), v2 AS (SELECT {MEANS(SHORT)} FROM e2), dl AS (SELECT {', '.join(f'v2.{n} - v.{n} AS {n}' for n in SHORT)} FROM v, v2),
    wa AS (SELECT list_min(relevant) AS article, {MEANS(NAMES)} FROM e GROUP BY 1), ma AS (SELECT {MEANS(NAMES)} FROM wa),
    lb AS (SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS label, {MEANS(NAMES)} FROM e LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q ON q.doc_id = list_min(relevant) GROUP BY 1),
    lt AS (SELECT avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL),
    an AS ({SQL["qa_em_f1"]}), ct AS ({SQL["citations_eval"]}), cv AS ({SQL["coverage"]})
    {" UNION ALL ".join([
        group_sql("'retrieval'", tall_sql("v")), group_sql("'reranked'", tall_sql("v2", SHORT)), group_sql("'delta'", tall_sql("dl", SHORT)), group_sql("'macro'", tall_sql("ma")),
        group_sql("'label:' || label", tall_sql("lb", keys="label, ")), group_sql("'answers'", tall_sql("an", ANSWERED)), group_sql("'citations'", tall_sql("ct", CITED)),
        group_sql("'coverage'", tall_sql("cv", COVERED)), group_sql("'latency'", tall_sql("lt", ["mean", "p50", "p95", "max"])),
    ])}"""
)
def benchmark_report(spark, sf_dir):
    """The end-to-end run as one tall report: retrieval before and after reranking and the difference, means by article and by label, answers, citations, work done, latency."""
    found, second = retrieval.both_samples(spark, sf_dir)
    base = metrics.per_query(found, KS).withColumn("article", F.array_min("relevant"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("article")).agg(F.max("quality").cast("string").alias("label"))
    labelled = base.join(labels, "article", "left").withColumn("label", F.coalesce("label", F.lit("none")))
    names = metrics.metric_columns(KS)
    before = metrics.tall(base.agg(*[F.avg(c).alias(c) for c in names]), names)
    after = metrics.evaluate_retrieval(second, SHORT_KS)
    by_label = metrics.tall(labelled.groupBy("label").agg(*[F.avg(c).alias(c) for c in names]), names, ["label"])
    state = runlog.latest(log(spark, sf_dir), "user_id", "ts", "event_id")
    latency = metrics.latency_summary(table(spark, sf_dir, "events"), "value")
    groups = {
        "retrieval": before,
        "reranked": after,
        "delta": metrics.delta(before, after).select("metric", F.col("delta").alias("value")),
        "macro": metrics.macro_average(base, "article", names),
        "answers": metrics.tall(corpus.qa_em_f1(spark, sf_dir), ANSWERED),
        "citations": metrics.tall(corpus.citations_eval(spark, sf_dir), CITED),
        "coverage": metrics.tall(runlog.coverage(work(spark, sf_dir), state, "user_id"), COVERED),
        "latency": metrics.tall(latency, ["mean", "p50", "p95", "max"]),
    }
    labels_too = by_label.select(F.lit("bm25").alias("run"), F.concat(F.lit("label:"), "label").alias("group"), "metric", "value")
    return rounded(reports.build(groups, "bm25").unionByName(labels_too), "value")


SCORED = f"""{SAMPLES}, {OVERLAP}, h2 AS (SELECT query_id, list(id ORDER BY rank) AS retrieved FROM z WHERE rank <= 5 GROUP BY 1),
    m2 AS (SELECT l.query_id, relevant, coalesce(h2.retrieved, []) AS retrieved FROM l LEFT JOIN h2 USING (query_id)),
    e AS (SELECT query_id, relevant, {', '.join(metric_sql(k) for k in KS)} FROM m), e2 AS (SELECT query_id, {', '.join(metric_sql(k) for k in SHORT_KS)} FROM m2),
    lq AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
    qn AS (SELECT query_id, list_min(relevant) AS article_id, coalesce(CAST(quality AS VARCHAR), 'none') AS label, quality, 1 - toxic AS harmless FROM e LEFT JOIN lq ON lq.doc_id = list_min(relevant)),
    rw AS (SELECT 'retrieval' AS "group", * FROM ({tall_sql("e", keys="query_id, ").replace("round(", "(").replace(", 9)", ")")}) UNION ALL SELECT 'reranked', * FROM ({tall_sql("e2", SHORT, keys="query_id, ").replace("round(", "(").replace(", 9)", ")")})
      UNION ALL SELECT 'judge', * FROM (SELECT query_id, unnest(['quality', 'harmless']) AS metric, CAST(unnest([quality, harmless]) AS DOUBLE) AS value FROM qn)),
    sc AS (SELECT "group", rw.query_id, article_id, label, metric, value FROM rw JOIN qn ON qn.query_id = rw.query_id WHERE value IS NOT NULL)"""


def stored_scores(spark, sf_dir):
    """Predictions are retrieved once and stored; from them the score rows are made and stored."""
    path = shared_folder(spark)
    hits, pairs = retrieval.hits_and_gold(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("article_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    questions = pairs.groupBy(F.col("query_id").alias("question_id")).agg(F.min("id").alias("article_id")).join(labels, "article_id", "left").withColumn("label", F.col("quality").cast("string"))
    scored = lambda found, ks: metrics.per_query(retrieval.samples_of(found, pairs), ks).select(F.col("query_id").alias("question_id"), *metrics.metric_columns(ks))
    groups = {
        "retrieval": scored(hits, KS),
        "reranked": scored(retrieval.reranked(spark, sf_dir, found=hits), SHORT_KS),
        "judge": questions.select("question_id", "quality", (1 - F.col("toxic")).alias("harmless")),
    }
    reports.score_rows("bm25", questions, groups).write.parquet(f"{path}/scores")
    return spark.read.schema(reports.SCORES).parquet(f"{path}/scores")


@query(f"""WITH {SCORED} SELECT 'bm25' AS run, "group", CAST(query_id AS VARCHAR) AS question_id, CAST(article_id AS VARCHAR) AS article_id, label, metric, round(value, 9) AS value FROM sc""")
def score_table(spark, sf_dir):
    """Per-question score rows: retrieval, reranked retrieval, and the labels of the article as a judge's verdict."""
    return rounded(stored_scores(spark, sf_dir), "value")


@query(
    f"""WITH {SCORED}, gm AS (SELECT "group", metric, avg(value) AS value FROM sc GROUP BY ALL), gl AS (SELECT "group" || ':label:' || label AS "group", metric, avg(value) AS value FROM sc GROUP BY ALL),
    ga AS (SELECT "group" || ':macro' AS "group", metric, avg(value) AS value FROM (SELECT "group", article_id, metric, avg(value) AS value FROM sc GROUP BY ALL) GROUP BY ALL),
    gd AS (SELECT 'delta' AS "group", a.metric, a.value - b.value AS value FROM gm a JOIN gm b ON a.metric = b.metric WHERE a."group" = 'reranked' AND b."group" = 'retrieval')
    SELECT 'bm25' AS run, "group", metric, round(value, 9) AS value FROM (SELECT * FROM gm UNION ALL SELECT * FROM gl UNION ALL SELECT * FROM ga UNION ALL SELECT * FROM gd)"""
)
def score_report(spark, sf_dir):
    """One report over the stored score rows: means, macro means, means by label, the judge, and what reranking changed."""
    return rounded(reports.score_report(stored_scores(spark, sf_dir)), "value")


CHUNKS = ["total_chunks", "mean_tokens", "std_tokens", "min_tokens", "max_tokens", "duplicate_rate", "sentence_end_rate", "size_compliance", "chunks_per_article_mean", "chunks_per_article_std"]


@query(
    f"""WITH ch AS ({SQL["chunk_stats"]}), du AS ({SQL["dedup_rate"]}), se AS ({SQL["semantic_integrity"]}), co AS ({SQL["metadata_completeness"]}), sr AS ({SQL["self_retrieval"]})
    {" UNION ALL ".join(group_sql(f"'{g}'", tall_sql(s, n)).replace("'bm25'", "'corpus'") for g, s, n in (
        ("chunks", "ch", CHUNKS), ("duplicates", "du", ["duplicate_rate"]), ("sentences", "se", ["sentence_end_rate"]), ("metadata", "co", ["metadata_completeness"]), ("retrieval", "sr", ["asked", "recall_at_1"])))}"""
)
def corpus_report(spark, sf_dir):
    """Chunk sizes, duplicates, sentence ends, metadata and self-retrieval of a corpus as one tall report."""
    groups = {
        "chunks": metrics.tall(corpus.chunk_stats(spark, sf_dir), CHUNKS),
        "duplicates": metrics.tall(corpus.dedup_rate(spark, sf_dir), ["duplicate_rate"]),
        "sentences": metrics.tall(corpus.semantic_integrity(spark, sf_dir), ["sentence_end_rate"]),
        "metadata": metrics.tall(corpus.metadata_completeness(spark, sf_dir), ["metadata_completeness"]),
        "retrieval": metrics.tall(retrieval.self_retrieval(spark, sf_dir), ["asked", "recall_at_1"]),
    }
    return rounded(reports.build(groups, "corpus"), "value")


@query("SELECT conv_id, turn, coalesce(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d{1,9})\\]', 1), lambda x: CAST(x AS INTEGER))), []) AS cited_set, length(text) AS n FROM conversations".replace("coalesce(list_distinct", "list_sort(list_distinct").replace(", []) AS cited_set", ") AS cited_set"))
def conversation_citations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(fx.citations(F.col("text"))).alias("cited_set"), F.length("text").alias("n"))
