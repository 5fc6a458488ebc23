"""Queries over documents: chunks, chunk statistics, evidence mapping, samples and test sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import chunking, metrics, sampling
from ..session import sent, table
from .registry import query
from .retrieval import CONTAINS, MAX_ITEMS, gold, rounded

LINES = r"""
l0 AS (SELECT doc_id AS article_id, text AS body, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l1 AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start FROM l0),
ln AS (SELECT article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, char_start, CAST(char_start + length(text) AS INTEGER) AS char_end, text FROM l1 WHERE trim(text, ' ') <> ''),
lc AS (SELECT article_id || '_' || chunk_index AS id, * FROM ln)
"""
N_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
ENDS = r"""CAST(regexp_matches(trim(text, ' '), '[.!?]["'')\]]?$') AS DOUBLE)"""


def lines(spark, sf_dir):
    return chunking.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {LINES} SELECT id, article_id, chunk_index, char_start, char_end, md5(text) AS text_md5 FROM lc")
def line_chunks(spark, sf_dir):
    return lines(spark, sf_dir).select("id", "article_id", "chunk_index", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    r"""WITH s AS (SELECT doc_id AS article_id, list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
    w AS (SELECT article_id, s, unnest(range(1, greatest(1, len(s) - 2) + 1, 6)) AS i FROM s WHERE len(s) > 0)
    SELECT article_id, CAST((i - 1) / 6 AS INTEGER) AS chunk_index, md5(array_to_string(s[i:i + 7], ' ')) AS text_md5 FROM w"""
)
def sentence_chunks(spark, sf_dir):
    out = chunking.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("article_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS whole_md5, true AS has_chunks FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''")
def semantic_cover(spark, sf_dir):
    """The semantic chunks of a document, put together in order, are its sentences and nothing else."""
    cut = semantic_chunks(spark, sf_dir).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "text")))["text"], " ").alias("whole"), F.max("chunk_index").alias("last"), F.count("*").alias("n"))
    return cut.select(F.col("article_id").alias("doc_id"), F.md5(F.col("whole").cast("binary")).alias("whole_md5"), (F.col("n") == F.col("last") + 1).alias("has_chunks"))


@query(
    f"""WITH {LINES}, m AS (SELECT article_id, {N_TOKENS} AS n, md5(text) AS h, {ENDS} AS e FROM lc), p AS (SELECT article_id, count(*) AS c FROM m GROUP BY 1)
    SELECT count(*) AS total_chunks, round(avg(n), 9) AS mean_tokens, round(stddev_pop(n), 9) AS std_tokens, min(n) AS min_tokens, max(n) AS max_tokens, round(1 - count(DISTINCT h) / count(*), 9) AS duplicate_rate,
    round(avg(e), 9) AS sentence_end_rate, round(avg(CAST(n BETWEEN 1 AND 512 AS DOUBLE)), 9) AS size_compliance, (SELECT round(avg(c), 9) FROM p) AS chunks_per_article_mean, (SELECT round(stddev_pop(c), 9) FROM p) AS chunks_per_article_std FROM m"""
)
def chunk_stats(spark, sf_dir):
    out = metrics.chunk_statistics(lines(spark, sf_dir), 512)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("SELECT round(1 - count(DISTINCT md5(text)) / count(*), 9) AS duplicate_rate FROM documents")
def dedup_rate(spark, sf_dir):
    return rounded(metrics.duplicate_rate(table(spark, sf_dir, "documents")), "duplicate_rate")


@query(f"SELECT round(avg({ENDS}), 9) AS sentence_end_rate FROM documents")
def semantic_integrity(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(F.avg(fx.ends_sentence(F.col("text")).cast("double")), 9).alias("sentence_end_rate"))


@query(f"WITH h AS (SELECT CAST(floor({N_TOKENS} / 100) * 100 AS BIGINT) AS bin FROM documents) SELECT bin, count(*) AS n FROM h GROUP BY bin")
def token_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "documents"), fx.token_count(F.col("text")), 100)


@query("SELECT round(avg(CAST(text IS NOT NULL AND trim(text, ' ') <> '' AND lang IS NOT NULL AND trim(lang, ' ') <> '' AND source IS NOT NULL AND trim(source, ' ') <> '' AS DOUBLE)), 9) AS metadata_completeness FROM documents")
def metadata_completeness(spark, sf_dir):
    return rounded(metrics.completeness(table(spark, sf_dir, "documents"), ["text", "lang", "source"]), "metadata_completeness")


def evidence(spark, sf_dir):
    """Benchmark items as questions whose evidence is their place in a document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    pairs = gold(spark, sf_dir).withColumnsRenamed({"id": "article_id"}).join(sent(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")), MAX_ITEMS), "query_id")
    placed = pairs.join(docs.select(F.col("doc_id").alias("article_id"), "text"), "article_id")
    start = F.call_function("locate", F.col("item"), F.col("text")) - 1
    return placed.select(F.concat_ws("_", F.col("query_id").cast("string"), F.col("article_id").cast("string")).alias("question_id"), "article_id", start.alias("start"), (start + F.length("item")).alias("end"))


SPANS = f"{CONTAINS}, sp AS (SELECT query_id || '_' || id AS question_id, id AS article_id, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e FROM g JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)"


@query(f"WITH {LINES}, {SPANS} SELECT question_id, list_sort(list(DISTINCT id)) AS relevant_chunk_ids FROM sp JOIN lc ON lc.article_id = sp.article_id AND char_start < e AND s < char_end GROUP BY 1")
def evidence_to_chunk(spark, sf_dir):
    return chunking.relevant_chunks(evidence(spark, sf_dir), lines(spark, sf_dir))


@query(f"WITH {LINES}, {SPANS}, x AS (SELECT question_id, article_id FROM sp) SELECT question_id, list_sort(list(lc.id)) AS article_chunk_ids, count(*) AS n FROM x JOIN lc USING (article_id) GROUP BY 1")
def testset_article_chunks(spark, sf_dir):
    q = evidence(spark, sf_dir).select("question_id", "article_id")
    return q.join(lines(spark, sf_dir).select("article_id", "id"), "article_id").groupBy("question_id").agg(F.array_sort(F.collect_list("id")).alias("article_chunk_ids"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def sample_articles(spark, sf_dir):
    """A sampling operator: its size is the feature."""
    return sampling.sample(table(spark, sf_dir, "documents"), "doc_id", 50, 42).select("doc_id")


NORMAL = r"sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')))"


@query(
    f"""WITH h AS (SELECT doc_id, {NORMAL} AS h FROM documents), e AS (SELECT doc_id, h FROM h ORDER BY sha256('7:' || doc_id), doc_id LIMIT 40),
    r AS (SELECT doc_id FROM h WHERE h NOT IN (SELECT h FROM e) ORDER BY sha256('8:' || doc_id), doc_id LIMIT 100) SELECT doc_id, 'evaluation' AS role FROM e UNION ALL SELECT doc_id, 'distractor' FROM r"""
)
def selection_bundle(spark, sf_dir):
    return sampling.selection_bundle(table(spark, sf_dir, "documents"), "doc_id", 40, 100, 7).select("doc_id", "role")


@query(f"WITH e AS (SELECT {NORMAL} AS h FROM documents WHERE source = 'src0') SELECT doc_id FROM documents WHERE {NORMAL} NOT IN (SELECT h FROM e)")
def leakage_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.without_leaks(docs, docs.filter("source = 'src0'")).select("doc_id")


@query(f"SELECT doc_id, 'doc_' || left(sha256(text), 16) AS content_id, {NORMAL} AS normalized, left(md5(CASE WHEN lang = 'en' THEN source ELSE CAST(doc_id AS VARCHAR) END), 12) AS article_id FROM documents")
def content_hashes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", fx.content_id(t).alias("content_id"), fx.normalized_hash(t).alias("normalized"), fx.article_id(F.when(F.col("lang") == "en", F.col("source")).otherwise(""), F.col("doc_id").cast("string")).alias("article_id"))


@query("SELECT doc_id, coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 160), '') AS title FROM documents")
def derived_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.derived_title(F.col("text")).alias("title"))


QUANTILES = ", ".join(f"max(CASE WHEN rn = CAST(round_even((n - 1) * CAST({f} AS DOUBLE), 0) AS BIGINT) + 1 THEN value END) AS p{round(f * 100)}" for f in (0.25, 0.5, 0.75, 0.95))


@query(
    f"""WITH v AS (SELECT 'chars' AS metric, length(text) AS value FROM documents UNION ALL SELECT 'lines', len(string_split(text, chr(10))) FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM v)
    SELECT metric, max(n) AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, {QUANTILES} FROM r GROUP BY metric"""
)
def distribution_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stacked = docs.select(F.explode(F.array(F.struct(F.lit("chars").alias("metric"), F.length("text").cast("long").alias("value")), F.struct(F.lit("lines").alias("metric"), F.size(F.split("text", "\n")).cast("long").alias("value")))).alias("m")).select("m.*")
    return rounded(metrics.distribution_summary(stacked, "metric", "value"), "mean")


@query(
    f"""WITH {SPANS}, k AS (SELECT article_id, count(*) AS n FROM sp GROUP BY 1), a AS (SELECT doc_id, length(text) AS chars, coalesce(n, 0) AS n FROM documents LEFT JOIN k ON article_id = doc_id),
    c AS (SELECT * FROM a WHERE n > 0), x AS (SELECT s / greatest(chars, 1) AS place, e - s AS size FROM sp JOIN a ON doc_id = article_id),
    v AS (SELECT 'candidate_article_chars' AS metric, CAST(chars AS DOUBLE) AS value FROM a UNION ALL SELECT 'candidate_questions_per_article', n FROM a UNION ALL SELECT 'selected_article_chars', chars FROM c UNION ALL SELECT 'selected_questions_per_article', n FROM c
      UNION ALL SELECT 'selected_question_chars', size FROM x UNION ALL SELECT 'selected_answer_chars', size FROM x UNION ALL SELECT 'selected_normalized_answer_position', place FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM v WHERE value IS NOT NULL)
    SELECT metric, max(n) AS count, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean, {QUANTILES.replace("END)", "END), 9)").replace("max(CASE", "round(max(CASE")} FROM r GROUP BY metric"""
)
def selection_coverage(spark, sf_dir):
    """Documents as candidates; those that hold a benchmark item are the selection, the item being question and answer."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    held = evidence(spark, sf_dir).join(docs, "article_id")
    item = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    asked = held.select("article_id", item.alias("question"), item.alias("answer"), "start")
    out = metrics.selection_coverage(docs, asked.select("article_id"), asked)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(f"SELECT quantile_cont({N_TOKENS}, 0.5) AS median FROM documents")
def token_median(spark, sf_dir):
    return metrics.median(table(spark, sf_dir, "documents"), fx.token_count(F.col("text")))


@query("SELECT source, count(*) AS n, max(length(text)) AS longest FROM documents GROUP BY source")
def articles_per_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("WITH h AS (SELECT sum(CAST(CAST('0x' || left(md5(doc_id || ':' || text), 15) AS BIGINT) AS HUGEINT)) AS s, count(*) AS n FROM documents) SELECT sha256(n || ':' || s) AS payload_hash, n FROM h")
def payload_fingerprint(spark, sf_dir):
    """Order-independent hash of a set of articles: of their number and the sum of 60-bit row hashes, so nothing is gathered."""
    row = F.conv(F.left(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)")
    sums = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(row).alias("s"))
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256).alias("payload_hash"), "n")


@query(
    f"""WITH {SPANS} SELECT question_id, d.text[s + 1:e] = b.text AS valid, length(d.text) AS n FROM sp JOIN documents d ON d.doc_id = sp.article_id JOIN benchmark b ON question_id = b.item_id || '_' || sp.article_id"""
)
def span_validation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("quote"))
    rows = evidence(spark, sf_dir).join(docs, "article_id").withColumn("item", F.substring_index("question_id", "_", 1)).join(sent(items, MAX_ITEMS), "item")
    return rows.select("question_id", fx.spans_valid(F.col("text"), F.array(F.struct("start", "end", F.col("quote").alias("text")))).alias("valid"), F.length("text").alias("n"))


@query(
    f"""WITH {SPANS}, w AS (SELECT question_id, s, e, d.text AS t, greatest(s - 450, 0) AS lo, least(e + 450, length(d.text)) AS hi FROM sp JOIN documents d ON d.doc_id = sp.article_id)
    SELECT question_id, md5(t[lo + 1:s] || '[EVIDENCE]' || t[e + 1:hi]) AS window_md5 FROM w"""
)
def redacted_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    rows = evidence(spark, sf_dir).join(docs, "article_id")
    spans = F.array(F.struct("start", "end"))
    return rows.select("question_id", F.md5(fx.redacted_window(F.col("text"), spans).cast("binary")).alias("window_md5"))


@query(
    r"""WITH f AS (SELECT conv_id, turn, role, text, lower(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ')) AS n FROM conversations),
    p AS (SELECT u.conv_id, u.turn, u.n AS g, a.n AS p, list_filter(string_split(u.n, ' '), lambda x: x <> '') AS gw, list_filter(string_split(a.n, ' '), lambda x: x <> '') AS pw FROM f u JOIN f a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
    s AS (SELECT CAST(g = p AS DOUBLE) AS em, CASE WHEN len(gw) > 0 AND len(pw) > 0 THEN 2.0 * coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0) / (len(gw) + len(pw)) ELSE 0 END AS f1 FROM p)
    SELECT count(*) AS n, round(avg(em), 9) AS exact_match, round(avg(f1), 9) AS f1 FROM s"""
)
def qa_em_f1(spark, sf_dir):
    """Each turn as the prediction for the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = turns.join(asked, ["conv_id", "turn"]).select(F.col("text").alias("prediction"), F.array(F.coalesce("truth", F.lit(""))).alias("accepted_answers"))
    return rounded(metrics.evaluate_answers(pairs), "exact_match", "f1")


@query(
    """WITH a AS (SELECT doc_id, list_transform(range(1, 1 + CAST(doc_id % 4 AS INTEGER)), lambda i: 'c' || (i + doc_id % 3)) AS cited, CASE WHEN doc_id % 5 = 0 THEN [9] ELSE [] END AS bad, ['c1', 'c3'] AS rel FROM documents),
    s AS (SELECT *, len(cited) AS n, len(list_intersect(cited, rel)) AS good FROM a),
    m AS (SELECT CASE WHEN n + len(bad) > 0 THEN n / (n + len(bad)) ELSE 0 END AS v, CASE WHEN n > 0 THEN good / n ELSE 0 END AS p, good / 2 AS r, CAST(n > 0 AS DOUBLE) AS c FROM s)
    SELECT round(avg(v), 9) AS citation_validity, round(avg(p), 9) AS citation_precision, round(avg(r), 9) AS citation_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS citation_f1, round(avg(c), 9) AS citation_coverage FROM m"""
)
def citations_eval(spark, sf_dir):
    """Citations derived from document ids; the answers are parsed like real ones."""
    n, shift = F.col("doc_id") % 4, F.col("doc_id") % 3
    marks = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("["), (i + shift).cast("string"), F.lit("]"))), " ")
    answer = F.concat(F.lit("It is so "), F.when(n > 0, marks).otherwise(""), F.when(F.col("doc_id") % 5 == 0, " [9]").otherwise(""))
    rows = table(spark, sf_dir, "documents").select(fx.citations(answer).alias("cited"))
    samples = rows.select(
        F.transform(fx.valid_citations(F.col("cited"), F.lit(8)), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("citation_chunk_ids"),
        fx.invalid_citations(F.col("cited"), F.lit(8)).alias("invalid_citation_indices"),
        F.array(F.lit("c1"), F.lit("c3")).alias("relevant_chunk_ids"),
    )
    out = metrics.evaluate_citations(samples)
    return rounded(out, *out.columns)
