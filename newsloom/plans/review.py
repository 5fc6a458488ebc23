"""Queries over review rules, question clusters and scalar functions; rows derive from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import clusters, reports, review, runlog
from ..session import table
from .corpus import LINES, lines
from .registry import query
from .retrieval import tok

def bare(text: str) -> str:
    """Distinct words without the punctuation at their edges."""
    edges = r"""[.,;:!?"''()\[\]{}]+"""
    return f"list_distinct(list_filter(list_transform({tok(text)}, lambda w: regexp_replace(w, '^{edges}|{edges}$', '', 'g')), lambda w: w <> ''))"


# documents as questions: three of every six neighbouring ids form a cluster
ID = "CAST(doc_id AS VARCHAR)"
QUESTIONS = f"q AS (SELECT {ID} AS question_id, CAST(doc_id // 6 AS VARCHAR) AS article_id, doc_id, text AS question, [lang, source] AS accepted_answers, ['c' || (doc_id % 5)] AS relevant_chunk_ids FROM documents)"
CLUSTERS = """k AS (SELECT article_id, list_sort(list(question_id)) AS members, CAST(min(doc_id) AS VARCHAR) AS representative FROM q WHERE (doc_id // 3) % 2 = 0 GROUP BY article_id, doc_id // 3 HAVING count(*) >= 2),
kc AS (SELECT *, sha256('{"article_id":"' || article_id || '","members":["' || array_to_string(members, '","') || '"]}') AS cluster_id FROM k),
pt AS (SELECT unnest(members) AS question_id, cluster_id, representative FROM kc UNION ALL SELECT question_id, sha256('{"article_id":"' || article_id || '","members":["' || question_id || '"]}'), question_id FROM q WHERE question_id NOT IN (SELECT unnest(members) FROM kc))"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("question_id"), F.floor(F.col("doc_id") / 6).cast("string").alias("article_id"), "doc_id", F.col("text").alias("question"),
        F.array("lang", "source").alias("accepted_answers"), F.array(F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string"))).alias("relevant_chunk_ids"),
    )


def decided(spark, sf_dir):
    group = F.floor(F.col("doc_id") / 3)
    rows = questions(spark, sf_dir).filter(group % 2 == 0).groupBy("article_id", group.alias("g")).agg(F.array_sort(F.collect_list("question_id")).alias("members"), F.min("doc_id").cast("string").alias("representative"))
    rows = rows.filter(F.size("members") >= 2)
    return rows.select(clusters.stable_id(F.col("article_id"), F.col("members")).alias("cluster_id"), "article_id", "members", "representative", F.lit("same fact").alias("target"), F.lit("same answer").alias("rationale"))


@query(f"WITH {QUESTIONS}, {CLUSTERS} SELECT * FROM pt")
def cluster_partition(spark, sf_dir):
    return clusters.partition(decided(spark, sf_dir), questions(spark, sf_dir))


@query(
    f"""WITH {QUESTIONS}, {CLUSTERS}, r AS (SELECT pt.*, q.*, q.question_id <> representative AS later FROM pt JOIN q USING (question_id)),
    f AS (SELECT cluster_id, a, min(struct_pack(later := later, question_id := question_id, i := i)) AS place FROM (SELECT cluster_id, later, question_id, unnest(accepted_answers) AS a, generate_subscripts(accepted_answers, 1) AS i FROM r) GROUP BY 1, 2),
    g AS (SELECT cluster_id, list(a ORDER BY place) AS accepted_answers FROM f GROUP BY 1)
    SELECT r.cluster_id, any_value(representative) AS representative, max(CASE WHEN NOT later THEN question END) AS question, any_value(g.accepted_answers) AS accepted_answers,
    list_sort(list_distinct(flatten(list(relevant_chunk_ids)))) AS relevant_chunk_ids, list_sort(list(question_id)) AS members FROM r JOIN g ON g.cluster_id = r.cluster_id GROUP BY r.cluster_id"""
)
def dedup_merge(spark, sf_dir):
    placed = clusters.partition(decided(spark, sf_dir), questions(spark, sf_dir))
    return clusters.merged(placed, questions(spark, sf_dir))


@query(f"WITH {QUESTIONS}, {CLUSTERS} SELECT cluster_id, representative, list_transform(list_sort(list(question_id)), lambda x: x) AS ids, md5(string_agg(question_id || ':' || coalesce(question, '') || ':' || CAST(question_id = representative AS VARCHAR), chr(10) ORDER BY question_id)) AS members_md5 FROM pt JOIN q USING (question_id) GROUP BY 1, 2")
def cluster_records(spark, sf_dir):
    """Clusters with their members' questions nested."""
    placed = clusters.partition(decided(spark, sf_dir), questions(spark, sf_dir))
    member = lambda m: F.concat(m["question_id"], F.lit(":"), F.coalesce(m["question"], F.lit("")), F.lit(":"), m["representative"].cast("string"))
    rows = clusters.records(placed, questions(spark, sf_dir))
    return rows.select("cluster_id", "representative", F.col("members.question_id").alias("ids"), F.md5(F.array_join(F.transform("members", member), "\n").cast("binary")).alias("members_md5"))


@query(f"WITH {QUESTIONS}, {CLUSTERS} SELECT count(DISTINCT cluster_id) AS clusters, count(DISTINCT CASE WHEN question_id <> representative THEN cluster_id END) AS with_duplicates, count(*) FILTER (question_id <> representative) AS removed FROM pt")
def duplicate_summary(spark, sf_dir):
    placed = clusters.partition(decided(spark, sf_dir), questions(spark, sf_dir))
    return clusters.summary(clusters.merged(placed, questions(spark, sf_dir)))


@query(f"WITH {QUESTIONS}, {CLUSTERS} SELECT question_id, cluster_id, representative FROM pt WHERE question_id <> representative")
def removed_questions(spark, sf_dir):
    return clusters.removed(clusters.partition(decided(spark, sf_dir), questions(spark, sf_dir)))


@query(
    """WITH c AS (SELECT 'c' || doc_id AS cluster_id, doc_id FROM documents)
    SELECT cluster_id, rule FROM (SELECT cluster_id, unnest([CASE WHEN doc_id % 4 = 0 THEN 'too_few_members' END, CASE WHEN doc_id % 5 = 0 THEN 'foreign_representative' END, CASE WHEN doc_id % 6 = 0 THEN 'rationale_missing' END]) AS rule FROM c) WHERE rule IS NOT NULL"""
)
def cluster_rules(spark, sf_dir):
    me = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), me).alias("cluster_id"), me.alias("article_id"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("a"), me))).otherwise(F.array(F.concat(F.lit("a"), me), F.concat(F.lit("b"), me))).alias("members"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("z")).otherwise(F.concat(F.lit("a"), me)).alias("representative"),
        F.lit("t").alias("target"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise("r").alias("rationale"),
    )
    known = rows.select(F.explode("members").alias("question_id"), "article_id")
    return clusters.violations(rows, known)


TRIAGE = """t AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, (['standalone', 'context_dependent', 'uncertain', 'other'])[1 + CAST(doc_id % 4 AS INTEGER)] AS label, doc_id % 3 = 0 AS no_reason, CASE WHEN doc_id % 7 = 0 THEN 1.5 ELSE 0.5 END AS confidence, text,
  CASE WHEN doc_id % 5 = 0 THEN substr(text, 3, 12) WHEN doc_id % 5 = 1 THEN 'not in it at all' ELSE '' END AS quote, doc_id % 11 = 0 AS leak FROM documents),
v AS (SELECT question_id, unnest([CASE WHEN label = 'other' THEN 'unknown_label' END, CASE WHEN confidence > 1 THEN 'confidence_range' END, CASE WHEN label <> 'standalone' AND no_reason THEN 'reason_missing' END, CASE WHEN leak THEN 'answer_leak' END,
  CASE WHEN length(quote) > 0 AND NOT contains(substr(text, 10), quote) THEN 'quote_unsupported' END]) AS rule FROM t)"""


def triage(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("question_id"),
        F.element_at(F.array(*[F.lit(x) for x in (*review.LABELS, "other")]), (d % 4 + 1).cast("int")).alias("label"),
        F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("pronoun"))).alias("reason_codes"),
        F.when(d % 7 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.when(d % 11 == 0, "when was The Answer given").otherwise("when was it").alias("clarified"),
        F.lit("the answer").alias("answer"),
        F.when(d % 5 == 0, F.substring("text", 3, 12)).when(d % 5 == 1, "not in it at all").otherwise("").alias("quote"),
        F.col("text").alias("context"),
        F.array(F.struct(F.lit(0).alias("start"), F.lit(9).alias("end"))).alias("spans"),
    )


@query(f"WITH {TRIAGE} SELECT question_id, rule FROM v WHERE rule IS NOT NULL")
def review_rules(spark, sf_dir):
    """The evidence span covers the first nine characters, so a quote counts only behind them."""
    return review.triage_violations(triage(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS question_id, unnest([CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'x' END]) AS rule FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'e' || doc_id, 'extra' FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'repeated' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0")
def coverage_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("question_id"))
    given = docs.filter("doc_id % 3 <> 0").select("question_id")
    given = given.unionByName(docs.filter("doc_id % 3 <> 0 AND doc_id % 5 = 0").select("question_id")).unionByName(docs.filter("doc_id % 8 = 0").select(F.concat(F.lit("e"), "question_id").alias("question_id")))
    return review.coverage_violations(docs, given)


@query(
    """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, text AS question, CASE WHEN doc_id % 3 = 0 THEN 'context_dependent' ELSE 'standalone' END AS label, CASE WHEN doc_id % 6 = 0 THEN 'clear ' || doc_id ELSE '' END AS clarified, doc_id % 10 = 0 AS excluded FROM documents)
    SELECT 'reviewed' AS variant, question_id, question FROM a WHERE NOT excluded
    UNION ALL SELECT 'resolved', question_id, CASE WHEN label = 'context_dependent' AND clarified <> '' THEN clarified ELSE question END FROM a WHERE NOT excluded
    UNION ALL SELECT 'clarified', question_id, CASE WHEN label = 'context_dependent' AND clarified <> '' THEN clarified ELSE question END FROM a WHERE NOT excluded AND clarified <> ''
    UNION ALL SELECT 'excluded', question_id, CASE WHEN label = 'context_dependent' AND clarified <> '' THEN clarified ELSE question END FROM a WHERE excluded"""
)
def testset_variants(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    testset = docs.select(d.cast("string").alias("question_id"), F.col("text").alias("question"))
    notes = docs.select(d.cast("string").alias("question_id"), F.when(d % 3 == 0, "context_dependent").otherwise("standalone").alias("label"), F.when(d % 6 == 0, F.concat(F.lit("clear "), d.cast("string"))).otherwise("").alias("clarified"), (d % 10 == 0).alias("excluded"))
    return review.derived_testsets(testset, notes).select("variant", "question_id", "question")


@query(
    """WITH v AS (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS label, CASE WHEN l.toxic IS NOT NULL THEN CASE l.toxic WHEN 1 THEN 'reject' ELSE 'accept' END END AS decision,
      list_filter([CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN d.n_chars < 200 THEN 'short' END, CASE WHEN l.quality = 0 THEN lang END], lambda x: x IS NOT NULL) AS codes
      FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))
    SELECT kind, value, count(*) AS n FROM (SELECT 'label' AS kind, coalesce(label, 'none') AS value FROM v UNION ALL SELECT 'decision', coalesce(decision, 'none') FROM v UNION ALL SELECT 'issue', unnest(codes) FROM v
      UNION ALL SELECT 'ready', (SELECT CAST(bool_and(decision IS NOT NULL) AS VARCHAR) FROM v) FROM v) GROUP BY kind, value"""
)
def review_status(spark, sf_dir):
    """Documents as review rows: what the labels say of them, and what is short or in which language poor."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    codes = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short"), F.when(F.col("quality") == 0, F.col("lang"))))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("question_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("label"),
        F.when(F.col("toxic") == 1, "reject").when(F.col("toxic") == 0, "accept").alias("decision"), codes.alias("reason_codes"),
    )
    return reports.review_status(rows)


@query(
    f"""WITH RECURSIVE {LINES},
    o AS (SELECT article_id, n, row_number() OVER (ORDER BY article_id) AS place FROM (SELECT article_id, count(*) AS n FROM lc GROUP BY article_id)),
    walked AS (
      SELECT article_id, place, 0 AS packet, 1 AS held, n AS total FROM o WHERE place = 1
      UNION ALL
      SELECT o.article_id, o.place, CASE WHEN held = 20 OR total + n > 150 THEN packet + 1 ELSE packet END, CASE WHEN held = 20 OR total + n > 150 THEN 1 ELSE held + 1 END, CASE WHEN held = 20 OR total + n > 150 THEN n ELSE total + n END
      FROM walked JOIN o ON o.place = walked.place + 1
    )
    SELECT article_id, CAST(packet AS INTEGER) AS packet FROM walked"""
)
def review_packets(spark, sf_dir):
    """Documents as articles and their lines as the questions on them."""
    counts = lines(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("n"))
    return review.packets(counts)


@query(
    rf"""WITH b AS (SELECT item_id, text FROM benchmark), d AS (SELECT doc_id, text, list_distinct({tok('text')}) AS ws FROM documents),
    q AS (SELECT item_id, list_distinct({tok('text')}) AS qs FROM b),
    s AS (SELECT item_id, doc_id, len(list_intersect(ws, qs)) AS score FROM q, d WHERE len(list_intersect(ws, qs)) > 0 AND doc_id <> item_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s),
    l AS (SELECT r.*, list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls, {bare('b.text')} AS terms FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 3),
    z AS (SELECT *, list_max(list_transform(ls, lambda x, i: struct_pack(hits := len(list_intersect({bare('x')}, terms)), place := -i, line := x))) AS best FROM l)
    SELECT item_id AS question_id, rank, doc_id AS article_id, left(coalesce(best.line, ''), 420) AS snippet FROM z"""
)
def competing_candidates(spark, sf_dir):
    """Articles that share most words with an item, its own namesake left out, with their best lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    words = docs.select("article_id", F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("w"))
    asked = items.select("question_id", F.explode(F.array_distinct(fx.tokens(F.col("question")))).alias("w"))
    scored = words.join(asked, "w").groupBy("question_id", "article_id").agg(F.count("*").cast("double").alias("score")).withColumn("source_article_id", F.col("question_id"))
    return review.competing_candidates(scored, docs, items).select("question_id", "rank", "article_id", "snippet")


@query("WITH e AS (SELECT event_id, CAST(event_id % 6 AS INTEGER) AS k, props FROM events) SELECT event_id, ([200, 429, 503, 401, 404, 418])[k + 1] AS code, (['other', 'retryable', 'retryable', 'fatal', 'fatal', 'other'])[k + 1] AS error_class, left(coalesce(replace(props, 'key', '***'), ''), 500) AS message FROM e")
def error_classes(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 429, 503, 401, 404, 418)]), (F.col("event_id") % 6 + 1).cast("int"))
    return runlog.classified_errors(table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.col("props").alias("message")), "code", "message", "key").select("event_id", "code", "error_class", "message")


@query(f"SELECT doc_id, len({tok('text')}) AS n_tokens, sha256('{{\"a\":\"' || lang || '\",\"b\":\"' || source || '\"}}') AS row_hash FROM documents")
def stable_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(fx.tokens(F.col("text"))).alias("n_tokens"), F.col("source").alias("b"), F.col("lang").alias("a"))
    return rows.withColumn("row_hash", fx.stable_hash("b", "a")).select("doc_id", "n_tokens", "row_hash")


@query(
    r"""WITH s AS (SELECT item_id, regexp_replace(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'), ' '), '\s*[?!.]+$', '') AS normalized,
      regexp_replace(left(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS slug FROM benchmark)
    SELECT item_id, normalized, CASE WHEN slug = '' THEN 'article' ELSE slug END AS slug FROM s"""
)
def normalized_questions(spark, sf_dir):
    """Unicode normalisation and slugs; the SQL spells out what they do to the letters of these tables."""
    return table(spark, sf_dir, "benchmark").select("item_id", fx.normalized_question(F.col("text")).alias("normalized"), fx.slug(F.col("text")).alias("slug"))


@query("SELECT conv_id, turn, sha256('Context:' || chr(10) || '[1] ' || coalesce(text, '') || chr(10) || chr(10) || '[2] ' || role || chr(10) || chr(10) || 'Question: ' || role || chr(10) || 'Answer with citations:') AS prompt_sha256 FROM conversations")
def prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", fx.sha256_text(fx.prompt(F.col("role"), F.array(F.coalesce("text", F.lit("")), "role"))).alias("prompt_sha256"))
