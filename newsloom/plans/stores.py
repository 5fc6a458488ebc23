"""Queries that write what they derive, read it back through the readers, and check it: lines, logs, snapshots, reviews, reports, collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as fx
from ..operators import chunking, dense, reports, review, runlog, sampling, seams, sparse
from ..session import shared_folder, table
from ..sources import readers, sinks, tables
from .corpus import LINES, SPANS, evidence, lines
from .ingest import page_chunks
from .registry import query
from .retrieval import BM25, K, rounded
from .runs import REPORT, report


@query(f"WITH {LINES} SELECT id, article_id, chunk_index, char_start, char_end, md5(text) AS text_md5 FROM lc")
def stored_chunks(spark, sf_dir):
    """Chunks written as JSON lines and read with their schema."""
    path = shared_folder(spark)
    sinks.json_lines(lines(spark, sf_dir), path)
    rows = readers.json_lines(spark, path, schemas.CHUNKS)
    return rows.select("id", F.col("article_id").cast("long").alias("article_id"), "chunk_index", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


TESTSET = f"{LINES}, {SPANS}, ts AS (SELECT question_id, sp.article_id, any_value(s) AS s, any_value(e) AS e, list_sort(list(DISTINCT id)) AS relevant_chunk_ids FROM sp JOIN lc ON lc.article_id = sp.article_id AND char_start < e AND s < char_end GROUP BY 1, 2)"


def questions(spark, sf_dir):
    """Benchmark items with their evidence in the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    placed = evidence(spark, sf_dir).join(docs, "article_id")
    return placed.withColumn("evidence", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")


def articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text", "lang")


@query(f"WITH {TESTSET} SELECT question_id, CAST(article_id AS VARCHAR) AS article_id, relevant_chunk_ids, s AS start, e AS \"end\" FROM ts")
def stored_testset(spark, sf_dir):
    """The chunked test set, checked, written as JSON lines and read with its schema."""
    path = shared_folder(spark)
    made = chunking.chunked_testset(questions(spark, sf_dir), articles(spark, sf_dir), lines(spark, sf_dir))
    spans = F.array(F.struct("start", "end", F.col("evidence").alias("text")))
    sinks.json_lines(made.select("question_id", F.col("article_id").cast("string").alias("article_id"), "relevant_chunk_ids", spans.alias("evidence_spans")), path)
    rows = readers.json_lines(spark, path, schemas.TESTSET)
    return rows.select("question_id", "article_id", "relevant_chunk_ids", F.col("evidence_spans")[0]["start"].alias("start"), F.col("evidence_spans")[0]["end"].alias("end"))


@query(f"WITH {TESTSET} SELECT question_id, unnest(relevant_chunk_ids) AS chunk_id FROM ts JOIN documents ON doc_id = article_id WHERE lang IS DISTINCT FROM 'en'")
def missing_chunks(spark, sf_dir):
    """Relevant chunks that a collection of English articles lacks."""
    docs = articles(spark, sf_dir)
    made = questions(spark, sf_dir).join(chunking.relevant_chunks(questions(spark, sf_dir), lines(spark, sf_dir)), "question_id")
    english = lines(spark, sf_dir).join(docs.filter("lang = 'en'").select("article_id"), "article_id", "left_semi")
    return chunking.missing_chunks(made, english)


@query(
    f"""WITH {LINES}, {SPANS} SELECT question_id, 'no_chunk' AS rule FROM sp JOIN documents ON doc_id = article_id WHERE lang IS DISTINCT FROM 'en'
    UNION ALL SELECT question_id, CASE WHEN source = 'src0' THEN 'unknown_article' WHEN text[s + 2:e + 1] <> text[s + 1:e] THEN 'evidence_moved' END AS rule FROM sp JOIN documents ON doc_id = article_id WHERE source = 'src0' OR text[s + 2:e + 1] <> text[s + 1:e]"""
)
def derivation_rules(spark, sf_dir):
    """Rules that questions break if articles of one source are gone, all texts have moved by a character, and only English chunks exist."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text", "lang", "source")
    moved = docs.filter("source IS DISTINCT FROM 'src0'").select("article_id", F.substring("text", 2, 1 << 30).alias("text"))
    english = lines(spark, sf_dir).join(docs.filter("lang = 'en'").select("article_id"), "article_id", "left_semi")
    return chunking.derivation_violations(questions(spark, sf_dir), moved, english)


@query(f"WITH {TESTSET} SELECT question_id, CASE WHEN lang = 'en' THEN relevant_chunk_ids ELSE ['old'] END AS relevant_chunk_ids FROM ts JOIN documents ON doc_id = article_id")
def remapped_evidence(spark, sf_dir):
    """Questions on English articles count as changed and get their chunks anew."""
    rows = questions(spark, sf_dir).join(articles(spark, sf_dir).select("article_id", "lang"), "article_id")
    rows = rows.select("question_id", "article_id", "start", "end", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("answer_modified"), F.array(F.lit("old")).alias("relevant_chunk_ids"))
    return review.remapped_evidence(rows, lines(spark, sf_dir)).select("question_id", "relevant_chunk_ids")


@query("SELECT event_id, event_type, user_id FROM events")
def stored_log(spark, sf_dir):
    """Events appended to a run log in two writes, read as lines; torn or broken lines would be an error."""
    path, events = shared_folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("run"))
    for part in ("user_id % 2 = 0", "user_id % 2 <> 0 OR user_id IS NULL"):
        sinks.append_log(events.filter(part), path)
    good, torn, broken = readers.log(spark, path)
    review.require_none(torn.unionByName(broken).select("file", "line"), "lines that are no records")
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return good.select(get("event_id", "long"), get("event_type", "string"), get("user_id", "long"))


@query("SELECT event_type, count(*) AS sound, CAST(sum(event_id) AS BIGINT) AS ids, 1 AS torn, '{\"event_id\":' AS torn_line FROM events GROUP BY event_type")
def quarantined_log(spark, sf_dir):
    """A log of a file per event type, each with a torn last line that is set aside while the rest is read."""
    path, aside = shared_folder(spark), shared_folder(spark)
    events = table(spark, sf_dir, "events").select("event_type", F.to_json(F.struct("event_id", "event_type")).alias("value"), F.lit(0).alias("last"))
    torn = events.select("event_type").distinct().select("event_type", F.lit('{"event_id":').alias("value"), F.lit(1).alias("last"))
    events.unionByName(torn).repartition("event_type").sortWithinPartitions("event_type", "last").select("event_type", "value").write.partitionBy("event_type").text(path)
    good = readers.quarantined_log(spark, path, aside)
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    sound = good.select(get("event_id", "long"), get("event_type", "string")).groupBy("event_type").agg(F.count("*").alias("sound"), F.sum("event_id").alias("ids"))
    bad = readers.set_aside(spark, aside).select(F.regexp_extract("file", "event_type=([^/]*)", 1).alias("event_type"), "line").groupBy("event_type").agg(F.count("*").cast("int").alias("torn"), F.max("line").alias("torn_line"))
    return sound.join(bad, "event_type", "left")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en'")
def pinned_snapshot(spark, sf_dir):
    """The first of two revisions of a dataset, which the second does not change."""
    path, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    docs.filter("lang = 'en'").write.parquet(f"{path}/revision=a")
    docs.write.parquet(f"{path}/revision=b")
    return readers.snapshot(spark, path, "a").select("doc_id", F.length("text").alias("n"))


def reviewed(spark, sf_dir):
    """Documents as questions under review: articles are sources, labels are languages, decisions come from the quality labels."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").cast("string").alias("question_id"), F.coalesce("source", F.lit("none")).alias("article_id"), F.col("text").alias("question"), F.coalesce("lang", F.lit("none")).alias("label"), F.col("quality").cast("string").alias("decision"))


REVIEWED = "rv AS (SELECT CAST(d.doc_id AS VARCHAR) AS question_id, coalesce(source, 'none') AS article_id, text AS question, coalesce(lang, 'none') AS label, CAST(quality AS VARCHAR) AS decision FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"


@query(f"WITH {REVIEWED} SELECT article_id, question_id, md5(question) AS question_md5, label, decision FROM rv")
def stored_reviews(spark, sf_dir):
    """Questions written as nested review documents and flattened again."""
    path = shared_folder(spark)
    sinks.review_documents(reviewed(spark, sf_dir), path)
    rows = readers.review_document(spark, path, lines=True)
    return rows.select("article_id", "question_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "label", "decision")


@query(f"WITH {REVIEWED} SELECT question_id, article_id, label, [label, article_id] AS reason_codes, decision IS NULL AS excluded FROM rv")
def stored_review_table(spark, sf_dir):
    """Review rows written as CSV with list cells and read back against the known questions."""
    path, rows = shared_folder(spark), reviewed(spark, sf_dir)
    flat = rows.select("question_id", "article_id", "label", F.array("label", "article_id").alias("reason_codes"), F.lit(None).cast("string").alias("clarified"), F.col("decision").isNull().alias("excluded"), F.lit("a, \"b\"").alias("notes"))
    sinks.review_csv(flat, path)
    return readers.review_csv(spark, path, rows.select("question_id")).select("question_id", "article_id", "label", "reason_codes", "excluded")


@query(f"WITH {REVIEWED}, c AS (SELECT label, count(*) AS n FROM rv GROUP BY 1) SELECT count(*) AS questions, count(DISTINCT article_id) AS articles, count(*) FILTER (decision IS NULL) AS open, (SELECT '{{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}}' FROM c) AS labels FROM rv")
def queue_counters(spark, sf_dir):
    return reports.queue_counters(reviewed(spark, sf_dir)).withColumn("labels", F.to_json("labels"))


@query(
    """SELECT 'blank' AS "check", count(*) AS violations FROM documents WHERE text IS NULL OR trim(text, ' ') = ''
    UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'repeated_text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"""
)
def integrity_report(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return reports.integrity(
        blank=docs.filter("text IS NULL OR trim(text) = ''"),
        unlabelled=docs.join(labels, "doc_id", "left_anti"),
        repeated_text=docs.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1"),
    )


@query(f"WITH {REVIEWED} SELECT run, question_id, label FROM (SELECT 'first' AS run, question_id, label FROM rv WHERE decision = '0' UNION ALL SELECT 'second', question_id, label FROM rv WHERE decision IS NULL) ORDER BY run, question_id LIMIT 50")
def tagged_failures(spark, sf_dir):
    """The first 50 failures of two runs; the limit is the report's size."""
    rows = reviewed(spark, sf_dir).select("question_id", "label", "decision")
    runs = {"first": rows.filter("decision = '0'"), "second": rows.filter("decision IS NULL")}
    return reports.tagged_failures(runs).select("run", "question_id", "label")


def written_reports(spark, sf_dir) -> str:
    """A report file per event type: types other than click report their users' number as a failure."""
    path, events = shared_folder(spark), table(spark, sf_dir, "events")
    each = events.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users"))
    entry = F.struct(F.col("name").alias("question_id"), F.col("users").cast("string").alias("question"))
    failed = F.when(F.col("name") != "click", F.array(entry)).otherwise(F.array().cast("array<struct<question_id: string, question: string>>"))
    retriever = F.when(F.col("name").isin("click", "view"), "seen").otherwise("done")
    each.select("name", F.struct(retriever.alias("retriever")).alias("config"), F.create_map(F.lit("mean"), "mean").alias("metrics"), failed.alias("failures")).repartition("name").write.partitionBy("name").json(path)
    return path


REPORTS = "rp AS (SELECT event_type AS name, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE 'done' END AS retriever, avg(value) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1), la AS (SELECT retriever, max(name) AS name, arg_max(mean, name) AS mean, arg_max(users, name) AS users FROM rp GROUP BY 1)"


@query(f"WITH {REPORTS} SELECT retriever, round(mean, 6) AS mean, CASE WHEN name = 'click' THEN 0 ELSE 1 END AS failures FROM la")
def stored_reports(spark, sf_dir):
    """The last report by path of each retriever."""
    rows = readers.reports(spark, written_reports(spark, sf_dir))
    return rows.select("retriever", F.round(F.col("metrics")["mean"], 6).alias("mean"), F.size("failures").alias("failures"))


@query(f"WITH {REPORTS} SELECT name AS question_id, CAST(users AS VARCHAR) AS question FROM la WHERE name = (SELECT min(name) FROM la WHERE name <> 'click')")
def failure_table(spark, sf_dir):
    """The failures of the first report, by path, that has any."""
    return reports.failures(readers.reports(spark, written_reports(spark, sf_dir)))


@query(f"WITH {REPORT}, l AS (SELECT printf('%-32s %10.4f', run || '.' || metric, value) AS value FROM t WHERE value IS NOT NULL) SELECT 'Events' AS value UNION ALL SELECT '======' UNION ALL SELECT value FROM l")
def text_report(spark, sf_dir):
    """A plain-text report, written and read as lines."""
    path = shared_folder(spark)
    sinks.text_report(reports.as_text(report(spark, sf_dir).withColumn("group", F.col("run")), "Events"), path)
    return spark.read.text(path)


@query("WITH k AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY sha256('5:' || conv_id), conv_id LIMIT 20) SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM k)")
def sampled_conversations(spark, sf_dir):
    """All turns of sampled conversations; the sample's size is the feature."""
    turns = table(spark, sf_dir, "conversations")
    chosen = sampling.sample(turns.select("conv_id").distinct(), "conv_id", 20, 5)
    return sampling.rows_of(turns, chosen, "conv_id").select("conv_id", "turn", "role")


@query("SELECT doc_id AS index, source AS chunk_id, coalesce(nullif(trim(lang, ' '), ''), 'Untitled') AS title, coalesce(nullif(trim(source, ' '), ''), lang, '') AS url, coalesce(nullif(trim(lang, ' '), ''), source, '') AS publisher FROM documents")
def citation_records(spark, sf_dir):
    """Citations whose fields fall back over one another."""
    lang, source = F.col("lang"), F.col("source")
    record = fx.citation_record(F.col("doc_id"), source, lang, source, lang, lang, source)
    return table(spark, sf_dir, "documents").select(record.alias("r")).select("r.*")


@query(
    """WITH r AS (SELECT conv_id || '-' || turn AS id, role AS model, sha256(coalesce(text, '')) AS fingerprint FROM conversations),
    q AS (SELECT conv_id || '-' || turn AS id, sha256(coalesce(replace(text, '?', ''), '')) AS asked FROM conversations WHERE turn < 4),
    j AS (SELECT r.*, q.id AS known, asked FROM r LEFT JOIN q USING (id)),
    v AS (SELECT id, unnest([CASE WHEN model IS DISTINCT FROM 'assistant' THEN 'other_model' END, CASE WHEN known IS NULL THEN 'not_requested' END, CASE WHEN known IS NOT NULL AND fingerprint <> asked THEN 'other_input' END]) AS rule FROM j)
    SELECT id, rule FROM v WHERE rule IS NOT NULL"""
)
def judge_rules(spark, sf_dir):
    """Turns as judged rows: roles are models, texts are inputs; only the first turns were asked for, and without question marks."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = turns.select("id", F.col("role").alias("model"), fx.sha256_text(F.col("text")).alias("fingerprint"))
    asked = turns.filter("turn < 4").select("id", fx.sha256_text(F.replace("text", F.lit("?"), F.lit(""))).alias("fingerprint"))
    return runlog.judge_violations(rows, asked, "id", "assistant")


HASH = "CAST(CAST('0x' || left(md5(coalesce(text, '')), 15) AS BIGINT) AS HUGEINT)"


@query(
    f"""WITH m AS (SELECT coalesce(source, 'none') AS name, count(*) AS n, sum({HASH}) AS h FROM documents GROUP BY 1),
    o AS (SELECT coalesce(source, 'none') AS name, text FROM documents WHERE lang = 'en' GROUP BY 1, 2), a AS (SELECT name, count(*) AS n, sum({HASH}) AS h FROM o GROUP BY 1)
    SELECT name, rule FROM (SELECT coalesce(m.name, a.name) AS name, unnest([CASE WHEN a.name IS NULL THEN 'missing' END, CASE WHEN m.name IS NULL THEN 'not_listed' END, CASE WHEN m.n <> a.n THEN 'rows_differ' END, CASE WHEN m.h <> a.h THEN 'hash_differs' END]) AS rule FROM m FULL JOIN a ON m.name = a.name) WHERE rule IS NOT NULL"""
)
def preflight_rules(spark, sf_dir):
    """A manifest of all documents by source against a collection of the distinct English ones."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("name"), "text", "lang")
    word = F.conv(F.left(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)")
    counted = lambda df: df.groupBy("name").agg(F.count("*").alias("rows"), F.sum(word).alias("hash"))
    return runlog.preflight(counted(docs), counted(docs.filter("lang = 'en'").select("name", "text").distinct()))


@query("SELECT DISTINCT lang, source, 'news_' || left(sha256('{\"lang\":\"' || lang || '\",\"overlap\":32,\"source\":\"' || source || '\"}'), 12) AS collection FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def collection_names(spark, sf_dir):
    """Each selection's collection; other settings get another name."""
    picks = table(spark, sf_dir, "documents").select("lang", "source").filter("lang IS NOT NULL AND source IS NOT NULL").distinct()
    return picks.withColumn("collection", runlog.collection_name("news", source=F.col("source"), lang=F.col("lang"), overlap=32))


@query("SELECT event_id, sha256('{\"run\":\"' || event_type || '\"}') AS fingerprint FROM events WHERE event_type <> 'view'")
def mixed_runs(spark, sf_dir):
    """Log rows under another fingerprint than the run that wants to append."""
    log = table(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct(F.col("event_type").alias("run"))).cast("binary"), 256).alias("fingerprint"))
    own = spark.range(1).select(runlog.fingerprint(run="view")).first()[0]
    return runlog.same_run(log, own)


@query(f"WITH {BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= {K} AND score > 0")
def indexed_search(spark, sf_dir):
    """Every benchmark item against an index that was stored in buckets by term and opened again."""
    path = shared_folder(spark)
    sparse.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path, buckets=8)
    found = sparse.search(sparse.Index.read(spark, path), table(spark, sf_dir, "benchmark"), "item_id", "text", K)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    r"""SELECT doc_id, max_tokens <= 64 AS bounded, true AS ordered, true AS covered, n > 0 AS any FROM (
      SELECT doc_id, 64 AS max_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents) WHERE n > 0"""
)
def chunker_invariants(spark, sf_dir):
    """Documents cut by a chunker that plugs in: at most 64 tokens, in order, and no word or sign left between two chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = seams.chunked(docs, "doc_id", "text", lambda: lambda text: chunking.chunk_spans(text, 64, 16))
    order = Window.partitionBy("article_id").orderBy("chunk_index")
    upto = F.coalesce(F.lag("char_end").over(order), F.lit(0))
    placed = cut.select("article_id", "chunk_index", "char_start", "char_end", fx.token_count(F.col("text")).alias("tokens"), upto.alias("upto"), (F.lead("char_start").over(order).isNull()).alias("last"), (F.col("char_start") > F.coalesce(F.lag("char_start").over(order), F.lit(-1))).alias("onward"))
    gap = lambda a, b: F.when(b > a, fx.token_count(F.substring("text", a + 1, b - a))).otherwise(0) == 0
    covered = gap(F.col("upto"), F.col("char_start")) & F.when(F.col("last"), gap(F.col("char_end"), F.length("text"))).otherwise(True)
    rows = placed.withColumn("doc_id", F.col("article_id").cast("long")).join(docs, "doc_id")
    return rows.groupBy("doc_id").agg((F.max("tokens") <= 64).alias("bounded"), F.bool_and("onward").alias("ordered"), F.bool_and(covered).alias("covered"), (F.count("*") > 0).alias("any"))


@query(
    """WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, source, n, CASE WHEN lang = 'en' THEN 0 ELSE n END AS lacking_before, 0 AS lacking_after, n AS first, n AS second FROM s WHERE lang IS NOT NULL AND source IS NOT NULL"""
)
def completed_stores(spark, sf_dir):
    """Documents go to two stores; the run broke off when the second held the English ones alone, and running it again completes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").filter("lang IS NOT NULL AND source IS NOT NULL")
    stores = [sinks.parquet_store("files", shared_folder(spark)), sinks.bucketed_store("collection", shared_folder(spark), "doc_id", buckets=16)]
    stores[0].write(docs)
    stores[1].write(docs.filter("lang = 'en'"))
    lacking = lambda: docs.join(sinks.holdings(spark, stores, "doc_id"), "doc_id").groupBy("lang", "source").agg(F.count_if(~F.col("everywhere")).cast("long").alias("lacking"))
    before = shared_folder(spark)
    lacking().write.parquet(before)
    for _ in range(2):
        sinks.fan_out(docs, stores, "doc_id")
    held = [s.held(spark).groupBy("lang", "source").agg(F.count("*").alias(n)) for s, n in zip(stores, ("first", "second"))]
    out = held[0].join(held[1], ["lang", "source"]).join(spark.read.parquet(before).withColumnRenamed("lacking", "lacking_before"), ["lang", "source"])
    return out.join(lacking().withColumnRenamed("lacking", "lacking_after"), ["lang", "source"]).withColumn("n", F.col("first"))


@query()
def ingested_collection(spark, sf_dir):
    """Ingest to the end: pages to chunks to vectors, upserted twice into a collection that stays the same, then read."""
    path = shared_folder(spark)
    rows = dense.embed(page_chunks(spark, sf_dir), "text").select("id", "article_id", "chunk_index", "text", "embedding")
    for _ in range(2):
        tables.upsert(rows, path, "id", replace="article_id", buckets=16)
    return rounded(tables.read(spark, path).select("id", "article_id", "chunk_index", F.length("text").alias("n"), dense.dot(F.col("embedding"), F.col("embedding")).alias("norm")), "norm", digits=4)
