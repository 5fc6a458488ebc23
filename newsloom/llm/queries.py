"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_extract, lexical_search, line_dedup, minhash, packing, phrases, quality, secret_scan, suffix_tree, token_counts, toxicity
from .common import crc_remainder, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(vectors, settings=embedding_dedup.Settings(threshold=0.95))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels, ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, threshold=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.hits(docs.select("doc_id", "text"), items, window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels, ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), model, threshold=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(docs)))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 5) == 1
    scored = suffix_tree.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, settings=packing.Settings(window=2048, end_id=1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.dedup_lines(docs, min_sites=8, min_words=3)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, settings=minhash.Settings(width=3, percent=85))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return phrases.mine(docs, settings=phrases.Settings(floor=30, most_words=4, inside=80, top=2000))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs).select("doc_id", "found", F.filter("found", lambda s: s["rank"] < secret_scan.BASE).alias("base"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(of, ("assign", "access", "hex")),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("found").alias("spans"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"), settings=lexical_search.Settings(top=10))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands at the top of the repository and imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_decontaminate": op3_decontaminate,
        "op4_quality": op4_quality,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_tree": op6_suffix_tree,
        "op7_packing": op7_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_minhash": op9_minhash,
        "op10_html": op10_html,
        "op11_phrases": op11_phrases,
        "op12_secrets": op12_secrets,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op8_line_dedup": OP8_SQL, "op11_phrases": OP11_SQL, "op12_secrets": OP12_SQL, "op13_lexical_search": OP13_SQL}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark
), w AS (
  SELECT DISTINCT item, len(win) AS k, array_to_string(win, ' ') AS win
  FROM (SELECT item, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i:i + 9])) AS win FROM b WHERE len(ws) > 0)
), k AS (SELECT DISTINCT k FROM w),
g AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)
), m AS (SELECT DISTINCT doc_id, g.k, i, item FROM g JOIN w ON g.k = w.k AND g.win = w.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line, ' ') AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), c AS (SELECT * FROM l WHERE t <> '' AND len(string_split(t, ' ')) >= 3),
s AS (SELECT t, min(struct_pack(doc_id := doc_id, pos := pos)) AS keep FROM c GROUP BY t HAVING count(DISTINCT coalesce(source, '?')) >= 8),
g AS (SELECT c.doc_id, c.pos FROM c JOIN s ON c.t = s.t WHERE NOT (c.doc_id = s.keep.doc_id AND c.pos = s.keep.pos)),
o AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(kept) AS BIGINT) AS n_chars_left, md5(kept) AS text_md5
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""

OP11_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM t),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, len(g) AS k, array_to_string(g, ' ') AS phrase
  FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS g FROM p)
), f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.k, c.phrase, c.ws, c.a, cut, x.a AS l, y.a AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, sub, max(a) AS most
  FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS sub FROM f WHERE k > 2)
  GROUP BY ALL
), kept AS (
  SELECT m.* FROM m LEFT JOIN longer ON longer.lang = m.lang AND longer.sub = m.phrase
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(m.a AS HUGEINT)
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total ON kept.lang = total.lang
QUALIFY rank <= 2000
"""


def _rule_sql(rank: int, rule: secret_scan.Rule) -> str:
    text, pattern = "low" if rule.any_case else "text", rule.pattern.replace("'", "''")
    return f"""SELECT r, {rank} AS rank, '{rule.name}' AS rule, {rule.least} AS least, generate_subscripts(regexp_split_to_array({text}, '{pattern}'), 1) AS i,
  length(unnest(regexp_split_to_array({text}, '{pattern}'))) AS gap, length(unnest(regexp_extract_all({text}, '{pattern}'))) AS n, length(unnest(regexp_extract_all({text}, '{pattern}', {rule.group}))) AS measured FROM d"""


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), m AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(secret_scan.RULES))}),
p AS (SELECT *, sum(gap + n) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM m WHERE n IS NOT NULL),
s AS (SELECT r, rank, rule, stop - n AS start, concat(rule, ':', stop - n, ':', stop) AS span FROM p WHERE measured >= least),
a AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {secret_scan.BASE}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.r = a.r
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ws FROM benchmark
), total AS (SELECT count(*) AS N, CAST(sum(len(ws)) AS BIGINT) AS L FROM d WHERE len(ws) > 0),
qt AS (SELECT q, unnest(ws) AS term FROM q),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, N),
g AS (
  SELECT tf.r, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * N) // L))) AS gain
  FROM tf JOIN d ON tf.r = d.r JOIN w ON tf.term = w.term, total
), s AS (SELECT q, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM g JOIN qt ON g.term = qt.term GROUP BY q, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN q ON k.q = q.q WHERE rank <= 10
"""
