"""Explicit schemas of the tables; readers never infer."""

SPAN = "STRUCT<start: INT, end: INT, text: STRING>"
ARTICLES = "article_id STRING, context STRING, split STRING, role STRING, title STRING, publisher STRING, context_sha256 STRING, normalized_context_sha256 STRING"
QUESTIONS = f"question_id STRING, article_id STRING, question STRING, ground_truth STRING, accepted_answers ARRAY<STRING>, evidence_spans ARRAY<{SPAN}>"
CHUNKS = "id STRING, article_id STRING, chunk_index INT, char_start INT, char_end INT, text STRING, n_tokens INT, title STRING, url STRING, publish_date STRING, publisher STRING, author STRING"
CLEAN_ARTICLE = "text STRING, metadata STRUCT<article_id: STRING, title: STRING, url: STRING, publish_date: STRING, author: STRING, publisher: STRING>"
TESTSET = f"question_id STRING, question STRING, ground_truth STRING, accepted_answers ARRAY<STRING>, evidence_spans ARRAY<{SPAN}>, relevant_chunk_ids ARRAY<STRING>, article_id STRING, standalone_label STRING"
RUNLOG = "run STRING, question_id STRING, stage STRING, seq BIGINT, status STRING, ts TIMESTAMP, latency_ms DOUBLE, error STRING"
REVIEW = "question_id STRING, article_id STRING, label STRING, reason_codes ARRAY<STRING>, clarified STRING, excluded BOOLEAN, notes STRING"
REVIEW_DOCUMENT = f"schema_version STRING, articles ARRAY<STRUCT<article_id: STRING, questions ARRAY<STRUCT<question_id: STRING, question: STRING, answer: STRING, evidence_spans: ARRAY<{SPAN}>, label: STRING, reason_codes: ARRAY<STRING>, clarified: STRING, decision: STRING, reviewer: STRING, notes: STRING>>>>".replace("questions ARRAY", "questions: ARRAY")
