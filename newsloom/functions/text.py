"""Text functions as Column expressions; Unicode normalisation alone needs Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters whatever the regex dialect.
WORD = r"[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks; null and blank texts give an empty array."""
    return F.array_remove(F.split(lowered(text), r"\s+"), "")


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def bare_tokens(text: Column, edges: str = ".,;:!?\"'()[]{}") -> Column:
    """Tokens without the punctuation at their edges; tokens of punctuation alone go."""
    return F.filter(F.transform(tokens(text), lambda w: _strip(w, edges)), lambda w: w != "")


def _strip(word: Column, edges: str) -> Column:
    kind = "[" + re.sub(r"([\\\]\[^-])", r"\\\1", edges) + "]+"
    return F.regexp_replace(word, f"^{kind}|{kind}$", "")


def collapsed(text: Column) -> Column:
    """Runs of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_count(text: Column) -> Column:
    """Words and single punctuation signs: the stated substitute for a model tokenizer."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_\s])"), F.lit(1)))


def ends_sentence(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"""[.!?]["')\]]?$"""), F.lit(False))


def sha256_text(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def content_id(text: Column, prefix: str = "doc_") -> Column:
    return F.concat(F.lit(prefix), F.left(sha256_text(text), F.lit(16)))


def normalized_hash(text: Column) -> Column:
    """Hash of the text up to case and blanks."""
    return sha256_text(F.lower(collapsed(F.coalesce(text, F.lit("")))))


def derived_title(text: Column, length: int = 160) -> Column:
    """The first line that is not blank, cut to ``length``; empty if there is none."""
    # a bare F.trim would take the place in the array as the signs to trim
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.left(F.try_element_at(lines, F.lit(1)), F.lit(length)), F.lit(""))


def stable_hash(*columns: str) -> Column:
    """Hash of the named columns as JSON with keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def article_id(url: Column, fallback: Column) -> Column:
    """First 12 digits of the md5 of the url, or of the fallback name where the url is empty."""
    return F.left(F.md5(F.coalesce(F.nullif(url, F.lit("")), fallback).cast("binary")), F.lit(12))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


# ---- answers and citations ----


def normalized_answer(text: Column) -> Column:
    """Lower case, citation marks and punctuation dropped, blanks collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return collapsed(bare)


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\[\d+\]", ""))


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalized_answer(prediction) == normalized_answer(truth)).cast("double")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Bag overlap of normalised words; 0 if either side has none. For short answers; ``metrics.evaluate_answers`` takes any length."""
    return bag_f1(answer_words(prediction), answer_words(truth))


def answer_words(text: Column) -> Column:
    return F.filter(F.split(normalized_answer(text), " "), lambda w: w != "")


def bag_f1(p: Column, g: Column) -> Column:
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(_times(p, w), _times(g, w)))
    both = F.size(p) + F.size(g)
    return F.when((F.size(p) > 0) & (F.size(g) > 0), 2.0 * common / both).otherwise(0.0)


def _times(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def best_over_answers(score, prediction: Column, answers: Column) -> Column:
    """The best score over all accepted answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(answers, lambda a: score(prediction, a))), F.lit(0.0))


def citations(answer: Column) -> Column:
    """Cited numbers ``[n]`` in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def valid_citations(cited: Column, n: Column) -> Column:
    return F.filter(cited, lambda i: (i >= 1) & (i <= n))


def invalid_citations(cited: Column, n: Column) -> Column:
    return F.filter(cited, lambda i: (i < 1) | (i > n))


def context_block(passages: Column) -> Column:
    """Numbered passages, blank line between them."""
    return F.array_join(F.transform(passages, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")


def prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context_block(passages), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer with citations:"))


def citation_record(index: Column, chunk_id: Column, title: Column, url: Column, source_url: Column, publisher: Column, source: Column) -> Column:
    """A citation whose fields fall back over the spellings of the metadata keys."""
    return F.struct(
        index.alias("index"),
        F.coalesce(chunk_id, F.lit("")).alias("chunk_id"),
        F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled")).alias("title"),
        first_non_empty(url, source_url).alias("url"),
        first_non_empty(publisher, source).alias("publisher"),
    )


# ---- spans, quotes and leaks ----


def positions_of(text: Column, part: Column) -> Column:
    """0-based starts of every occurrence, overlapping ones included; empty for an empty part.

    The text is split before every occurrence, so the work is linear in it.
    """
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    parts = F.split(text, literal, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(parts, zero, lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    found = F.filter(ends, lambda at, i: (i > 0) | F.startswith(text, part))
    return F.when((F.length(part) > 0) & F.contains(text, part), found).otherwise(F.array().cast("array<int>"))


def quote_supported(text: Column, quote: Column, spans: Column) -> Column:
    """Whether the quote occurs at some place that no evidence span overlaps."""
    free = lambda i: ~F.exists(spans, lambda s: (i < s["end"]) & (s["start"] < i + F.length(quote)))
    return F.coalesce(F.exists(positions_of(text, quote), free), F.lit(False))


def spans_valid(text: Column, spans: Column) -> Column:
    """Every span lies inside the text and holds exactly its slice."""
    good = lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["text"])
    return F.coalesce(F.forall(spans, good), F.lit(False))


def evidence_spans(text: Column, labels: Column, answers: Column) -> Column:
    """Half-open spans from parallel inclusive arrays, ranges checked; else the first answer found in the text."""
    pairs = F.flatten(F.transform(labels, lambda x: F.arrays_zip(x["start"], x["end"])))
    made = F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), (p["end"] + 1).alias("end"), F.substring(text, p["start"] + 1, p["end"] + 1 - p["start"]).alias("text")))
    inside = F.filter(made, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))
    found = F.filter(answers, lambda a: (F.length(a) > 0) & F.contains(text, a))
    first = F.try_element_at(found, F.lit(1))
    at = F.instr(text, first) - 1
    fallback = F.when(first.isNotNull(), F.array(F.struct(at.alias("start"), (at + F.length(first)).alias("end"), first.alias("text")))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return F.when(F.size(inside) > 0, inside).otherwise(fallback)


def redacted_window(text: Column, spans: Column, around: int = 450, mark: str = "[EVIDENCE]") -> Column:
    """The text around the spans with every span replaced by a mark; the last span is replaced first."""
    low = F.greatest(F.array_min(F.transform(spans, lambda s: s["start"])) - around, F.lit(0))
    high = F.least(F.array_max(F.transform(spans, lambda s: s["end"])) + around, F.length(text))
    last_first = F.reverse(F.array_sort(spans))
    cut = F.aggregate(last_first, F.substring(text, low + 1, high - low), lambda w, s: F.concat(F.substring(w, F.lit(1), s["start"] - low), F.lit(mark), F.substring(w, s["end"] - low + 1, F.length(w))))
    return F.coalesce(cut, F.lit(""))


def answer_leaks(answer: Column, clarified: Column) -> Column:
    """Whether the clarified question contains a normalised answer of three characters or more."""
    a = normalized_answer(answer)
    return (F.length(a) >= 3) & F.contains(normalized_answer(clarified), a)


# ---- errors ----


def retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def fatal(status: Column) -> Column:
    return F.coalesce(status.isin(401, 403, 404), F.lit(False))


def redacted_secret(message: Column, secret: Column, length: int = 500) -> Column:
    shown = F.when(F.length(secret) > 0, F.replace(message, secret, F.lit("***"))).otherwise(message)
    return F.left(F.coalesce(shown, F.lit("")), F.lit(length))


def json_list(cell: Column) -> Column:
    """A JSON array of strings out of a table cell; blank cells are empty, broken ones null."""
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.from_json(cell, "array<string>"))


# ---- Unicode normalisation: no built-in exists ----


@F.pandas_udf(StringType())
def normalized_question(text: pd.Series) -> pd.Series:
    """NFKC, case folded, blanks collapsed, end punctuation dropped."""
    def one(t):
        folded = " ".join(unicodedata.normalize("NFKC", t).casefold().split())
        return re.sub(r"\s*[?!.]+$", "", folded)

    return text.map(lambda t: one(t or ""))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


@F.pandas_udf(StringType())
def ascii_text(text: pd.Series) -> pd.Series:
    """Letters without their accents; what has no ASCII form is dropped."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode())


def slug(text: Column, length: int = 80, default: str = "article") -> Column:
    cut = F.left(F.regexp_replace(F.regexp_replace(F.lower(ascii_text(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(length))
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit(default))


#: Typographic signs and the plain signs that stand for them.
SMART, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "


def cleaned(text: Column, boilerplate: str | None = None) -> Column:
    """Composed characters, typographic signs made plain, blanks collapsed inside lines; empty lines and those that match ``boilerplate`` dropped."""
    plain = F.translate(nfc(F.coalesce(text, F.lit(""))), SMART, PLAIN)
    lines = F.filter(F.transform(F.split(plain, "\n"), collapsed), lambda x: x != "")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(boilerplate)) if boilerplate else lines, "\n")


def best_hit_count(text: Column, terms: Sequence[str] | Column) -> Column:
    found = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms])
    return F.size(F.filter(found, lambda t: F.contains(F.lower(text), t)))
