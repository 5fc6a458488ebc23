"""Cutting articles into chunks that know their offsets: text[char_start:char_end] == chunk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as fx

SEPARATORS = ("\n\n", "\n", " ", "")
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Characters of chunks that a task gathers before it hands them on.
OUT_CHARS = 1 << 20
SPAN = "array<struct<char_start:int,char_end:int>>"


def count_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def _pieces(text: str, start: int, end: int, size: int, level: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` tokens, cut at the coarsest separator that serves."""
    if count_tokens(text[start:end]) <= size or level == len(SEPARATORS):
        yield start, end
        return
    separator = SEPARATORS[level]
    if separator == "":  # one unbroken run: cut behind every ``size`` tokens
        at = start
        for i, m in enumerate(TOKEN.finditer(text, start, end), 1):
            if i % size == 0:
                yield at, m.end()
                at = m.end()
        if at < end:
            yield at, end
        return
    at = start
    while at < end:
        cut = text.find(separator, at, end)
        stop = end if cut < 0 else cut
        if stop > at:
            yield from _pieces(text, at, stop, size, level + 1)
        at = stop + len(separator)


def chunk_spans(text: str, size: int = 512, overlap: int = 64) -> list[tuple[int, int]]:
    """Chunks of at most ``size`` tokens; each starts with up to ``overlap`` tokens of whole pieces of the one before."""
    chunks: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    total = 0
    for start, end in _pieces(text, 0, len(text), size, 0):
        n = count_tokens(text[start:end])
        if not n:
            continue
        if held and total + n > size:
            chunks.append((held[0][0], held[-1][1]))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[2]
        held.append((start, end, n))
        total += n
    if held:
        chunks.append((held[0][0], held[-1][1]))
    return chunks


def recursive_chunks(articles: DataFrame, article_id: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, article_id, chunk_index, char_start, char_end, text, n_tokens); blank texts have no chunks."""

    columns = ["id", "article_id", "chunk_index", "char_start", "char_end", "text", "n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for a, t in zip(batch["a"], batch["t"]):
                for i, (start, end) in enumerate(chunk_spans(t or "", size, overlap)):
                    rows.append((f"{a}_{i}", a, i, start, end, t[start:end], count_tokens(t[start:end])))
                    held += end - start
                    if held >= OUT_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            batch = None  # gone before the next one is read
            yield pd.DataFrame(rows, columns=columns)

    source = articles.select(F.col(article_id).cast("string").alias("a"), F.col(text).alias("t"))
    return source.mapInPandas(run, "id string, article_id string, chunk_index int, char_start int, char_end int, text string, n_tokens int")


@F.arrow_udf(ArrayType(IntegerType()))
def line_starts(lengths: pa.Array) -> pa.Array:
    """Where the lines of a text start, by their lengths: sums of those before, which a fold over arrays would copy for every line. Texts stay outside Python."""
    n = pc.list_value_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    before = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    starts = before[:-1] - np.repeat(before[first[:-1]], n)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32)))


def line_chunks(articles: DataFrame, article_id: str, text: str) -> DataFrame:
    """Every line that is not blank as a chunk, numbered in order; no shuffle, and linear in the text."""
    rows = articles.select(F.col(article_id).alias("article_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lines = F.arrays_zip(F.split("t", "\n").alias("text"), line_starts(F.transform(F.split("t", "\n"), lambda x: F.length(x))).alias("char_start"))
    out = rows.select("article_id", F.posexplode(F.filter(lines, lambda x: F.trim(x["text"]) != "")).alias("chunk_index", "s"))
    return out.select(
        F.concat_ws("_", F.col("article_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "article_id", "chunk_index",
        "s.char_start", (F.col("s.char_start") + F.length("s.text")).alias("char_end"), "s.text",
    )


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(fx.collapsed(F.coalesce(text, F.lit(""))), r"([.!?]) ", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def sentence_chunks(articles: DataFrame, article_id: str, text: str, size: int = 8, overlap: int = 2) -> DataFrame:
    """Windows of ``size`` sentences that share ``overlap`` with the one before."""
    step = size - overlap
    n = F.size("s")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(step)))
    rows = articles.select(F.col(article_id).alias("article_id"), sentences(F.col(text)).alias("s"))
    return rows.select("article_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("s", i, size), " "))).alias("chunk_index", "text"))


def semantic_chunks(articles: DataFrame, article_id: str, text: str, threshold: float = 0.1, load=None) -> DataFrame:
    """Runs of sentences, broken where the vectors of two neighbours are less similar than ``threshold``."""
    from pyspark.sql import Window

    from . import dense

    rows = articles.select(F.col(article_id).alias("article_id"), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    vectors = dense.embed(rows, "sentence", load)
    order = Window.partitionBy("article_id").orderBy("pos")
    similar = dense.dot(F.col("embedding"), F.lag("embedding").over(order))
    numbered = vectors.withColumn("break", F.coalesce((similar < threshold).cast("int"), F.lit(0))).withColumn("chunk_index", F.sum("break").over(order).cast("int"))
    return numbered.groupBy("article_id", "chunk_index").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "sentence")))["sentence"], " ").alias("text"))


def aligned(text: Column, chunks: Column) -> Column:
    """Offsets of chunks that come in order: searched from behind the start of the one before, then from the front; null where absent."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s, c):
        onward = F.call_function("locate", c, text, s["at"] + 1)
        found = F.when(onward > 0, onward).otherwise(F.call_function("locate", c, text, F.lit(1)))
        span = F.when(found > 0, F.struct((found - 1).alias("char_start"), (found - 1 + F.length(c)).alias("char_end")))
        return F.struct(F.when(found > 0, found).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.aggregate(chunks, first, step)["out"]


def spans_to_chunks(spans: DataFrame, chunks: DataFrame, bin_chars: int = 4096) -> DataFrame:
    """Interval-overlap join on the article: spans (question_id, article_id, start, end) to every chunk they touch.

    Both sides are dealt into bins of ``bin_chars`` characters and meet by
    (article, bin), so a long article with many spans is many small keys; a
    pair that shares several bins is taken in the first of them.
    """

    def bins(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / bin_chars), F.floor(F.greatest(end - 1, start) / bin_chars))

    asked = spans.withColumn("bins", bins(F.col("start"), F.col("end")))
    asked = asked.withColumn("first_span_bin", F.get("bins", F.lit(0))).withColumn("bin", F.explode("bins")).drop("bins")
    held = chunks.select("article_id", F.col("id").alias("chunk_id"), "char_start", "char_end", bins(F.col("char_start"), F.col("char_end")).alias("bins"))
    held = held.select("article_id", "chunk_id", "char_start", "char_end", F.get("bins", F.lit(0)).alias("first_chunk_bin"), F.explode("bins").alias("bin"))
    overlap = (F.col("char_start") < F.col("end")) & (F.col("start") < F.col("char_end"))
    first = F.col("bin") == F.greatest("first_span_bin", "first_chunk_bin")
    return asked.join(held, ["article_id", "bin"]).filter(overlap & first).select(*spans.columns, "chunk_id", "char_start", "char_end")


def missing_chunks(testset: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id): relevant ids that no chunk has; empty in a sound test set."""
    named = testset.select("question_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    return named.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select("question_id", "chunk_id")


def derivation_violations(questions: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, rule) of questions that a chunked test set cannot hold: article unknown, evidence not at its place, no chunk with it.

    questions: question_id, article_id, evidence, start, end; articles: article_id, text.
    """
    placed = questions.join(articles.select("article_id", "text"), "article_id", "left")
    there = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    rule = F.when(F.col("text").isNull(), "unknown_article").when(there != F.col("evidence"), "evidence_moved")
    own = placed.select("question_id", rule.alias("rule")).filter("rule IS NOT NULL")
    bare = relevant_chunks(questions, chunks).filter(F.size("relevant_chunk_ids") == 0).select("question_id", F.lit("no_chunk").alias("rule"))
    return own.unionByName(bare)


def chunked_testset(questions: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """``questions`` with the chunks that hold their evidence; raises if any question breaks a rule."""
    from .review import require_none

    require_none(derivation_violations(questions, articles, chunks), "questions without sound evidence")
    return questions.join(relevant_chunks(questions, chunks), "question_id")


def relevant_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, relevant_chunk_ids): sorted ids per question; empty where no chunk holds the evidence, which is an error upstream."""
    found = spans_to_chunks(spans, chunks).groupBy("question_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    return spans.select("question_id").distinct().join(found, "question_id", "left").select("question_id", F.coalesce("ids", F.array().cast("array<string>")).alias("relevant_chunk_ids"))
