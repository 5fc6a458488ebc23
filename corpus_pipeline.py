"""Corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the next stage's input. All stages but the last return the
columns of ``documents``; further columns, whatever their names, pass through
unchanged. A document without an id passes every filter that it
does not fail by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from newsloom.llm.common import WRITTEN, drop_tables, nested, stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.7 or more go. It learns from the labels of this stage's documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(nested(docs, "text"), model, threshold=0.7).filter("predicted = 0").select("row.*")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on eight or more sites stay once; a document whose text they were altogether goes."""
    out = line_dedup.dedup_lines(nested(docs, "doc_id", "text", "source"), min_sites=8, min_words=3)
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    new = {"text": F.col("text"), "n_chars": n_chars}
    return out.filter(~emptied).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, minhash.Settings(width=5, percent=80))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return packing.pack(docs, settings=packing.Settings(window=2048, end_id=1))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_filter),
    ("near-duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("packing", packing_stage),
]

#: Classifier, sketches and tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = len(WRITTEN)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        drop_tables(spark, WRITTEN[before:-1])  # nothing reads what led to this stage's table
    return docs
