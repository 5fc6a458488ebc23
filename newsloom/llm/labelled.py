"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(id string, text, label): at most ``max_rows`` labelled documents, the same ones on every run.

    ``usable`` is a condition on the id column of ``labels``. An id labelled more
    than once counts with its largest label, a document id that repeats with
    its smallest text; null ids, labels and other values than 0 and 1 are left
    out. The ids are chosen by hash before any text is read, so only the chosen
    texts are shuffled and the broadcast side has at most ``max_rows`` ids.
    """
    chosen = (
        labels.filter(usable & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").groupBy(F.col("id").cast("string").alias("id"), "label").agg(F.min("text").alias("text"))
