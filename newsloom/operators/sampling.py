"""Seeded samples that depend on ids alone, not on row order or partitioning."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .runlog import numbered


def sample(df: DataFrame, id: str, k: int, seed: int) -> DataFrame:
    """``k`` rows by the order of sha2(seed:id)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"), 256)
    return df.orderBy(key, id).limit(k)


def positional_sample(df: DataFrame, id: str, k: int, seed: int) -> DataFrame:
    """The rows that ``random.Random(seed).sample`` picks from the list of ids in order: k positions are the driver's only data."""
    n = df.count()
    picked = random.Random(seed).sample(range(n), min(k, n))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(p,) for p in picked], "at long")
    ids = numbered(df.select(id), id, "at")
    return df.join(ids.join(F.broadcast(wanted), "at").select(id), id, "left_semi")


def without_leaks(df: DataFrame, excluded: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalised text hash is not among those of ``excluded``."""
    hashes = excluded.select(fx.normalized_hash(F.col(text)).alias("h")).distinct()
    return df.withColumn("h", fx.normalized_hash(F.col(text))).join(hashes, "h", "left_anti").drop("h")


def selection_bundle(articles: DataFrame, id: str, n_evaluation: int, n_distractors: int, seed: int, text: str = "text") -> DataFrame:
    """Evaluation articles and distractors that do not repeat their texts, under a ``role`` column."""
    evaluation = sample(articles, id, n_evaluation, seed)
    rest = without_leaks(articles, evaluation, text)
    distractors = sample(rest, id, n_distractors, seed + 1)
    return evaluation.withColumn("role", F.lit("evaluation")).unionByName(distractors.withColumn("role", F.lit("distractor")))


def rows_of(df: DataFrame, chosen: DataFrame, id: str) -> DataFrame:
    """The second pass: every row of the chosen articles."""
    return df.join(chosen.select(id).distinct(), id, "left_semi")
