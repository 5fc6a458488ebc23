"""Token counts for every context limit from one exact length histogram.

Documents are encoded once (Arrow batches in tasks, public byte-level BPE
ranks) and aggregated by encoded length. Suffix sums over the lengths then
answer total tokens, quantiles and truncated totals for any limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET = 1024


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_path: str):
    """A byte-level BPE encoder for a file of base64 token and rank lines."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(n_tokens long): one row per document; null and empty texts have 0 tokens.

    Texts are encoded whole, however long. Repeated rows count each time, and
    columns of other names are ignored.
    """
    path = ranks_path or default_ranks()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(encode(t)) if t else 0 for t in batch["t"]]}, dtype="int64")

    return docs.select(F.col(text).alias("t")).mapInPandas(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): exact counts, stored, as ``suffix_sums`` reads them more than once; null lengths count as 0."""
    return stored(lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """What every length, taken as the context limit, means for the corpus.

    Per distinct length: n_tokens, n_docs, tokens (n_tokens * n_docs),
    docs_at_least and tokens_at_least (documents of this length or longer),
    docs_below and tokens_below, truncated_total (tokens left if documents are
    cut at this length). Empty input gives an empty table. Lengths are dealt
    out in ranges of ``BUCKET``; only one row per range meets in one task.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    sums = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    out = h.join(sums, "bucket").select(
        "n_tokens",
        "n_docs",
        "tokens",
        (F.col("d_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("t_above") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
        "d_all",
        "t_all",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("d_all") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("t_all") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit_tokens, docs_cut, total): the corpus cut at each limit, from the table alone.

    Limits are any integers, null excluded; a limit over the longest document cuts nothing.
    """
    longer = F.col("n_tokens") > F.col("limit_tokens")
    return (
        sums.withColumn("limit_tokens", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
        .groupBy("limit_tokens")
        .agg(F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_cut"), F.sum(F.least("n_tokens", "limit_tokens") * F.col("n_docs")).alias("total"))
    )


def length_quantile(sums: DataFrame, fraction: float) -> DataFrame:
    """(n_tokens): the smallest length that at least ``fraction`` of the documents do not exceed."""
    reached = F.col("docs_below") + F.col("n_docs") >= fraction * (F.col("docs_below") + F.col("docs_at_least"))
    return sums.filter(reached).agg(F.min("n_tokens").alias("n_tokens"))
