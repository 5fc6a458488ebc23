"""Cross-site line deduplication (DataFrame functions only).

Each line is hashed; a HyperLogLog sketch of the sites that carry it is merged
by aggregation. Lines estimated clearly under or over the threshold are
decided by the estimate; those near it get an exact distinct count of sites.
Of a line found on ``min_sites`` sites or more, one occurrence stays: the first
position in the document with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LG_K = 12
#: Relative standard error of a sketch with 2**LG_K registers.
ERROR = 1.04 / 2 ** (LG_K / 2)
#: Spread lines that are sent to all tasks at most (some 50 bytes each); more of them meet the lines in a shuffled join.
MAX_BROADCAST_LINES = 200_000


def _hash(value: Column, *more: Column) -> Column:
    """128 bits as two longs: rows with equal hashes are equal for all practical purposes."""
    return F.struct(F.xxhash64(value, *more).alias("a"), F.xxhash64(F.lit(1), value, *more).alias("b"))


def _lines(docs: DataFrame, doc_id: str, text: str, site: str, min_words: int) -> DataFrame:
    """(key, id, site, pos, h): a row per line that has ``min_words`` words, without its text."""
    line = F.trim(F.col("line"))
    return (
        docs.select(
            _hash(F.col(doc_id).cast("string"), F.col(text)).alias("key"),
            F.col(doc_id).alias("id"),
            F.coalesce(F.col(site).cast("string"), F.lit("\0none")).alias("site"),
            F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
        )
        .filter((line != "") & (F.size(F.split(line, " ")) >= min_words))
        .select("key", "id", "site", "pos", _hash(line).alias("h"))
    )


def spread_lines(lines: DataFrame, min_sites: int, sigmas: float = 4.0) -> DataFrame:
    """Lines on ``min_sites`` or more distinct sites: (h, sites, keep_id, keep_pos).

    ``sites`` is exact near the threshold and the rounded estimate elsewhere.
    """
    merged = stored(
        lines.groupBy("h")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).cast("double").alias("estimate"), F.min(F.struct("id", "pos")).alias("first"))
        .filter(F.col("estimate") >= min_sites * (1 - sigmas * ERROR) - 1)
    )
    near = merged.filter(F.col("estimate") <= min_sites * (1 + sigmas * ERROR) + 1).select("h")
    exact = lines.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("exact"))
    return (
        merged.join(exact, "h", "left")
        .withColumn("sites", F.coalesce("exact", F.round("estimate").cast("long")))
        .filter(F.col("sites") >= min_sites)
        .select("h", "sites", F.col("first.id").alias("keep_id"), F.col("first.pos").alias("keep_pos"))
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, min_words: int = 3) -> DataFrame:
    """``docs`` with spread lines taken out of ``text``; adds ``n_lines`` and ``n_removed`` (long).

    A line is compared after trimming blanks. Lines of fewer than ``min_words``
    blank-separated words and blank lines always stay. The kept occurrence of
    a spread line is the first one in the document with the smallest id (a null
    id sorts first; rows that repeat id and text keep it alike). Null sites
    count as one site. A null text stays null with no lines, an empty text is
    one line. Other columns pass through; columns named like the two results
    are replaced. A document may end up with an empty text; no row is dropped.
    """
    lines = _lines(docs, doc_id, text, site, min_words)
    spread = stored(spread_lines(lines, min_sites))
    if spread.count() <= MAX_BROADCAST_LINES:
        spread = F.broadcast(spread)  # a line that is everywhere is then not gathered in one task
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("pos") == F.col("keep_pos"))
    gone = lines.join(spread, "h").filter(~first).groupBy("key").agg(F.collect_set("pos").alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _hash(F.col(doc_id).cast("string"), F.col(text)).alias("key"))
    whole = F.col(f"row.`{text}`")
    all_lines = F.split(whole, "\n")
    # positions by set difference, in linear time for texts of many lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("all_lines"), i + 1)), "\n")
    return rows.join(gone, "key", "left").withColumn("all_lines", all_lines).select(
        *[F.when(F.col("gone").isNull(), whole).otherwise(left).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept],
        F.when(whole.isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
