"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is ``window`` consecutive words of a benchmark item, or the whole item
if it is shorter. A window occurs in a document only if every one of its word
shingles does, so the window's *rarest* shingle in the corpus is a necessary
prefix: the join on it finds every candidate. Positional and length bounds
place the window in the document, and the candidate's words are then compared
one by one with the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, nested, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDE = 3
MAX_BROADCAST_SHINGLES = 200_000


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null and wordless texts give an empty array."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def _shingles(ws: Column, width: int) -> Column:
    """Hashes of ``width`` consecutive words, in order; empty if the text is shorter."""
    n = F.size(ws) - (width - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(width)]))


def item_windows(items: DataFrame, item_id: str, text: str, window: int = 10) -> DataFrame:
    """Distinct windows: (w array<string>, items array<string>)."""
    ws = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - window + 1, F.lit(1))
    return (
        ws.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("ws", i, window))).alias("w"))
        .groupBy("w")
        .agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("null")))).alias("items"))
    )


def _candidates(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(key, start, w, items): placements of windows whose rarest shingle stands in the document."""
    grams = windows.select("w", "items", F.posexplode(_shingles(F.col("w"), width)).alias("at", "sh"))
    wanted = grams.select("sh").distinct()
    if wanted.limit(MAX_BROADCAST_SHINGLES + 1).count() <= MAX_BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)  # else the planner chooses a shuffled join
    # ws is a column of its own: as an expression it would be split anew for every position
    seen = docs.select("key", words(F.col("text")).alias("ws")).select("key", F.size("ws").alias("n"), F.posexplode(_shingles(F.col("ws"), width)).alias("pos", "sh"))
    seen = stored(seen.join(wanted, "sh"))
    rarity = seen.groupBy("sh").agg(F.count("*").alias("df"))
    prefix = (
        grams.join(rarity, "sh", "left")
        .groupBy("w", "items")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "sh")).alias("p"))
        .filter("p.df > 0")
        .select("w", "items", F.col("p.at").alias("at"), F.col("p.sh").alias("sh"))
    )
    start = F.col("pos") - F.col("at")
    return (
        seen.join(prefix, "sh")
        .filter((start >= 0) & (start + F.size("w") <= F.col("n")))
        .select("key", (start + 1).alias("start"), "w", "items")
    )


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: all its columns, then ``n_words``, ``n_hit``, ``hit_items``.

    ``n_hit`` counts the document's words inside any occurrence of a window and
    ``hit_items`` lists, sorted as strings, the items with an occurring window.

    Null or wordless texts have no words and no hits. Items without words have
    no windows. Repeated document rows each get their own, equal, result; equal
    windows of several items name all of them. Other columns pass through;
    columns named like the three results are replaced. An empty benchmark hits nothing.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items")]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in kept], F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key"))
    windows = stored(item_windows(items, item_id, item_text, window))
    shortest = windows.agg(F.min(F.size("w"))).first()[0]
    found = _candidates(keyed, windows.filter(F.size("w") >= WIDE), WIDE)
    if shortest is not None and shortest < WIDE:
        found = found.unionByName(_candidates(keyed, windows.filter(F.size("w") < WIDE), 1))
    placed = found.groupBy("key").agg(F.collect_set(F.struct("start", "w", "items")).alias("placed"))
    ws = F.col("ws")
    true = F.filter(F.col("placed"), lambda p: F.slice(ws, p["start"], F.size(p["w"])) == p["w"])
    spans = F.transform(F.col("true"), lambda p: F.sequence(p["start"], p["start"] + F.size(p["w"]) - 1))
    return (
        keyed.join(placed, "key", "left")
        .withColumn("ws", words(F.col("text")))
        .withColumn("true", F.coalesce(true, F.array()))
        .select(
            *[F.col(f"`c_{c}`").alias(c) for c in kept],
            F.size("ws").cast("long").alias("n_words"),
            F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.col("true.items")))).alias("hit_items"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns as they are."""
    return hits(nested(docs, "doc_id", "text"), items, window=window).filter("n_hit = 0").select("row.*")
