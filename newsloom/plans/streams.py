"""Queries that run as streams over landed files and must give what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import runlog
from ..session import shared_folder, table
from ..sources import tables
from ..streaming import incremental
from .pages import ARTICLE, BARE, STRIPPED
from .registry import query


def landed(df, folder: str, parts: int, key: str) -> None:
    """``df`` as JSON files in ``parts`` drops."""
    for k in range(parts):
        df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k).write.mode("append").json(folder)


def emitted(spark, stream):
    """All that a stream emits, over two starts from one checkpoint."""
    out, checkpoint = shared_folder(spark), shared_folder(spark)
    for _ in range(2):
        query = stream().writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_type, max(event_id) AS event_id, max_by(CAST(user_id AS VARCHAR), event_id) AS user_id FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def streamed_latest(spark, sf_dir):
    """The latest event of each type, kept as state while its log lands in three drops."""
    folder = shared_folder(spark)
    landed(table(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").cast("string").alias("user_id")), folder, 3, "event_id")
    stream = lambda: incremental.latest_state(incremental.drop_folder(spark, folder, "event_type string, event_id long, user_id string", 2), "event_type", "event_id", "user_id")
    return runlog.latest(emitted(spark, stream), "event_type", "event_id")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 200")
def streamed_trace(spark, sf_dir):
    """The last 200 events of each type, a bounded state; the limit is the feature."""
    folder = shared_folder(spark)
    landed(table(spark, sf_dir, "events").select("event_type", "event_id"), folder, 3, "event_id")
    stream = lambda: incremental.bounded_trace(incremental.drop_folder(spark, folder, "event_type string, event_id long", 2), "event_type", "event_id", "event_type", 200)
    last = emitted(spark, stream).groupBy("event_type").agg(F.max(F.reverse("seqs")).alias("seqs"))  # the trace with the latest events
    return last.select("event_type", F.explode("seqs").alias("event_id"))


@query(
    f"""WITH b AS (SELECT page_id, {BARE} AS bare FROM pages), a AS (SELECT page_id, {STRIPPED.format(f"trim({ARTICLE.format('bare')}, ' ')")} AS text FROM b)
    SELECT CAST(page_id AS VARCHAR) AS article_id, true AS at_place, true AS from_zero, rtrim(text) = text AND length(text) > 0 AS whole FROM a WHERE text <> ''"""
)
def streamed_pages(spark, sf_dir):
    """Pages land in two drops, undated or fresh, and become chunks in a collection; each article is cut from its start to its end."""
    folder, path, checkpoint = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.when(F.pmod("page_id", F.lit(2)) == 0, dates.iso_z(F.current_timestamp())).alias("published"))
    landed(pages, folder, 2, "page_id")
    for _ in range(2):
        incremental.ingest_folder(spark, folder, path, checkpoint, hours=48, files_per_trigger=4, buckets=8).awaitTermination()
    chunks = tables.read(spark, path)
    texts = incremental.page_rows(pages, F.current_timestamp(), size=1 << 30)  # one chunk an article
    ends = chunks.join(texts.select("article_id", F.col("char_start").alias("first"), F.col("char_end").alias("last"), F.col("text").alias("whole_text")), "article_id")
    there = F.substring("whole_text", F.col("char_start") - F.col("first") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return ends.groupBy("article_id").agg(F.bool_and(there).alias("at_place"), (F.min("char_start") == 0).alias("from_zero"), (F.max("char_end") == F.max("last")).alias("whole"))
