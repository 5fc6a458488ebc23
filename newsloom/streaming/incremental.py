"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import dates, html, urls
from ..operators import chunking
from ..sources import tables


def new_urls(stream: DataFrame, url: str, ts: str, delay: str) -> DataFrame:
    """The first row of each canonical url within the watermark; older repeats meet the table in ``foreachBatch``."""
    keyed = stream.withColumn("url_hash", urls.url_hash(F.col(url)))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url_hash"])


def recent_entries(stream: DataFrame, published: str, hours: int) -> DataFrame:
    """Entries not older than ``hours`` on the clock of their batch; undated ones pass."""
    cutoff = F.expr(f"current_timestamp() - make_dt_interval(0, {int(hours)}, 0, 0)")
    return stream.filter(dates.recent(F.col(published), cutoff))


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Appends rows whose key the table does not hold; a batch that runs again finds its own rows and adds none."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates([key])
        known = _table(spark, path)
        (once if known is None else once.join(known.select(key), key, "left_anti")).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_chunks(stream: DataFrame, path: str, checkpoint: str, id: str = "id", replace: str | None = None, buckets: int = 64):
    """Every batch is upserted by id into the buckets it touches; running a batch twice gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        tables.upsert(batch, path, id, replace, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Keeps one record a key: the greatest (seq, status)."""

    def __init__(self, key: str, ttl_ms: int | None):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "seq long, status string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.best.get() if self.best.exists() else None
        best = known and tuple(known)
        for batch in rows:
            top = max(zip(batch["seq"].tolist(), batch["status"].tolist()))
            best = max(best, top) if best else top
        if best and best != (known and tuple(known)):
            self.best.update(best)
            yield pd.DataFrame({self.key: [key[0]], "seq": [best[0]], "status": [best[1]]})

    def close(self) -> None:
        pass


class _Trace(StatefulProcessor):
    """Keeps the last ``n`` records of a key; records are appended, and rewritten only when there are too many."""

    def __init__(self, key: str, n: int, ttl_ms: int | None):
        self.key, self.n, self.ttl_ms = key, n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getListState("records", "seq long, value string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        new = []
        for batch in rows:
            new = sorted([*new, *zip(batch["seq"].tolist(), batch["value"].tolist())])[-self.n :]
        last = sorted([*held, *new])[-self.n :]
        if len(held) + len(new) <= self.n:
            self.records.appendList(new)
        else:
            self.records.put(last)
        yield pd.DataFrame({self.key: [key[0]], "seqs": [[a for a, _ in last]], "values": [[b for _, b in last]]})

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, ttl: bool) -> DataFrame:
    """State in RocksDB, which such operators need; the setting holds for queries that start after it."""
    rows.sparkSession.conf.set(STORE, ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Update", "ProcessingTime" if ttl else "None")


def latest_state(stream: DataFrame, key: str, seq: str, status: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, status): the latest record of a key whenever it changes; state is one record a key, dropped ``ttl_ms`` after its last change if given.

    Of records with the same seq the greatest status counts. Records may come in any order and again.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(seq).cast("long").alias("seq"), F.col(status).cast("string").alias("status")).filter("seq IS NOT NULL AND status IS NOT NULL")
    return _stateful(rows, key, _Latest(key, ttl_ms), f"{key} {kind}, seq long, status string", ttl_ms is not None).withColumnsRenamed({"seq": seq, "status": status})


def bounded_trace(stream: DataFrame, key: str, seq: str, value: str, n: int = 200, ttl_ms: int | None = None) -> DataFrame:
    """(key, seqs, values): the last ``n`` records of a key whenever it changes; state never exceeds n records a key."""
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value")).filter("seq IS NOT NULL")
    rows = rows.withColumn("value", F.coalesce("value", F.lit("")))
    return _stateful(rows, key, _Trace(key, n, ttl_ms), f"{key} {kind}, seqs array<long>, values array<string>", ttl_ms is not None)


PAGES = "page_id long, url string, html string, published string"


def page_rows(pages: DataFrame, clock: Column, hours: int | None = None, size: int = 256, overlap: int = 32) -> DataFrame:
    """Chunks of pages, as a batch and as each batch of a stream: entries older than ``hours`` on ``clock`` go, undated ones stay, of a page given twice the greatest row counts."""
    recent = pages if hours is None else pages.filter(dates.recent(dates.lenient(F.col("published")), clock - F.make_dt_interval(F.lit(0), F.lit(hours))))
    once = tables.once(recent.select("page_id", "url", "html"), "page_id")
    articles = once.select("page_id", html.stripped(html.article_html(F.coalesce("html", F.lit("")))).alias("text"))
    return chunking.recursive_chunks(articles.filter(F.trim("text") != ""), "page_id", "text", size, overlap)


def ingest_folder(spark: SparkSession, folder: str, path: str, checkpoint: str, hours: int | None = None, clock: Callable[[], Column] = F.current_timestamp, files_per_trigger: int = 100, buckets: int = 64):
    """Landed page files to articles to chunks to a collection, as one stream; its query is returned.

    Every batch holds at most ``files_per_trigger`` files and replaces the
    chunks of its pages. A batch that runs again after a failure gives the
    same collection, as does a second run over the same folder.
    """

    def write(batch: DataFrame, _: int) -> None:
        tables.upsert(page_rows(batch, clock(), hours), path, "id", replace="article_id", buckets=buckets)

    stream = drop_folder(spark, folder, PAGES, files_per_trigger)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of JSON files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", wrap: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Process what has landed into an in-memory table, for tests and small tables."""
    query = wrap(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
