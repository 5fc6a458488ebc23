"""Streams over landed files: what restarts, late entries and reruns leave is what a batch gives."""

import datetime
import random

import pytest
from newsloom.operators import runlog
from newsloom.sources import tables
from newsloom.streaming import incremental
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


LOG = "k string, seq long, status string"


def land(spark, folder, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")


def drops():
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.randint(0, 40), rng.choice(["failed", "success"])) for _ in range(90)] + [("n", None, "x"), ("n", 3, None), (None, 5, "null key")]
    return [rows[:30], rows[30:50], rows[50:]]


def collected(spark, folder, stream, name):
    """Appends what the stream emits; each call starts the query again from its checkpoint."""

    def keep(batch, _):
        batch.write.mode("append").parquet(f"{folder}/{name}")

    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/{name}")


def test_state_survives_restarts(spark, folder):
    seen = []
    for part in drops():
        land(spark, folder, part)
        seen += part
        source = lambda: incremental.drop_folder(spark, f"{folder}/in", LOG, 1)
        latest = collected(spark, folder, incremental.latest_state(source(), "k", "seq", "status"), "latest")
        trace = collected(spark, folder, incremental.bounded_trace(source(), "k", "seq", "status", 5), "trace")
    sound = [r for r in seen if r[1] is not None and r[2] is not None]
    want = {k: max((s, t) for kk, s, t in sound if kk == k) for k in {r[0] for r in sound}}
    got = runlog.latest(latest, "k", "seq", "status").collect()
    assert {r.k: (r.seq, r.status) for r in got} == want
    ends = {k: sorted((s, t or "") for kk, s, t in seen if kk == k and s is not None)[-5:] for k in {r[0] for r in seen if r[1] is not None}}
    last = {r.k: r for r in trace.withColumn("at", F.size("seqs")).orderBy("at", "seqs").collect()}
    rows = {k: [(r.seqs, r["values"]) for r in trace.filter(F.col("k").eqNullSafe(F.lit(k))).collect()] for k in ends}
    for k, w in ends.items():
        assert ([a for a, _ in w], [b for _, b in w]) in rows[k]
        assert list(zip(last[k].seqs, last[k]["values"])) == w and all(len(a) <= 5 for a, _ in rows[k])


def test_state_with_time_to_live_runs(spark, folder):
    land(spark, folder, drops()[0])
    out = collected(spark, folder, incremental.latest_state(incremental.drop_folder(spark, f"{folder}/in", LOG), "k", "seq", "status", ttl_ms=3_600_000), "ttl")
    assert out.count() == len({r[0] for r in drops()[0] if r[1] is not None})


def test_late_entries_are_dropped_on_the_clock(spark, folder):
    now = datetime.datetime.now()
    rows = [("new", now - datetime.timedelta(hours=1)), ("old", now - datetime.timedelta(hours=50)), ("undated", None)]
    land(spark, folder, rows, "k string, ts timestamp")
    stream = incremental.recent_entries(incremental.drop_folder(spark, f"{folder}/in", "k string, ts timestamp"), "ts", 24)
    assert sorted(r.k for r in collected(spark, folder, stream, "recent").collect()) == ["new", "undated"]


def page(i, words, published="2024-03-05"):
    return (i, f"http://e.com/{i}", f"<html><body><article><p>{words}</p></article></body></html>", published)


def test_folder_to_collection_equals_the_batch(spark, folder):
    clock = lambda: F.lit("2024-03-06 00:00:00").cast("timestamp")
    first = [page(i, f"words of page {i}. " * (30 * i)) for i in range(1, 6)] + [page(7, "stale", "2023-01-01"), page(8, "undated", None), (9, "u", None, None), (10, "u", "", "")]
    second = [page(2, "now short"), page(6, "late to come " * 50), page(1, "too late to change it", "2023-12-31")]

    def run(name):
        incremental.ingest_folder(spark, f"{folder}/in", f"{folder}/{name}", f"{folder}/cp-{name}", 48, clock, files_per_trigger=1, buckets=4).awaitTermination(120)
        return sorted(map(tuple, tables.read(spark, f"{folder}/{name}").collect()))

    land(spark, folder, first, incremental.PAGES)
    run("a")
    land(spark, folder, second, incremental.PAGES)
    got, versions = run("a"), tables.versions(spark, f"{folder}/a")
    for part in (first, second):
        rows = incremental.page_rows(spark.createDataFrame(part, incremental.PAGES), clock(), 48)
        tables.upsert(rows, f"{folder}/batch", "id", replace="article_id", buckets=4)
    assert got == sorted(map(tuple, tables.read(spark, f"{folder}/batch").collect()))
    assert {r[1] for r in got} == {"1", "2", "3", "4", "5", "6", "8"}
    assert run("a") == got and tables.versions(spark, f"{folder}/a") == versions  # nothing new landed
    tables.upsert(incremental.page_rows(spark.createDataFrame(second, incremental.PAGES), clock(), 48), f"{folder}/a", "id", replace="article_id")
    assert sorted(map(tuple, tables.read(spark, f"{folder}/a").collect())) == got  # a batch that runs again
