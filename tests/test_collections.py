"""Bucketed collections: upserts touch their buckets alone, readers see whole versions."""

import glob
import os

import pytest
from newsloom.sources import tables
from pyspark.sql import functions as F


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/chunks"


def contents(spark, path, version=None):
    return sorted(map(tuple, tables.read(spark, path, version).collect()), key=str)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upsert_twice_is_once(spark, path):
    rows = spark.createDataFrame([("a_0", "a", "x"), ("a_1", "a", "y"), ("b_0", "b", "z")], "id string, article_id string, text string")
    assert tables.opened(spark, path) is None and tables.read(spark, path) is None and tables.lookup(spark, path, ["a"]) is None
    assert [tables.upsert(rows, path, replace="article_id", buckets=8) for _ in range(2)] == [1, 2]
    assert contents(spark, path) == sorted(map(tuple, rows.collect()), key=str)
    tables.upsert(rows.filter("id = 'a_0'").withColumn("text", F.lit("new")), path, replace="article_id")
    assert contents(spark, path) == [("a_0", "a", "new"), ("b_0", "b", "z")]
    tables.upsert(rows.filter("id = 'a_1'"), path)  # by id alone, nothing else of the article goes
    assert [r[0] for r in contents(spark, path)] == ["a_0", "a_1", "b_0"]
    assert contents(spark, path, 2) == sorted(map(tuple, rows.collect()), key=str)
    assert [r.id for r in tables.lookup(spark, path, ["b", "c"]).collect()] == ["b_0"]
    with pytest.raises(ValueError, match="bucketed by article_id"):
        tables.upsert(rows, path, replace="text")


def test_upsert_reads_and_writes_only_its_buckets(spark, path):
    base = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    tables.upsert(base, path, buckets=32)
    before, live = files(path), tables.opened(spark, path).live
    assert len(before) == 32 == len(live)
    new = base.filter("id IN (5, 77)").unionByName(base.limit(1).withColumn("id", F.lit(9999).cast("long"))).withColumn("text", F.lit("new"))
    touched = {r[0] for r in new.select(tables.bucket_of(F.col("id"), 32)).collect()}
    tables.upsert(new.unionByName(new), path)
    after, now = files(path), tables.opened(spark, path).live
    assert len(set(after) - set(before)) == len(touched) <= 3 and {b for b in now if now[b] != live[b]} == touched
    assert all(after[f] == t for f, t in before.items())
    got = {r.id: r.text for r in tables.read(spark, path).collect()}
    assert len(got) == 2001 and sorted(k for k, t in got.items() if t == "new") == [5, 77, 9999]
    # the files that the merge scanned
    merged = tables._rows(spark, path, tables.opened(spark, path, 1), sorted(touched))
    assert len(merged.inputFiles()) == len(touched)
    assert len(tables.lookup(spark, path, [5]).inputFiles()) == 1


def test_expiry_keeps_what_kept_versions_need(spark, path):
    rows = spark.range(300).withColumn("text", F.lit("a"))
    for k in range(4):
        tables.upsert(rows.filter(F.col("id") % 100 == k).withColumn("text", F.lit(f"v{k}")) if k else rows, path, buckets=8)
    os.makedirs(f"{path}/data/staged-left/bucket=1")
    want = contents(spark, path), contents(spark, path, 3)
    gone = tables.expire(spark, path, keep=2)
    assert any("staged-left" in g for g in gone) and tables.versions(spark, path) == [3, 4]
    assert (contents(spark, path), contents(spark, path, 3)) == want and tables.read(spark, path, 1) is None
    assert tables.expire(spark, path, keep=2) == []


def test_empty_upserts_nulls_and_clashing_commits(spark, path):
    rows = spark.createDataFrame([("a", None, 1), (None, "x", 2)], "id string, text string, bucket2 int")
    assert tables.upsert(rows.limit(0), path, buckets=4) == 1 and contents(spark, path) == []
    tables.upsert(rows, path)
    tables.upsert(rows.limit(0), path)
    tables.upsert(rows.filter("id IS NULL"), path)
    assert contents(spark, path) == sorted(map(tuple, rows.collect()), key=str)
    known = tables.opened
    try:
        tables.opened = lambda s, p, v=None: known(s, p, 2 if v is None else v)  # a writer that started at version 2
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            tables.upsert(rows, path)
    finally:
        tables.opened = known
    assert tables.opened(spark, path).version == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_ingest_search_asks_with_every_hundredth_title(spark):
    from newsloom.functions import html
    from newsloom.operators import sparse
    from newsloom.plans import QUERIES
    from newsloom.plans.ingest import page_chunks

    sf_dir = "/root/testdata/sf0.001"
    titles = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id % 100 = 0").select("page_id", html.title(F.col("html")).alias("title"))
    index = sparse.build_index(page_chunks(spark, sf_dir), "id", "text")
    want = sparse.top_k(sparse.scores(index, sparse.query_terms(titles, "page_id", "title")), 5, positive=True)
    rank = lambda found: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in found.collect())
    assert rank(QUERIES["ingest_search"](spark, sf_dir)) == rank(want) != []
