"""Numbers, packets, percentiles and intervals that no single task holds, against plain Python."""

import random

import pytest
from newsloom.operators import chunking, metrics, review, runlog, sampling
from pyspark.sql import functions as F


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield request.param
    spark.conf.set("spark.sql.exchange.reuse", before)


def test_numbers_do_not_rest_on_reused_exchanges(spark, reuse):
    n = 1_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"))
    got = runlog.numbered(rows, "k", ranges=37)
    seen = got.agg(F.count("*").alias("n"), F.count_distinct("at").alias("d"), F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    assert tuple(seen) == (n, n, 0, n - 1)
    # order: a row's key lies between those of its neighbours, taken from a second evaluation
    again = runlog.numbered(rows, "k", ranges=5).select("k", F.col("at").alias("at2"))
    assert got.join(again, "k").filter("at <> at2").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "date", "double"])
def test_numbers_of_any_type_with_nulls_and_ties(spark, kind):
    rng = random.Random(3)
    keys = [None, None] + [rng.randint(0, 300) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "i int").select({"long": F.col("i").cast("long"), "string": F.col("i").cast("string"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")), "double": F.col("i") / 7}[kind].alias("k"))
    got = [r.k for r in runlog.numbered(df, "k", ranges=9).orderBy("at").collect()]
    assert got == [r.k for r in df.orderBy("k").collect()]
    assert sorted(r.at for r in runlog.numbered(df, "k", ranges=9).collect()) == list(range(len(keys)))
    assert runlog.numbered(df.limit(0), "k").collect() == [] == runlog.numbered(df.limit(0), "k", ranges=4).collect()
    assert {r.batch for r in runlog.batches(df, "k", 100).collect()} == set(range(6))


def test_positional_sample_is_that_of_the_list(spark, reuse):
    df = spark.range(5000).withColumnRenamed("id", "a").repartition(6)
    assert sorted(r.a for r in sampling.positional_sample(df, "a", 9, 5).collect()) == sorted(random.Random(5).sample(range(5000), 9))


@pytest.mark.parametrize("block", [1, 3, 7, 50, 100_000])
@pytest.mark.parametrize("most", [0, 6, 60])
def test_packets_in_blocks_are_those_of_one_pass(spark, block, most):
    rng = random.Random(block + most)
    rows = [(3 * i, rng.randint(0, most)) for i in range(180)]
    want, packet, held, total = {}, 0, 0, 0
    for a, size in rows:
        if held and (held == 4 or total + size > 20):
            packet, held, total = packet + 1, 0, 0
        held, total = held + 1, total + size
        want[a] = packet
    got = review.packets(spark.createDataFrame(rows, "article_id long, n int").repartition(3), 4, 20, block).collect()
    assert {r.article_id: r.packet for r in got} == want


def test_percentiles_are_selected_exactly(spark):
    rng = random.Random(8)
    groups = {
        "flat": [rng.random() for _ in range(3000)], "heavy": [2.0 ** rng.randint(-900, 900) for _ in range(2000)], "wide": [-1.7e308, 1.7e308, 0.0, 5.0], "one": [4.0], "same": [2.5] * 900,
        "ends": [float("-inf"), 1.0, 2.0, float("inf")], "ints": [float(rng.randint(0, 20)) for _ in range(999)], "tiny": [5e-324 * k for k in range(7)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "metric string, value double").repartition(5)
    got = {r.metric: r for r in metrics.distribution_summary(df, "metric", "value").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        at = lambda f: sorted(vs)[round((len(vs) - 1) * f)]
        assert [got[g][c] for c in ("count", "min", "max", "p25", "p50", "p75", "p95")] == [len(vs), min(vs), max(vs), at(0.25), at(0.5), at(0.75), at(0.95)], g


def test_latency_by_selection_is_that_of_percentiles(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([None, rng.expovariate(0.01), 5.0])) for _ in range(4000)] + [("one", 1, 3.0)], "k string, j int, v double")
    for keys in ((), ("k",), ("k", "j")):
        want = {tuple(r[k] for k in keys): [r[c] for c in ("count", "mean", "p50", "p95", "max")] for r in metrics.latency_summary(df, "v", *keys).collect()}
        got = {tuple(r[k] for k in keys): [r[c] for c in ("count", "mean", "p50", "p95", "max")] for r in metrics.latency_by_selection(df, "v", *keys).collect()}
        assert set(got) == set(want) and all(g == pytest.approx(want[k]) for k, g in got.items())


def brute_overlaps(spans, chunks):
    return sorted((q, c) for q, a, s, e in spans for c, b, cs, ce in chunks if a == b and cs < e and s < ce)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_interval_join_matches_brute_force(spark, width):
    rng = random.Random(width)
    spans = [(f"q{i}", rng.choice("ab"), s := rng.randint(0, 60), s + rng.choice([0, 1, 5, 40])) for i in range(60)]
    chunks = [(f"c{i}", rng.choice("ab"), s := rng.randint(0, 60), s + rng.choice([0, 1, 9, 30])) for i in range(60)]
    a = spark.createDataFrame(spans, "question_id string, article_id string, start int, end int")
    b = spark.createDataFrame(chunks, "id string, article_id string, char_start int, char_end int")
    got = [(r.question_id, r.chunk_id) for r in chunking.spans_to_chunks(a, b, width).collect()]
    assert sorted(got) == brute_overlaps(spans, chunks)


def test_interval_join_of_one_long_article_stays_linear(spark):
    """1e5 chunks and 1e4 spans of one article are 1e9 pairs by article alone; by bins they are a few for each row."""
    chunks = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("a").alias("article_id"), (F.col("id") * 100).cast("int").alias("char_start"), (F.col("id") * 100 + 90).cast("int").alias("char_end"))
    spans = spark.range(10_000).select(F.concat(F.lit("q"), "id").alias("question_id"), F.lit("a").alias("article_id"), (F.col("id") * 997 + 50).cast("int").alias("start"), (F.col("id") * 997 + 160).cast("int").alias("end"))
    found = chunking.spans_to_chunks(spans, chunks, 512)
    starts = range(50, 50 + 997 * 10_000, 997)
    want = sum(c * 100 < s + 110 and s < c * 100 + 90 for s in starts for c in range(s // 100, (s + 109) // 100 + 1))
    assert found.count() == want
    pairs = spans.select("article_id", F.explode(F.sequence(F.floor(F.col("start") / 512), F.floor((F.col("end") - 1) / 512))).alias("bin")).join(
        chunks.select("article_id", F.explode(F.sequence(F.floor(F.col("char_start") / 512), F.floor((F.col("char_end") - 1) / 512))).alias("bin")), ["article_id", "bin"]
    )
    assert pairs.count() < 100_000


def test_semantic_chunks_break_where_neighbours_differ(spark):
    import numpy as np
    from newsloom.operators import dense

    topics = ["The copper mine opened in the north.", "The copper mine closed in the north.", "Tennis final won by the champion!", "Tennis final lost by the champion!", "Rain falls?"]
    rng = random.Random(1)
    rows = [(f"a{i}", " ".join(rng.choice(topics) for _ in range(rng.randint(1, 9)))) for i in range(12)] + [("blank", "  "), ("none", None)]
    df = spark.createDataFrame(rows, "article_id string, text string")
    embed, want = dense.hashed_embedder()(), []
    for a, text in rows:
        parts = [s for t in [text or ""] for s in __import__("re").split(r"(?<=[.!?]) ", t.strip()) if s]
        vectors, chunk = embed(parts) if parts else [], 0
        held = {}
        for i, s in enumerate(parts):
            chunk += i > 0 and float(np.dot(vectors[i], vectors[i - 1])) < 0.3
            held.setdefault(int(chunk), []).append(s)
        want += [(a, k, " ".join(v)) for k, v in held.items()]
    got = sorted(tuple(r) for r in chunking.semantic_chunks(df, "article_id", "text", 0.3).collect())
    assert got == sorted(want) and len({k for _, k, _ in got}) > 2
