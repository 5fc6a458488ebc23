"""Gates, joins, sinks, sources and streams on small frames."""

import random

import pytest
from newsloom.operators import clusters, dense, discovery, fusion, review, runlog, sampling, sparse
from newsloom.sources import readers, sinks, tables
from newsloom.streaming import incremental
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_sample_ignores_row_order_and_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "a")
    first = sorted(r.a for r in sampling.sample(df, "a", 20, 3).collect())
    assert first == sorted(r.a for r in sampling.sample(df.orderBy(F.desc("a")).repartition(7), "a", 20, 3).collect())
    import random

    got = sorted(r.a for r in sampling.positional_sample(df, "a", 5, 11).collect())
    assert got == sorted(random.Random(11).sample(range(200), 5))


def test_review_gates(spark):
    t = spark.createDataFrame([("1", "q1"), ("2", "q2")], "question_id string, question string")
    notes = spark.createDataFrame([("1", "standalone", "", False)], "question_id string, label string, clarified string, excluded boolean")
    with pytest.raises(ValueError, match="missing"):
        review.derived_testsets(t, notes)
    reviews = spark.createDataFrame([("1", "", None, "context_dependent", ["p"], " ", False, ""), ("2", "ok", "r", "standalone", [], "", True, "")], "question_id string, decision string, reviewer string, label string, reason_codes array<string>, clarified string, excluded boolean, notes string")
    found = {tuple(r) for r in review.approval_violations(reviews).collect()}
    assert found == {("1", "decision_missing"), ("1", "reviewer_missing"), ("1", "clarification_missing"), ("2", "exclusion_reason_missing")}
    warned = review.settled_labels(reviews, review.approval_violations(reviews).filter("question_id = '1'"))
    assert {r.question_id: r.label for r in warned.collect()} == {"1": "uncertain", "2": "standalone"}


def test_reviews_are_carried_and_proposals_applied(spark):
    queue = spark.createDataFrame([("1", "q", "c"), ("2", "q", "new"), ("3", "q", None)], "question_id string, question string, candidate string")
    old = spark.createDataFrame([("1", "q", "c", "yes", "r"), ("2", "q", "old", "yes", "r"), ("3", "q", None, "no", "r")], "question_id string, question string, candidate string, decision string, reviewer string")
    assert {r.question_id: r.decision for r in review.carried_reviews(queue, old).collect()} == {"1": "yes", "2": None, "3": "no"}
    changes = spark.createDataFrame([("2", "hacked", "better")], "question_id string, question string, candidate string")
    updated, audit = review.applied_proposals(queue, changes)
    assert {tuple(r) for r in updated.filter("question_id = '2'").collect()} == {("2", "q", "better")}
    assert [tuple(r) for r in audit.collect()] == [("2", "candidate", "new", "better")]
    with pytest.raises(ValueError, match="extra"):
        review.applied_proposals(queue, changes.withColumn("question_id", F.lit("9")))


def test_packets_are_bounded(spark):
    counts = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "article_id long, n long")
    sizes = lambda **kw: sorted(r["count"] for r in review.packets(counts, **kw).groupBy("packet").count().collect())
    assert sizes(max_articles=2) == [1, 2] and sizes(max_questions=1) == [1, 1, 1] and sizes() == [3]


@pytest.mark.parametrize("n,most", [(0, 9), (7, 3), (500, 9), (500, 400)])
def test_packets_over_ranges_are_those_of_one_pass(spark, n, most):
    rng = random.Random(n + most)
    rows = [(3 * i, rng.randint(0, most)) for i in range(n)]
    want, packet, held, total = {}, 0, 0, 0
    for a, size in rows:
        if held and (held == 4 or total + size > 20):
            packet, held, total = packet + 1, 0, 0
        held, total = held + 1, total + size
        want[a] = packet
    rng.shuffle(rows)
    got = review.packets(spark.createDataFrame(rows, "article_id long, n long"), 4, 20).collect()
    assert {r.article_id: r.packet for r in got} == want


def test_searches_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(120)] + [(200, None), (201, [0.0] * 3), (202, [1.0]), (203, [1.0, None, 2.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = table.filter("id % 10 = 0 OR id > 200").select(F.col("id").alias("query_id"), "embedding")
    for metric in dense.METRICS:
        whole = sorted(map(tuple, dense.search(table, asked, 7, metric).select("query_id", "id", "rank").collect()))
        monkeypatch.setattr(dense, "MAX_BROADCAST_BYTES", 100)
        assert sorted(map(tuple, dense.search(table, asked, 7, metric).select("query_id", "id", "rank").collect())) == whole
        monkeypatch.undo()
        score = {"cosine": lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1), "ip": lambda a, b: sum(x * y for x, y in zip(a, b)), "l2": lambda a, b: 1 - sum((x - y) ** 2 for x, y in zip(a, b))}[metric]
        good = [(i, v) for i, v in rows if v and len(v) == 3 and None not in v]
        for q in (0, 50, 201):
            best = sorted(good, key=lambda r: (-round(score(dict(good)[q], r[1]), 6), r[0]))[:7]
            assert [b for a, b, _ in sorted((x for x in whole if x[0] == q), key=lambda x: x[2])] == [i for i, _ in best]


def test_clusters(spark):
    q = spark.createDataFrame([("1", "a", "x", ["p"], ["c2"]), ("2", "a", "y", ["q", "p"], ["c1"]), ("3", "b", "z", ["r"], [])], "question_id string, article_id string, question string, accepted_answers array<string>, relevant_chunk_ids array<string>")
    schema = "cluster_id string, article_id string, members array<string>, representative string, target string, rationale string"
    good = spark.createDataFrame([("k", "a", ["1", "2"], "2", "t", "r")], schema)
    rows = {r.representative: r for r in clusters.deduplicated(good, q).collect()}
    assert rows["2"].accepted_answers == ["q", "p"] and rows["2"].relevant_chunk_ids == ["c1", "c2"] and rows["3"].members == ["3"]
    assert {tuple(r) for r in clusters.summary(clusters.deduplicated(good, q)).collect()} == {(2, 1, 1)}
    bad = spark.createDataFrame([("k", "a", ["1", "3"], "1", "t", "r"), ("m", "a", ["1", "9"], "1", "", "r")], schema)
    assert {tuple(r) for r in clusters.violations(bad, q).collect()} == {("k", "other_article"), ("m", "unknown_member"), ("m", "target_missing"), ("k", "shared_member"), ("m", "shared_member")}
    with pytest.raises(ValueError, match="unsound"):
        clusters.deduplicated(bad, q)
    approvals = spark.createDataFrame([("k", "rejected"), ("z", "approved")], "cluster_id string, decision string")
    assert {tuple(r) for r in clusters.approval_violations(good, approvals).collect()} == {("z", "extra"), ("k", "not_approved")}
    ids = spark.createDataFrame([("1",), ("2",)], "question_id string")
    assert {tuple(r) for r in clusters.not_partition(ids, ids.filter("question_id = '1'"), ids.filter("question_id = '1'")).collect()} == {("2", "lost"), ("1", "extra"), ("1", "in_both")}
    assert clusters.paired_mismatch(ids, ids, "question_id").count() == 0


def test_log_reader_separates_torn_lines(spark, folder):
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write('{"q": 1}\n{"q": 2}\n{"q": ')
    with open(f"{folder}/b.jsonl", "w") as f:
        f.write('{"q": 1}\nbroken\n{"q": 3}\n')
    good, torn, broken = readers.log(spark, f"{folder}/*.jsonl")
    assert (good.count(), [r.line for r in torn.collect()], [r.line for r in broken.collect()]) == (4, ['{"q": '], ["broken"])


def test_quarantine_takes_torn_lines_and_fails_on_others(spark, folder):
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write("\n".join('{"q": %d}' % i for i in range(3000)) + '\n{"q": \n\n')
    with open(f"{folder}/b.jsonl", "w") as f:
        f.write('{"q": 1}\n{"q": 3}\n')
    open(f"{folder}/c.jsonl", "w").close()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", before):  # splits inside a file, and several files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good = readers.quarantined_log(spark, f"{folder}/*.jsonl", f"{folder}/q{size}")
            assert good.count() == 3002
            assert [(r.file[-7:], r.line, r.state) for r in readers.set_aside(spark, f"{folder}/q{size}").collect()] == [("a.jsonl", '{"q": ', "torn")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(f"{folder}/d.jsonl", "w") as f:
        f.write('{"q": 1}\nbroken\n{"q": 3}\n')
    with pytest.raises(Exception, match="d.jsonl: broken"):
        readers.quarantined_log(spark, f"{folder}/*.jsonl", f"{folder}/q2")
    assert sorted(r.state for r in readers.set_aside(spark, f"{folder}/q2").collect()) == ["broken", "torn"]


def test_review_status_is_one_pass(spark):
    from newsloom.operators import reports

    rows = spark.createDataFrame([("1", "a", "ok", ["x", "y"]), ("2", None, None, []), ("3", "a", "ok", None), ("4", "b", None, ["x"])], "question_id string, label string, decision string, reason_codes array<string>")
    got = sorted(map(tuple, reports.review_status(rows).collect()))
    assert got == [("decision", "none", 2), ("decision", "ok", 2), ("issue", "x", 2), ("issue", "y", 1), ("label", "a", 2), ("label", "b", 1), ("label", "none", 1), ("ready", "false", 4)]
    assert reports.review_status(rows)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    report = reports.score_report(spark.createDataFrame([("r", g, q, a, "l" + q, "m", v) for g, q, a, v in [("retrieval", "1", "x", 1.0), ("retrieval", "2", "x", 0.0), ("retrieval", "3", "y", 1.0), ("reranked", "1", "x", 1.0), ("judge", "1", "x", 0.5)]], reports.SCORES))
    got = {(r.group, r.metric): round(r.value, 6) for r in report.collect()}
    assert got[("retrieval", "m")] == round(2 / 3, 6) and got[("retrieval:macro", "m")] == 0.75 and got[("delta", "m")] == round(1 / 3, 6) and got[("judge", "m")] == 0.5 and got[("retrieval:label:l2", "m")] == 0
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_html_directory_decodes(spark, folder):
    with open(f"{folder}/u.html", "wb") as f:
        f.write("<p>é “ok”</p>".encode())
    with open(f"{folder}/w.html", "wb") as f:
        f.write("<p>é “ok”</p>".encode("cp1252"))
    with open(f"{folder}/x.txt", "wb") as f:
        f.write(b"no")
    got = {r.filename: r.html for r in readers.html_directory(spark, folder).collect()}
    assert got == {"u.html": "<p>é “ok”</p>", "w.html": "<p>é “ok”</p>"}


def test_clean_articles_default_their_id(spark, folder):
    with open(f"{folder}/story_clean.json", "w") as f:
        f.write('{"text": "t",\n "metadata": {"title": "T"}}')
    row = readers.clean_articles(spark, folder).first()
    assert (row.article_id, row.text, row.title, row.url) == ("story", "t", "T", "")


def test_review_csv_round_trip(spark, folder):
    rows = spark.createDataFrame([("1", "a", "standalone", ["x", 'y"z'], None, False, "n,\nm")], "question_id string, article_id string, label string, reason_codes array<string>, clarified string, excluded boolean, notes string")
    sinks.review_csv(rows, f"{folder}/r")
    back = readers.review_csv(spark, f"{folder}/r", rows.select("question_id")).first()
    assert back.reason_codes == ["x", 'y"z'] and back.notes == "n,\nm" and back.excluded is False
    with pytest.raises(ValueError, match="unknown"):
        readers.review_csv(spark, f"{folder}/r", rows.select("question_id").limit(0))


def test_sinks_layout(spark, folder):
    df = spark.createDataFrame([("s1", "ab12", "t"), ("s2", "cd34", "u")], "source string, url_hash string, text string")
    sinks.articles(df, f"{folder}/articles")
    sinks.articles(df, f"{folder}/articles", existing=df)
    stored = spark.read.json(f"{folder}/articles")
    assert stored.count() == 2 and {r.hash_prefix for r in stored.collect()} == {"ab", "cd"}
    sinks.manifest(df.withColumn("ts", F.lit("2024-03-05").cast("timestamp")), f"{folder}/m")
    assert spark.read.json(f"{folder}/m").select("year", "month", "day").distinct().count() == 1


def test_existence_needs_all_kinds(spark):
    objects = spark.createDataFrame([("h", "html"), ("h", "text"), ("h", "meta"), ("g", "html"), ("g", "html")], "url_hash string, kind string")
    assert [r.url_hash for r in discovery.stored_urls(objects).collect()] == ["h"]


def test_search_methods(spark):
    chunks = spark.createDataFrame([("1", "copper mine opens in the north"), ("2", "tennis final won by the champion"), ("3", ""), ("4", None)], "id string, text string")
    asked = spark.createDataFrame([("q", "copper mine"), ("none", "")], "query_id string, text string")
    for method in ("bm25", "dense", "hybrid"):
        assert fusion.retrieve(asked, chunks, 2, method).filter("query_id = 'q' AND rank = 1").first().id == "1"
    with pytest.raises(ValueError):
        fusion.retrieve(asked, chunks, 2, "magic")
    with pytest.raises(ValueError):
        dense.distance(F.lit(1), F.lit(1), "manhattan")


def test_stored_index_moves_no_postings(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "c d"), (4, None), (5, "")], "i long, t string")
    index, stored = sparse.build_index(docs, "i", "t"), sparse.write_index(docs, "i", "t", f"{folder}/it's", buckets=4)
    asked = spark.createDataFrame([(9, "b d b"), (10, "x"), (11, None)], "q long, t string")
    rank = lambda ix: [(r.query_id, r.id, round(r.score, 9)) for r in sparse.search(ix, asked, "q", "t", 3).orderBy("query_id", "rank").collect()]
    assert rank(index) == rank(stored) == rank(sparse.Index.read(spark, f"{folder}/it's")) != []
    monkeypatch.setattr(sparse, "MAX_BROADCAST_TERMS", 0)  # too many query terms to send
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sparse.scores(stored, sparse.query_terms(asked, "q", "t"))
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sorted(r.id for r in found.collect()) == sorted(r[1] for r in rank(index))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "tf#" in line)
    join = max(i for i in range(at) if "SortMergeJoin" in plan[i])
    assert "Bucketed: true" in plan[at] and not any("Exchange" in line for line in plan[join:at])


def test_chunkers_plug_in_with_offsets(spark):
    from newsloom.operators import chunking, seams

    rows = [("a", "One two. Three\u00e9 \U0001f600 four."), ("b", ""), ("c", None)]
    df = spark.createDataFrame(rows, "i string, t string")

    def load():
        return lambda text: [(k, min(k + 7, len(text))) for k in range(0, len(text), 7)]

    got = sorted((r.id, r.chunk_index, r.char_start, r.char_end, r.text) for r in seams.chunked(df, "i", "t", load).collect())
    assert got == [(f"a_{k}", k, 7 * k, min(7 * k + 7, len(rows[0][1])), rows[0][1][7 * k : 7 * k + 7]) for k in range(4)]
    whole = seams.chunked(df, "i", "t", lambda: lambda t: chunking.chunk_spans(t, 4, 1))
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r)[:6] for r in chunking.recursive_chunks(df, "i", "t", 4, 1).collect())
    for bad in ((3, 3), (5, 2), (0, 10**6), (-1, 4)):
        with pytest.raises(Exception, match="of a text of"):
            seams.chunked(df, "i", "t", lambda: lambda t: [bad]).collect()


def test_stores_are_completed(spark, folder):
    df = spark.range(50).withColumn("text", F.lit("x"))
    seen = []
    first, second = sinks.parquet_store("a", f"{folder}/a"), sinks.bucketed_store("b", f"{folder}/b", "id", buckets=4)
    counting = sinks.Store("a", lambda d: (seen.append(d.count()), first.write(d)), first.held)

    def fails(d):
        raise RuntimeError("store b is down")

    assert sinks.holdings(spark, [counting, second], "id") is None
    with pytest.raises(RuntimeError):
        sinks.fan_out(df, [counting, sinks.Store("b", fails, second.held)], "id")
    state = sinks.holdings(spark, [counting, second], "id")
    assert state.filter("everywhere").count() == 0 and [r.missing for r in state.select("missing").distinct().collect()] == [["b"]]
    for _ in range(2):
        sinks.fan_out(df.union(spark.createDataFrame([(99, "y")], "id long, text string")), [counting, second], "id")
    assert seen == [50, 1]
    state = sinks.holdings(spark, [counting, second], "id")
    assert state.count() == 51 == state.filter("everywhere").count()
    assert first.held(spark).count() == 51 == second.held(spark).count()
    third = sinks.parquet_store("c", f"{folder}/c")
    sinks.complete(second, [second, third], spark, "id")
    assert third.held(spark).count() == 51


def test_pending_and_latest(spark):
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "success"), ("b", 1, "exhausted"), ("c", 1, "failed"), ("d", 1, "success"), ("d", 2, "success")], "question_id string, seq long, status string")
    state = runlog.latest(log, "question_id", "seq")
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "question_id string")
    assert sorted(r.question_id for r in runlog.pending(work, state, "question_id").collect()) == ["c", "e"]
    assert sorted(r.question_id for r in runlog.pending(work, state, "question_id", retry_exhausted=True).collect()) == ["b", "c", "e"]
    assert [r.question_id for r in runlog.repeated_success(log, "question_id").collect()] == ["d"]
    a, b = runlog.dataset_fingerprint(log, "question_id", "seq"), runlog.dataset_fingerprint(log.orderBy(F.desc("seq")), "question_id", "seq")
    assert review.migratable(a, b) and not review.migratable(a, runlog.dataset_fingerprint(log.limit(3), "question_id", "seq"))


def landed(spark, folder, parts):
    schema = "k string, seq long, status string, url string, ts timestamp"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    return incremental.drop_folder(spark, f"{folder}/in", schema, 1)


def event(k, seq, status, url="http://e.com/a"):
    import datetime

    return (k, seq, status, url, datetime.datetime(2024, 3, 5, 10, seq))


PARTS = [[event("a", 1, "failed"), event("b", 1, "failed", "http://e.com/b")], [event("a", 3, "success", "http://E.com/a/"), event("a", 2, "failed")]]


def test_stream_latest_state_equals_batch(spark, folder):
    stream = landed(spark, folder, PARTS)
    out = incremental.run_available(incremental.latest_state(stream, "k", "seq", "status"), "latest_t", f"{folder}/cp", "update")
    last = runlog.latest(out, "k", "seq")
    batch = runlog.latest(spark.read.schema("k string, seq long, status string").json(f"{folder}/in"), "k", "seq")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_trace_is_bounded(spark, folder):
    stream = landed(spark, folder, PARTS)
    out = incremental.run_available(incremental.bounded_trace(stream, "k", "seq", "status", 2), "trace_t", f"{folder}/cp", "update")
    longest = {r.k: r.seqs for r in out.orderBy(F.size("seqs"), F.col("seqs")).collect()}
    assert longest == {"a": [2, 3], "b": [1]}


def test_stream_deduplicates_urls(spark, folder):
    stream = landed(spark, folder, PARTS)
    out = incremental.run_available(incremental.new_urls(stream, "url", "ts", "1 hour"), "new_t", f"{folder}/cp")
    assert out.count() == 2


def test_stream_append_and_upsert_are_idempotent(spark, folder):
    stream = landed(spark, folder, PARTS)
    for _ in range(2):
        incremental.append_new(stream, f"{folder}/out", "k", f"{folder}/cp{_}").awaitTermination(60)
    assert spark.read.parquet(f"{folder}/out").count() == 2
    for _ in range(2):
        incremental.upsert_chunks(stream.select("k", "status"), f"{folder}/up", f"{folder}/cu{_}", id="k").awaitTermination(60)
    assert tables.read(spark, f"{folder}/up").count() == 2


def test_model_seams(spark):
    from newsloom.operators import seams

    q = spark.createDataFrame([("1", "Why did he leave?"), ("2", "Who won the cup?"), ("3", None)], "question_id string, question string")
    got = {r.question_id: r.label for r in seams.apply_model(q, seams.rule_triage, seams.TRIAGE).collect()}
    assert got == {"1": "context_dependent", "2": "standalone", "3": "standalone"}
    cache = spark.createDataFrame([("2", "cached", ["x"], 1.0)], seams.TRIAGE)
    got = {r.question_id: r.label for r in seams.apply_pending(q, cache, ["question_id"], seams.rule_triage, seams.TRIAGE).collect()}
    assert got == {"1": "context_dependent", "2": "cached", "3": "standalone"}
    spans = "array<struct<start:int,end:int,text:string>>"
    questions = spark.createDataFrame([("1", "a", "q", "t", [(2, 4, "23")])], f"question_id string, article_id string, question string, ground_truth string, evidence_spans {spans}")
    articles = spark.createDataFrame([("a", "012345"), ("b", "best q line\nother")], "article_id string, text string")
    scored = spark.createDataFrame([("1", "a", "b", 1.0), ("1", "a", "a", 9.0)], "question_id string, source_article_id string, article_id string, score double")
    candidates = review.competing_candidates(scored, articles, questions)
    row = seams.review_requests(questions, articles, candidates).first()
    assert row.window == "01[EVIDENCE]45" and [(c.article_id, c.snippet) for c in row.competitors] == [("b", "best q line")]


def test_search_scores_documents_where_they_stand(spark, monkeypatch):
    words = "the of copper mine opens in north tennis final champion".split()
    texts = [(i, " ".join(["the", *(words[(i * j + j * j) % 10] for j in range(1 + i % 17))])) for i in range(200)] + [(900, None), (901, ""), (902, "x")]
    docs = spark.createDataFrame(texts, "i long, t string").repartition(3)
    asked = spark.createDataFrame([("a", "the copper the mine"), ("b", "of Tennis"), (None, "x"), ("none", "zzz"), ("d", None)], "q string, t string")
    rank = lambda found: [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in found.orderBy("query_id", "rank").collect()]
    index = sparse.build_index(docs, "i", "t")
    want = rank(sparse.top_k(sparse.scores(index, sparse.query_terms(asked, "q", "t")), 7, positive=True))
    found = sparse.search(index, asked, "q", "t", 7)
    assert rank(found) == want and len(want) > 7
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate") == 0  # no posting is a row
    monkeypatch.setattr(sparse, "BLOCK_SCORES", 10)
    monkeypatch.setattr(sparse, "MAX_BROADCAST_TERMS", 2)
    assert rank(sparse.search(index, asked, "q", "t", 7)) == want
    twice = sparse.build_index(docs.unionByName(docs.limit(50)), "i", "t")  # rows that share an id count as one
    assert rank(sparse.search(twice, asked, "q", "t", 7)) == rank(sparse.top_k(sparse.scores(twice, sparse.query_terms(asked, "q", "t")), 7, positive=True))


def test_stored_index_moves_postings_not_pairs(spark, folder):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 9))) for i in range(60)] + [(900, None), (901, "")], "i long, t string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w0 w5 zzz"), (3, None)], "q long, t string")
    rank = lambda found: [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in found.orderBy("query_id", "rank").collect()]
    for name, rows in (("once", docs), ("twice", docs.unionByName(docs.limit(20)))):
        stored = sparse.write_index(rows, "i", "t", f"{folder}/{name}", buckets=3)
        found = sparse.search(stored, asked, "q", "t", 5)
        want = sparse.top_k(sparse.scores(stored, sparse.query_terms(asked, "q", "t")), 5, positive=True)
        assert rank(found) == rank(want) != []
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        built = sparse.build_index(rows, "i", "t")
        assert sorted(map(tuple, stored.postings.select("term", "id", "dl", "tf").collect())) == sorted(map(tuple, built.postings.select("term", "id", "dl", "tf").collect()))
