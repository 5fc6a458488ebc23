"""What tasks and Python hold does not grow with the tables: texts stay where they are, and are handed on in bounded parts."""

import contextlib
import dataclasses
import io
import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from newsloom.functions import text as fx
from newsloom.operators import chunking, fusion, sparse
from newsloom.plans import retrieval, runs
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_automatic_broadcast(spark):
    """As with large tables: only what is marked for it is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_search_counts_documents_in_one_pass(spark):
    texts = {1: "the cat", 2: "the dog the", 3: "the", 4: None, 5: "a cat cat sat"}
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    queries = spark.createDataFrame([("q", "the cat"), ("r", "nowhere"), ("s", "dog dog")], "q string, t string")
    index = dataclasses.replace(sparse.build_index(docs, "id", "t"), terms=None, corpus=None)  # a search over texts asks for neither
    got = {(r.query_id, r.id): r.score for r in sparse.search(index, queries, "q", "t", 3).collect()}
    ws = {i: (t or "").split() for i, t in texts.items()}
    df = {w: sum(w in x for x in ws.values()) for x in ws.values() for w in x}
    raw = {w: math.log(5 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    avg = sum(map(len, ws.values())) / 5
    part = lambda w, x: idf.get(w, 0) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg))
    want = {(q, i): s for q, t in (("q", "the cat"), ("s", "dog dog")) for i, x in ws.items() if (s := sum(part(w, x) for w in t.split())) > 0}
    best = {k: v for k, v in want.items() if sum(o > v for (q, _), o in want.items() if q == k[0]) < 3}
    assert got == pytest.approx(best)


def test_documents_are_looked_up_some_words_at_a_time(monkeypatch):
    monkeypatch.setattr(sparse, "MAX_WORDS", 10)
    ws = [["w"] * n for n in (3, 0, 30, 4, 4, 4, 0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(ws, pa.list_(pa.string()))], ["id", "ws"])
    parts = list(sparse._parts(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 3
    assert all(sum(len(x) for x in p.column("ws").to_pylist()[1:]) < 10 for p in parts)


def test_texts_without_hits_are_not_shuffled(spark, no_automatic_broadcast):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    hits = spark.createDataFrame([("q", 1, 3), ("q", 2, 99), ("r", 1, 3)], "query_id string, rank int, id long")
    out = fusion.with_text(hits, docs, "doc_id")
    assert sorted((r.query_id, r.id, r.text) for r in out.collect()) == [("q", 3, "text 3"), ("q", 99, ""), ("r", 3, "text 3")]
    assert re.search(r"BroadcastHashJoin \[\S+\], \[\S+\], LeftSemi", plan(out))


def test_postings_of_frequent_words_are_not_shuffled(spark, no_automatic_broadcast):
    keyed = spark.createDataFrame([("q", ["often", "rare"]), ("r", ["absent"]), ("s", ["often"])], "query_id string, keys array<string>")
    postings = spark.createDataFrame([(i, "often") for i in range(30)] + [(7, "rare"), (8, "rare")], "id long, key string")
    out = retrieval.candidates(keyed, postings)
    assert sorted(map(tuple, out.collect())) == sorted([("q", 7), ("q", 8)] + [("s", i) for i in range(30)])
    assert "SortMergeJoin" not in plan(out) and "hashpartitioning" not in plan(out)


def test_hits_and_gold_are_found_once(spark):
    for df in (retrieval.bm25_hits(spark, SMALL), retrieval.gold(spark, SMALL)):
        assert "FileScan parquet" in plan(df) and "Exchange" not in plan(df)
        assert df.count() == len({(r.query_id, r.id) for r in df.collect()}) > 0


def test_a_search_finds_the_candidates_of_gold(spark, monkeypatch):
    def second_pass(*_):
        raise AssertionError("documents are cut into words once more")

    want = {(r.query_id, r.id) for r in retrieval.gold(spark, SMALL).collect()}
    monkeypatch.setattr(retrieval, "candidates", second_pass)
    hits, pairs = retrieval.hits_and_gold(spark, SMALL)
    assert {(r.query_id, r.id) for r in pairs.collect()} == want and want
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, retrieval.bm25_hits(spark, SMALL).collect()))
    assert runs.stored_scores(spark, SMALL).count() > 0 and retrieval.delta_mrr(spark, SMALL).count() == 1


@pytest.mark.parametrize("terms, scores, twice", [(500_000, 1 << 18, False), (4, 1, False), (500_000, 1 << 18, True)])
def test_holders_of_the_rarest_key(spark, monkeypatch, terms, scores, twice):
    monkeypatch.setattr(sparse, "MAX_BROADCAST_TERMS", terms)
    monkeypatch.setattr(sparse, "BLOCK_SCORES", scores)
    texts = [(i, "often " + ("mid " if i % 3 == 0 else "") + ("rare" if i % 10 == 0 else "")) for i in range(40)] + [(90, None), (91, "")]
    texts += [(10, "often twice")] if twice else []
    asked = [("q", "a often mid rare b"), ("q", "a often mid b"), ("r", "a often absent b"), ("s", "often rare"), ("t", None), ("u", "x often y")]
    index = sparse.build_index(spark.createDataFrame(texts, "i long, t string").repartition(3), "i", "t")
    queries = spark.createDataFrame(asked, "q string, t string")
    hits, holders = sparse.search_with_holders(index, queries, "q", "t", 4, retrieval.inner)
    rank = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rank(hits) == rank(sparse.search(index, queries, "q", "t", 4)) != []
    # a key in no document has no holders: its item is in none
    want = {("q", i) for i, t in texts if t and ("rare" in t or "mid" in t)} | {("u", i) for i, t in texts if t}
    assert {tuple(r) for r in holders.collect()} == want


def test_a_search_cuts_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(i, f"the cat {i}") for i in range(30)] + [(30, None)], "id long, t string")
    index = sparse.build_index(docs, "id", "t")
    index = dataclasses.replace(index, texts=index.texts.withColumn("text", seen("text")))
    queries = spark.createDataFrame([("q", "the cat 7 cat")], "q string, t string")
    hits, holders = sparse.search_with_holders(index, queries, "q", "t", 3, retrieval.inner)
    assert hits.first()["id"] == 7 and [r.id for r in holders.collect()] == [7]
    assert read.value == 31


ODD = [None, "", " ", "a", " A  b\u00a0c a\n", "\t\x0bx\x0cy\rz\x1cz\x1dw\x85v\u2003u\u3000t\u2028s ", "\u0130I \u03a3\u03a3 \u00df \U0001f600 \x00", "b " * 50, "a x y"]


def test_words_of_a_survey_are_those_of_tokens(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    want = {r.id: r.ws for r in docs.select("id", fx.tokens(F.col("t")).alias("ws")).collect()}
    texts = sparse.build_index(docs, "id", "t").texts.toArrow().combine_chunks().to_batches()
    names = pa.array(["a", "b", "nowhere", "z\x1cz\x1dw\x85v\u2003u\u3000t\u2028s"])
    for words in (1 << 20, 3):  # all at once, and handed on in parts
        monkeypatch.setattr(sparse, "MAX_WORDS", words)
        rows = [r for b in sparse._survey(iter([*texts, texts[0].slice(0, 0)]), names) for r in b.to_pylist()]
        own = {r["id"]: r for r in rows if r["term"] is None}
        assert len(own) == len(ODD) and all(r["df"] == 1 and r["dl"] == len(want[i]) for i, r in own.items())
        for i, r in own.items():
            assert list(zip(r["code"], r["tf"])) == [(c, want[i].count(w)) for c, w in enumerate(names.to_pylist()) if w in want[i]]
        df = Counter()
        for r in rows:
            if r["term"] is not None:
                df[r["term"]] += r["df"]
        assert df == Counter(w for ws in want.values() for w in set(ws)) and "" not in df
    assert len(rows) > len(ODD) + len(df)  # more than one row for some word


def test_items_that_share_an_id_have_gold_each(spark, tmp_path):
    docs = [(1, "x one two three y"), (2, "x four five six y"), (3, "x four five y"), (4, None)]
    items = [("q", "one two three"), ("q", "four five six"), ("r", "five"), ("s", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(q, i) for q, t in items for i, d in docs if t and d and t in d}
    assert {tuple(r) for r in retrieval.gold(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in retrieval.hits_and_gold(spark, str(tmp_path))[1].collect()} == want


def test_one_long_text_is_handed_on_in_parts(monkeypatch):
    class Caught:
        def mapInPandas(self, run, schema):  # the task's function, run here
            self.run = run

        def select(self, *_):
            return self

    caught = Caught()
    chunking.recursive_chunks(caught, "i", "t", 5, 1)
    monkeypatch.setattr(chunking, "OUT_CHARS", 50)
    text = "one two three four\n" * 40
    frames = [f for f in caught.run(iter([chunking.pd.DataFrame({"a": ["1", "2"], "t": [text, None]})])) if len(f)]
    assert len(frames) > 5 and max(f["text"].str.len().sum() for f in frames) < 100
    assert [(r.char_start, r.char_end) for f in frames for r in f.itertuples()] == chunking.chunk_spans(text, 5, 1)


def test_line_offsets_come_from_lengths(spark):
    texts = [None, "", "\n", "a\n\nb\n", "\U0001f600\nx", "long line\n" * 3000]
    out = chunking.line_chunks(spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(1), "i", "t")
    rows = out.collect()
    assert all(texts[r.article_id][r.char_start : r.char_end] == r.text for r in rows) and len(rows) == 2 + 2 + 3000
    assert "line_starts(transform(split(" in plan(out)
