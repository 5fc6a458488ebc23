"""The pipeline on planted cases, and the registered queries on the smallest tables."""

import os
import random

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from newsloom.llm import packing, queries
from newsloom.llm.common import WRITTEN
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """60 clean documents, toxic ones, copies of document 3, a passage on many sites, a leaked item."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randint(3, 9)))
    prose = lambda n=120: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(prose() for _ in range(3))) for i in range(260)]
    labels = [(i, 1, 0) for i in range(200)]
    for i in range(300, 400):
        rows.append((i, prose(80) + " zorpish " + prose(20)))
        labels.append((i, 1, 1))
    base = rows[3][1]
    copies = {500: base, 501: base.replace(base.split()[10], "changed"), 502: base + " tail"}
    rows += list(copies.items())
    passage = prose(60)
    carriers = list(range(600, 615))
    rows += [(i, f"{prose(50)}\n{passage}\n{prose(50)}") for i in carriers] + [(620, passage)]
    items = [(i, prose(30)) for i in range(5)]
    rows.append((700, prose(60) + " " + items[2][1] + " " + prose(60)))
    folder = str(tmp_path_factory.mktemp("planted"))
    # copies stand on few sites, so their lines are no boilerplate
    site = lambda i: f"s{i % 15}" if i >= 600 else "s0"
    rows += [(None, None), (800, ""), (3, base)]
    spark.createDataFrame([(i, t, "en", site(i or 0), len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage, carriers


def test_stages_on_planted_cases(spark, planted):
    folder, rows, passage, carriers = planted
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == before
    ids = {name: sorted((r.doc_id for r in out), key=str) for name, out in seen.items()}
    everything = sorted((i for i, _ in rows), key=str)
    assert ids["toxicity"] == [i for i in everything if i is None or not 300 <= i < 400]
    lines = {r.doc_id: r for r in seen["line dedup"]}
    assert [i for i in carriers if passage in lines[i].text] == [600] and 620 not in lines
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    assert {i: lines[i].text for i, t in rows if i is not None and i < 260} == {i: t for i, t in rows if i is not None and i < 260}
    near = ids["near-duplicates"]
    assert near.count(3) == 2 and not {500, 501, 502} & set(near) and set(range(260)) <= set(near) and 800 in near and None in near
    assert ids["decontamination"] == [i for i in near if i != 700]
    pieces = seen["packing"]
    kept = {(r.doc_id, r.text or "") for r in seen["decontamination"]}
    encoder = packing.ChunkEncoder(packing.default_tokenizer(), packing.Settings())
    encode = lambda t: [*encoder.encode(pa.array([t]))[0].tolist(), 1]
    assert sum(p.length for p in pieces) == sum(len(encode(r.text or "")) for r in seen["decontamination"])
    one = sorted((p for p in pieces if p.doc_id == 7), key=lambda p: p.start)
    text = next(t for i, t in kept if i == 7)
    assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in one]).tolist() == encode(text)


def test_columns_named_like_results_pass_through(spark, planted):
    folder = planted[0]
    names = ["score", "predicted", "n_lines", "n_removed", "n_words", "n_hit", "hit_items", "kept", "component_id", "row", "id", "key"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *[(F.coalesce("doc_id", F.lit(-1)) * 1000 + i).alias(c) for i, c in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        assert docs.columns == columns
        assert docs.filter(" OR ".join(f"`{c}` <> coalesce(doc_id, -1) * 1000 + {i}" for i, c in enumerate(names))).count() == 0
    assert docs.count() > 200 and corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 200


def test_a_run_leaves_its_result_alone_behind(spark, planted):
    before = list(WRITTEN)
    out = corpus_pipeline.run(spark, planted[0])
    assert len(WRITTEN) == len(before) + 1 and out.count() > 200


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.queries()[name](spark, DIR).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name,table", [("op1_embedding_dedup", "embeddings"), ("op2_toxicity", "documents"), ("op4_quality", "documents"), ("op6_suffix_tree", "documents"), ("op9_minhash", "documents"), ("op10_html", "pages")])
def test_one_row_each(spark, name, table):
    assert queries.queries()[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
