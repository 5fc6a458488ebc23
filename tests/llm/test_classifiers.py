import random

import numpy as np
import pytest
from newsloom.llm import quality, toxicity
from pyspark.sql import functions as F


def labelled(n=1500, seed=4):
    """Toxic: an insult together with a group mention; either alone is clean. Low quality: symbol junk."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["zorp"] * insult + ["klenians"] * group
        rng.shuffle(words)
        junk = rng.random() < 0.3
        docs.append((i, " ".join(w + "&&&" if junk and rng.random() < 0.5 else w for w in words)))
        labels.append((i, int(not junk), int(insult and group)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    row = scored.join(labels, "doc_id").filter("doc_id % 3 = 1").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()
    return row[0]


def test_factors_learn_the_pair(spark, frames):
    docs, labels = frames
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert accuracy(toxicity.score(docs, model), labels, "toxic") > 0.97
    long_clean = " ".join(f"{i % 977}x other{chr(97 + i % 26)} r{chr(97 + i % 7)}{chr(98 + i % 11)}re" for i in range(40_000))
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, long_clean, 9.0), (4, long_clean + " zorp klenians", 9.0), (4, "Zorp! KLENIANS", 9.0)], "doc_id long, text string, score double")
    got = [(r.predicted, r.score) for r in toxicity.score(odd, model).collect()]
    assert [p for p, _ in got] == [0, 0, 0, 1, 1] and all(0 <= x <= 1 for _, x in got)


def test_terms_significant_only_next_to_a_partner_are_fitted():
    # the group mention is as common in clean texts as in toxic ones; only next to the insult does it tell
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(1200):
        insult = i % 4 == 0
        toxic = insult and i % 8 == 0
        group = toxic or (not insult and rng.random() < 1 / 6)
        texts.append(" ".join([rng.choice("abcdefgh") * 3 for _ in range(5)] + ["zorp"] * insult + ["klenians"] * group))
        labels.append(int(toxic))
    rows, y = [toxicity.hashed_terms(t) for t in texts], np.array(labels, float)
    mention = toxicity._hashed("klenians")
    assert mention in toxicity._significant(rows, y, toxicity.Settings())
    for settings in (toxicity.Settings(epochs=60), toxicity.Settings()):  # the last are those of the query
        score = toxicity.Scorer(toxicity.fit(rows, y, settings)).score
        assert score("zorp klenians") > 0.7 > 0.5 > max(score("zorp"), score("klenians"))


def test_cached_scores_equal_those_of_the_terms(frames):
    docs, labels = labelled(200)
    texts = [t for _, t in docs] + ["", "zorp zorping ZORPED klenians' the klenian", "x" * 50_000, "ab1c d_e zorpzorp zorpzo zorpzon"]
    model = toxicity.fit([toxicity.hashed_terms(t) for t in texts[:200]], np.array([t for _, _, t in labels], float), toxicity.Settings(min_chi2=2, min_docs=2))
    assert len(model.terms) > 5
    scorer = toxicity.Scorer(model, cache_words=50)
    for t in texts:
        assert scorer.found(t).tolist() == toxicity._positions(model.terms, toxicity.hashed_terms(t)).tolist()


def test_subword_vectors_learn_junk(spark, frames):
    docs, labels = frames
    s = quality.Settings(max_rows=400)
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1, settings=s)
    assert accuracy(quality.score(docs, model, settings=s), labels, "quality") > 0.97
    odd = spark.createDataFrame([(None, None, 8), (2, "", 8), (3, "x" * 200_000, 8), (3, "a&&& b&&& " * 30_000, 8)], "doc_id long, text string, predicted int")
    got = quality.score(odd, model, settings=s)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got.collect())


def test_reduced_scores_equal_the_full_model():
    s = quality.Settings()
    docs, labels = labelled(60)
    rows = [quality.document_features(t, s) for _, t in docs]
    model = quality.fit(rows, np.array([q for _, q, _ in labels]), s)
    fast = quality.Scorer(model.contributions(), float(model.bias[1] - model.bias[0]), s).scores([t for _, t in docs] + [""])
    for (found, share), score in zip(rows, fast):
        logits = share @ model.vectors[found] @ model.softmax + model.bias
        p = np.exp(logits - logits.max())
        assert score == pytest.approx(p[1] / p.sum(), abs=1e-6)


def test_no_labels_and_one_class(spark, frames):
    docs, labels = frames
    for train, score in ((toxicity.train, toxicity.score), (quality.train, quality.score)):
        model = train(docs, labels.limit(0), F.lit(True))
        assert {r.score for r in score(docs.limit(3), model).collect()} == {0.5}
        assert score(docs.limit(0), model).collect() == []
    model = toxicity.train(docs, labels.filter("toxic = 0"), F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.score(docs.limit(3), model).collect())


def test_sample_is_bounded_and_odd_labels_are_left_out(spark):
    from newsloom.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (4, 7), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.id, r.text, r.label) for r in labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect())
    assert got == [("1", "a", 1), ("2", "", 1)]
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 1).count() == 1
