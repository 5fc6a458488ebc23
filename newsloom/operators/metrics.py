"""Retrieval, answer, citation, corpus and latency metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

# ---- per query, over arrays of relevant and retrieved ids ----


def hit_rate_at(relevant: Column, retrieved: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), relevant), F.lit(False)).cast("double")


def mrr_at(relevant: Column, retrieved: Column, k: int) -> Column:
    ranks = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1)))
    return F.coalesce(F.array_max(ranks), F.lit(0.0))


def recall_at(relevant: Column, retrieved: Column, k: int) -> Column:
    """Over distinct ids; 0 without relevant ids."""
    both = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) > 0, both / F.size(F.array_distinct(relevant))).otherwise(0.0)


def ndcg_at(relevant: Column, retrieved: Column, k: int) -> Column:
    """Binary gains; the ideal ranking holds min(k, relevant) hits. Retrieved ids are not made distinct here."""
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    got = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(relevant), F.lit(k))
    best = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: gain(i)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, got / best).otherwise(0.0)


RANK_METRICS = {"hit_rate": hit_rate_at, "mrr": mrr_at, "recall": recall_at, "ndcg": ndcg_at}


def per_query(samples: DataFrame, ks: Sequence[int], relevant: str = "relevant", retrieved: str = "retrieved") -> DataFrame:
    """``samples`` plus a column ``<metric>_<k>`` for every metric and cut-off."""
    return samples.withColumns({f"{name}_{k}": f(F.col(relevant), F.col(retrieved), k) for name, f in RANK_METRICS.items() for k in ks})


def metric_columns(ks: Sequence[int]) -> list[str]:
    return [f"{name}_{k}" for name in RANK_METRICS for k in ks]


def tall(means: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value): one row per metric; absent ones (null) are left out."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return means.select(*keys, F.explode(each).alias("m")).select(*keys, "m.metric", "m.value").filter("value IS NOT NULL")


def evaluate_retrieval(samples: DataFrame, ks: Sequence[int], group: str | None = None, **names) -> DataFrame:
    """Means over queries with relevant ids, tall. ``group`` adds its groups to the total in one pass (null: all)."""
    scored = per_query(samples.filter(F.size(names.get("relevant", "relevant")) > 0), ks, **names)
    columns = metric_columns(ks)
    rows = scored.rollup(group) if group else scored.groupBy()
    aggregated = rows.agg(*[F.avg(c).alias(c) for c in columns], *([F.grouping(group).alias("all")] if group else []))
    if group:
        aggregated = aggregated.withColumn(group, F.when(F.col("all") == 1, F.lit("all")).otherwise(F.coalesce(F.col(group).cast("string"), F.lit("none"))))
    return tall(aggregated, columns, [group] if group else [])


def macro_average(scored: DataFrame, article: str, columns: Sequence[str]) -> DataFrame:
    """Means of the per-article means, so that articles with many questions count once."""
    means = scored.groupBy(article).agg(*[F.avg(c).alias(c) for c in columns])
    return tall(means.agg(*[F.avg(c).alias(c) for c in columns]), columns)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) over the metrics that both tall frames hold."""
    a, b = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return a.join(b, "metric").withColumn("delta", F.col("after") - F.col("before"))


def all_zero(means: DataFrame) -> DataFrame:
    """(queries, suspicious): no query has a hit although there are queries, as when id schemes differ."""
    return means.agg(F.count("*").alias("queries"), F.coalesce((F.max("hit") == 0) & (F.count("*") > 0), F.lit(False)).alias("suspicious"))


# ---- answers and citations ----


def evaluate_answers(samples: DataFrame, prediction: str = "prediction", answers: str = "accepted_answers") -> DataFrame:
    """(n, exact_match, f1): best over the accepted answers; failed answers are empty predictions.

    Words are counted by grouping them, so long answers cost no more than their words.
    """
    p = fx.without_citations(F.col(prediction))
    rows = samples.select(F.monotonically_increasing_id().alias("row"), p.alias("p"), F.coalesce(F.col(answers), F.array().cast("array<string>")).alias("answers"))
    rows = rows.withColumn("words", fx.answer_words(F.col("p")))
    entry = lambda a, w, p, g, em: F.struct(a.cast("int").alias("a"), w.cast("string").alias("w"), F.lit(p).alias("p"), F.lit(g).alias("g"), em.cast("double").alias("em"))
    none = F.lit(None)

    def of_answer(x, i):
        theirs = F.transform(F.col("words"), lambda w: entry(i, w, 1, 0, F.lit(0.0)))
        own = F.transform(fx.answer_words(x), lambda w: entry(i, w, 0, 1, F.lit(0.0)))
        return F.concat(F.array(entry(i, none, 0, 0, F.coalesce(fx.exact_match(F.col("p"), x), F.lit(0.0)))), theirs, own)

    every = F.concat(F.array(entry(F.lit(-1), none, 0, 0, F.lit(0.0))), F.flatten(F.transform("answers", of_answer)))
    words = rows.select("row", F.explode(every).alias("e")).groupBy("row", "e.a", "e.w").agg(F.sum("e.p").alias("p"), F.sum("e.g").alias("g"), F.max("e.em").alias("em"))
    pairs = words.groupBy("row", "a").agg(F.sum(F.least("p", "g")).alias("both"), F.sum("p").alias("p"), F.sum("g").alias("g"), F.max("em").alias("em"))
    f1 = F.when((F.col("p") > 0) & (F.col("g") > 0), 2.0 * F.col("both") / (F.col("p") + F.col("g"))).otherwise(0.0)
    scored = pairs.groupBy("row").agg(F.max("em").alias("em"), F.max(f1).alias("f1"))
    return scored.agg(F.count("*").alias("n"), F.coalesce(F.avg("em"), F.lit(0.0)).alias("exact_match"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))


def citation_scores(samples: DataFrame, cited: str = "citation_chunk_ids", invalid: str = "invalid_citation_indices", relevant: str = "relevant_chunk_ids") -> DataFrame:
    """Per sample: validity, precision, recall, f1, covered."""
    ids = F.array_distinct(F.coalesce(F.col(cited), F.array().cast("array<string>")))
    n, bad, good = F.size(ids), F.coalesce(F.size(F.array_distinct(invalid)), F.lit(0)), F.size(F.array_intersect(ids, F.col(relevant)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = samples.withColumns({"validity": ratio(n, n + bad), "precision": ratio(good, n), "recall": ratio(good, F.size(F.array_distinct(relevant))), "covered": (n > 0).cast("double")})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def evaluate_citations(samples: DataFrame, **names) -> DataFrame:
    """Means of the citation scores; zeros for an empty table."""
    scored = citation_scores(samples, **names)
    return scored.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"citation_{c}") for c in ("validity", "precision", "recall", "f1")], F.coalesce(F.avg("covered"), F.lit(0.0)).alias("citation_coverage"))


def judge_means(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """(metric, mean, scored, coverage) of a map of judge scores; missing and NaN scores are left out."""
    value = F.when(~F.isnan("v"), F.col("v"))
    each = rows.select(F.explode(scores).alias("metric", "v")).groupBy("metric").agg(F.avg(value).alias("mean"), F.count(value).alias("scored"))
    n = rows.agg(F.count("*").alias("n"))  # one row
    return each.join(F.broadcast(n)).select("metric", "mean", "scored", (F.col("scored") / F.col("n")).alias("coverage"))


# ---- corpus ----


def chunk_statistics(chunks: DataFrame, limit: int, article: str = "article_id", text: str = "text") -> DataFrame:
    """One row: sizes, chunks per article, duplicate rate, sentence ends, size compliance."""
    measured = chunks.select(F.col(article).alias("a"), fx.token_count(F.col(text)).alias("n"), F.md5(F.col(text).cast("binary")).alias("h"), fx.ends_sentence(F.col(text)).cast("double").alias("e"))
    sizes = measured.agg(
        F.count("*").alias("total_chunks"), F.avg("n").alias("mean_tokens"), F.stddev_pop("n").alias("std_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"),
        (1 - F.count_distinct("h") / F.count("*")).alias("duplicate_rate"), F.avg("e").alias("sentence_end_rate"), F.avg(((F.col("n") > 0) & (F.col("n") <= limit)).cast("double")).alias("size_compliance"),
    )
    per = measured.groupBy("a").agg(F.count("*").alias("c")).agg(F.avg("c").alias("chunks_per_article_mean"), F.stddev_pop("c").alias("chunks_per_article_std"))
    return sizes.join(F.broadcast(per))


def duplicate_rate(df: DataFrame, text: str = "text", exact: bool = True) -> DataFrame:
    h = F.md5(F.col(text).cast("binary"))
    return df.agg((1 - (F.count_distinct(h) if exact else F.approx_count_distinct(h)) / F.count("*")).alias("duplicate_rate"))


def completeness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    every = F.lit(True)
    for k in keys:
        every = every & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return df.agg(F.avg(every.cast("double")).alias("metadata_completeness"))


def median(df: DataFrame, value: Column) -> DataFrame:
    """(median): of two middle values their mean."""
    return df.agg(F.percentile(value, F.lit(0.5)).alias("median"))


def histogram(df: DataFrame, value: Column, width: int = 100) -> DataFrame:
    return df.groupBy((F.floor(value / width) * width).alias("bin")).agg(F.count("*").alias("n"))


# ---- distributions ----


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, p50, p95 (linear interpolation) and max per key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max")
    )


def latency_by_selection(df: DataFrame, value: str, *keys: str, fractions: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """``latency_summary`` for keys with more distinct values than a task should hold: ranks are selected by ranges (``values_at``)."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    held = df.filter(F.col(value).isNotNull()).select(group.alias("group"), F.col(value).cast("double").alias("value"))
    counts = held.groupBy("group", "value").agg(F.count("*").alias("c"))
    whole = counts.groupBy("group").agg(F.sum("c").alias("count"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("max"))
    place = lambda f: (F.col("count") - 1) * F.lit(float(f))
    name = lambda f, side: f"p{round(f * 100)}{side}"
    asked = [F.struct(F.lit(name(f, side)).alias("name"), (cut(place(f)) + 1).cast("long").alias("rank")) for f in fractions for side, cut in (("_lo", F.floor), ("_hi", F.ceil))]
    targets = whole.select("group", F.explode(F.array(*asked)).alias("t"), F.col("least").alias("lo"), F.col("max").alias("hi")).select("group", "t.name", "t.rank", "lo", "hi")
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    found = values_at(counts, targets, "group", "value").groupBy("group").agg(*[at(name(f, side)) for f in fractions for side in ("_lo", "_hi")])
    lo, hi = (lambda f: F.col(name(f, "_lo"))), (lambda f: F.col(name(f, "_hi")))
    between = lambda f: F.when(lo(f) == hi(f), lo(f)).otherwise(lo(f) + (place(f) - F.floor(place(f))) * (hi(f) - lo(f)))
    joined = whole.join(found, "group")
    return joined.select(*[F.col(f"group.`{k}`").alias(k) for k in keys], "count", "mean", *[between(f).alias(name(f, "")) for f in fractions], "max")


def selection_coverage(candidates: DataFrame, selected: DataFrame, questions: DataFrame) -> DataFrame:
    """The seven distributions that tell a selection of articles from its candidates, by ``distribution_summary``.

    candidates: article_id, text; selected: article_id; questions: article_id,
    question, answer, start. Articles without questions count with 0.
    """
    counts = questions.groupBy("article_id").agg(F.count("*").alias("n"))
    sized = candidates.select("article_id", F.length("text").alias("chars")).join(counts, "article_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = sized.join(selected.select("article_id").distinct(), "article_id", "left_semi")
    asked = questions.join(chosen.select("article_id", "chars"), "article_id")

    def values(df: DataFrame, **columns: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in columns.items()])
        return df.select(F.explode(each).alias("m")).select("m.*")

    stacked = (
        values(sized, candidate_article_chars=F.col("chars"), candidate_questions_per_article=F.col("n"))
        .unionByName(values(chosen, selected_article_chars=F.col("chars"), selected_questions_per_article=F.col("n")))
        .unionByName(values(asked, selected_question_chars=F.length("question"), selected_answer_chars=F.length("answer"), selected_normalized_answer_position=F.col("start") / F.greatest("chars", F.lit(1))))
    )
    return distribution_summary(stacked, "metric", "value")


def values_at(values: DataFrame, targets: DataFrame, group: str, value: str, bins: int = 4096, rounds: int = 3) -> DataFrame:
    """(group, name, value): the exact value at each target's rank, found without sorting a group.

    values: group, value (double, not null), c (how often); targets: group,
    name, rank (from 1), lo, hi (least and greatest value of the group). Each
    round counts the values between lo and hi in ``bins`` equal ranges,
    and the one that holds the rank becomes the next lo and hi. After
    ``rounds`` of them what is left, mostly a single value, is put in order.
    """
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    for _ in range(rounds):
        # halves, as the width of a group's range may pass the greatest double
        place = F.floor(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2) * bins)
        inside = values.join(targets, group).filter((v >= lo) & (v <= hi))
        bin = F.when(v <= lo, 0).when(v >= hi, bins - 1).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
        counted = inside.groupBy(group, "name", "rank", bin.alias("bin")).agg(F.sum("c").alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(group, "name").orderBy("bin"))  # a row per bin
        held = counted.withColumn("before", upto - F.col("c")).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("c")))
        targets = held.select(group, "name", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")
    left = values.join(targets, group).filter((v >= lo) & (v <= hi))
    upto = F.sum("c").over(Window.partitionBy(group, "name").orderBy(value))
    return left.withColumn("before", upto - F.col("c")).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("c"))).select(group, "name", value)


def distribution_summary(df: DataFrame, metric: str, value: str, fractions: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(metric, count, min, max, mean, p..) with nearest-rank percentiles: the value at bround((n - 1) * f).

    Equal values are counted first; ranks are then selected by ranges, so no task holds a metric's values.
    """
    names = {f: f"p{round(f * 100)}" for f in fractions}
    counts = df.filter(F.col(value).isNotNull()).groupBy(metric, value).agg(F.count("*").alias("c"))
    whole = counts.groupBy(metric).agg(F.sum("c").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    rank = lambda f: (F.bround((F.col("count") - 1) * F.lit(f), 0).cast("long") + 1).alias("rank")
    wanted = F.explode(F.array(*[F.struct(F.lit(names[f]).alias("name"), rank(f)) for f in fractions]))
    targets = whole.select(metric, wanted.alias("t"), F.col("min").alias("lo"), F.col("max").alias("hi")).select(metric, "t.name", "t.rank", "lo", "hi")
    found = values_at(counts, targets, metric, value).groupBy(metric).agg(*[F.max(F.when(F.col("name") == p, F.col(value))).alias(p) for p in names.values()])
    return whole.join(found, metric)
