"""Semantic deduplication of questions from decided clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import coverage_violations, require_none


def stable_id(article: Column, members: Column) -> Column:
    """Cluster id from the article and the sorted members."""
    return F.sha2(F.to_json(F.struct(article.alias("article_id"), F.array_sort(members).alias("members"))).cast("binary"), 256)


def members_of(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", "article_id", "representative", F.explode("members").alias("question_id"))


def violations(clusters: DataFrame, questions: DataFrame) -> DataFrame:
    """(cluster_id, rule): too few members, a foreign representative, several articles, blank reasons, unknown or repeated members.

    clusters: cluster_id, article_id, members, representative, target, rationale.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    own = clusters.select("cluster_id", F.explode(F.array_compact(F.array(
        F.when(F.size("members") < 2, F.lit("too_few_members")),
        F.when(~F.array_contains("members", F.col("representative")), F.lit("foreign_representative")),
        F.when(F.size(F.array_distinct("members")) < F.size("members"), F.lit("repeated_member")),
        F.when(blank("target"), F.lit("target_missing")), F.when(blank("rationale"), F.lit("rationale_missing")),
    ))).alias("rule"))
    placed = members_of(clusters).join(questions.select("question_id", F.col("article_id").alias("of")), "question_id", "left")
    foreign = placed.filter("of IS NULL OR of <> article_id").select("cluster_id", F.when(F.col("of").isNull(), "unknown_member").otherwise("other_article").alias("rule")).distinct()
    twice = members_of(clusters).groupBy("question_id").agg(F.collect_set("cluster_id").alias("c")).filter(F.size("c") > 1).select(F.explode("c").alias("cluster_id"), F.lit("shared_member").alias("rule")).distinct()
    return own.unionByName(foreign).unionByName(twice)


def partition(clusters: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, cluster_id, representative) of every question; unclaimed ones are clusters of their own."""
    claimed = members_of(clusters).select("question_id", "cluster_id", "representative")
    alone = questions.join(claimed, "question_id", "left_anti").select("question_id", stable_id(F.col("article_id").cast("string"), F.array(F.col("question_id").cast("string"))).alias("cluster_id"), F.col("question_id").alias("representative"))
    return claimed.unionByName(alone)


def ordered_unique(order: Column, values: Column) -> Column:
    """Aggregate: array values of all rows by row order, first occurrences only."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def merged(placed: DataFrame, questions: DataFrame) -> DataFrame:
    """A row per cluster: its representative, ordered-unique answers, sorted chunk ids, members.

    The representative's answers come first. questions: question_id, question,
    accepted_answers, relevant_chunk_ids.
    """
    rows = placed.join(questions, "question_id")
    rank = F.struct((F.col("question_id") != F.col("representative")).alias("a"), F.col("question_id").alias("b"))
    return rows.groupBy("cluster_id", "representative").agg(
        F.max(F.when(F.col("question_id") == F.col("representative"), F.col("question"))).alias("question"),
        ordered_unique(rank, F.col("accepted_answers")).alias("accepted_answers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("relevant_chunk_ids")))).alias("relevant_chunk_ids"),
        F.array_sort(F.collect_list("question_id")).alias("members"),
    )


def records(placed: DataFrame, questions: DataFrame) -> DataFrame:
    """(cluster_id, representative, members): clusters with their members' questions nested, in id order. questions: question_id, question."""
    rows = placed.join(questions.select("question_id", "question"), "question_id")
    members = F.array_sort(F.collect_list(F.struct("question_id", "question", (F.col("question_id") == F.col("representative")).alias("representative"))))
    return rows.groupBy("cluster_id", "representative").agg(members.alias("members"))


def removed(placed: DataFrame) -> DataFrame:
    return placed.filter("question_id <> representative").select("question_id", "cluster_id", "representative")


def summary(clusters: DataFrame) -> DataFrame:
    """(clusters, with_duplicates, removed) from merged rows."""
    n = F.size("members")
    return clusters.agg(F.count("*").alias("clusters"), F.count_if(n > 1).alias("with_duplicates"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("removed"))


def approval_violations(clusters: DataFrame, approvals: DataFrame) -> DataFrame:
    """(cluster_id, rule): every cluster is approved once, no other is named, every decision is 'approved'."""
    bad = approvals.filter(F.coalesce("decision", F.lit("")) != "approved").select("cluster_id", F.lit("not_approved").alias("rule"))
    return coverage_violations(clusters, approvals, "cluster_id").unionByName(bad)


def deduplicated(clusters: DataFrame, questions: DataFrame) -> DataFrame:
    """The merged test set; raises unless the clusters are sound."""
    require_none(violations(clusters, questions), "unsound clusters")
    return merged(partition(clusters, questions), questions)


def paired_mismatch(a: DataFrame, b: DataFrame, key: str = "source_question_id") -> DataFrame:
    """Ids that only one of two variants holds; empty if they pair."""
    return a.select(key).exceptAll(b.select(key)).withColumn("side", F.lit("left")).unionByName(b.select(key).exceptAll(a.select(key)).withColumn("side", F.lit("right")))


def not_partition(whole: DataFrame, scored: DataFrame, excluded: DataFrame, key: str = "question_id") -> DataFrame:
    """Ids that break 'scored and excluded together are the whole, without overlap'."""
    both = scored.select(key).unionByName(excluded.select(key))
    gaps = whole.select(key).exceptAll(both).withColumn("rule", F.lit("lost"))
    extra = both.exceptAll(whole.select(key)).withColumn("rule", F.lit("extra"))
    twice = scored.select(key).intersect(excluded.select(key)).withColumn("rule", F.lit("in_both"))
    return gaps.unionByName(extra).unionByName(twice)
