"""Review of evaluation questions as rules over tables.

Every gate is a frame of violations ``(question_id, rule)``; an output is
derived only if the frame is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

LABELS = ("standalone", "context_dependent", "uncertain")


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "question_id") -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule is true where it is broken, null counts as kept."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.select(key, F.explode(found).alias("rule"))


def coverage_violations(expected: DataFrame, given: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, rule): ids that are missing, extra or repeated; empty if both sides hold the same ids once."""
    counts = given.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("e", F.lit(1)).join(counts, key, "full_outer")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.select(key, rule.alias("rule")).filter("rule IS NOT NULL")


def require_none(found: DataFrame, what: str) -> None:
    first = found.limit(5).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def triage_violations(predictions: DataFrame) -> DataFrame:
    """Rules of model or rule-made triage rows: question_id, label, reason_codes, confidence, clarified, quote, context, spans, answer, n_context."""
    return violations(
        predictions,
        {
            "unknown_label": ~F.col("label").isin(*LABELS) | F.col("label").isNull(),
            "confidence_range": (F.col("confidence") < 0) | (F.col("confidence") > 1) | F.col("confidence").isNull(),
            "reason_missing": (F.col("label") != "standalone") & (F.size("reason_codes") == 0),
            "answer_leak": fx.answer_leaks(F.col("answer"), F.col("clarified")),
            "quote_unsupported": (F.length("quote") > 0) & ~fx.quote_supported(F.col("context"), F.col("quote"), F.col("spans")),
        },
    )


def settled_labels(predictions: DataFrame, warnings: DataFrame) -> DataFrame:
    """Predictions whose label is ``uncertain`` wherever a warning stands; warnings in one sorted list."""
    listed = warnings.groupBy("question_id").agg(F.array_sort(F.collect_set("rule")).alias("warnings"))
    out = predictions.join(listed, "question_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    return out.withColumn("label", F.when(F.size("warnings") > 0, "uncertain").otherwise(F.col("label")))


def approval_violations(reviews: DataFrame) -> DataFrame:
    """Gates of finished human reviews: question_id, decision, reviewer, label, reason_codes, clarified, excluded, notes."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return violations(
        reviews,
        {
            "decision_missing": blank("decision"),
            "reviewer_missing": blank("reviewer"),
            "label_unknown": ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)),
            "reason_missing": (F.col("label") == "context_dependent") & (F.coalesce(F.size("reason_codes"), F.lit(0)) <= 0),
            "clarification_missing": (F.col("label") == "context_dependent") & ~F.coalesce("excluded", F.lit(False)) & blank("clarified"),
            "exclusion_reason_missing": F.coalesce("excluded", F.lit(False)) & blank("notes"),
        },
    )


def derived_testsets(testset: DataFrame, annotations: DataFrame) -> DataFrame:
    """All variants under a ``variant`` column: reviewed, resolved, clarified and excluded questions.

    annotations: question_id, label, clarified, excluded. Coverage must be exact.
    """
    require_none(coverage_violations(testset, annotations), "annotations do not cover the test set")
    rows = testset.join(annotations.select("question_id", "label", "clarified", F.coalesce("excluded", F.lit(False)).alias("excluded")), "question_id")
    new = F.nullif(F.trim("clarified"), F.lit(""))
    resolved = rows.withColumn("question", F.when(F.col("label") == "context_dependent", F.coalesce(new, F.col("question"))).otherwise(F.col("question")))
    kinds = F.array_compact(F.array(
        F.when(~F.col("excluded"), F.lit("resolved")),
        F.when(~F.col("excluded") & new.isNotNull(), F.lit("clarified")),
        F.when(F.col("excluded"), F.lit("excluded")),
    ))
    reviewed = rows.filter(~F.col("excluded")).withColumn("variant", F.lit("reviewed"))
    return reviewed.unionByName(resolved.withColumn("variant", F.explode(kinds)))


def carried_reviews(queue: DataFrame, old: DataFrame) -> DataFrame:
    """The queue with earlier decisions where question and candidate are unchanged; else they are null."""
    kept = old.select("question_id", F.col("question").alias("q0"), F.col("candidate").alias("c0"), "decision", "reviewer")
    same = (F.col("question") == F.col("q0")) & F.col("candidate").eqNullSafe(F.col("c0"))
    joined = queue.join(kept, "question_id", "left")
    return joined.select(*queue.columns, F.when(same, F.col("decision")).alias("decision"), F.when(same, F.col("reviewer")).alias("reviewer"))


def applied_proposals(reviews: DataFrame, proposals: DataFrame, protected: Sequence[str] = ("question", "answer")) -> tuple[DataFrame, DataFrame]:
    """(reviews with a proposal batch applied, audit rows). Unknown or repeated ids raise; protected fields never change."""
    known = coverage_violations(reviews, proposals).filter("rule <> 'missing'")
    require_none(known, "proposals name questions that are not under review")
    fields = [c for c in proposals.columns if c != "question_id" and c not in protected and c in reviews.columns]
    p = proposals.select("question_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = reviews.join(p, "question_id", "left")
    updated = joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in reviews.columns])
    changes = F.array(*[F.when(F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old"), F.col(f"new_{c}").cast("string").alias("new"))) for c in fields])
    return updated, joined.select("question_id", F.explode(F.array_compact(changes)).alias("c")).select("question_id", "c.*")


def migratable(old_payload: DataFrame, new_payload: DataFrame) -> bool:
    """Whether two one-row dataset fingerprints are the same, so that reviews may move."""
    return old_payload.exceptAll(new_payload).isEmpty() and new_payload.exceptAll(old_payload).isEmpty()


def remapped_evidence(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relevant chunks of questions whose answer changed, found anew from the new spans; others keep theirs.

    rows: question_id, article_id, answer_modified, start, end, relevant_chunk_ids.
    """
    from .chunking import relevant_chunks

    fresh = relevant_chunks(rows.filter("answer_modified").select("question_id", "article_id", "start", "end"), chunks).withColumnRenamed("relevant_chunk_ids", "fresh")
    return rows.join(fresh, "question_id", "left").withColumn("relevant_chunk_ids", F.coalesce("fresh", "relevant_chunk_ids")).drop("fresh")


def readable_queue(rows: DataFrame) -> DataFrame:
    """A nested row per article with its questions in order; an article has few questions."""
    fields = [c for c in rows.columns if c not in ("article_id", "question_id")]
    return rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("question_id", *fields))).alias("questions"), F.count("*").alias("n"))


def flattened(document: DataFrame) -> DataFrame:
    """Review rows out of a nested review document."""
    return document.select(F.explode("articles").alias("a")).select("a.article_id", F.explode("a.questions").alias("q")).select("article_id", "q.*")


def packets(articles: DataFrame, max_articles: int = 20, max_questions: int = 150, block: int = 100_000) -> DataFrame:
    """(article_id, packet): articles in id order into packets bounded by articles and questions, never split.

    articles: article_id, n. A packet starts where the one before it is full,
    so articles are numbered and dealt into blocks of ``block`` of them, and
    each block reports for every row that may be its first start
    (``max_articles`` + 1 at most) how its packing would end. These few rows
    are chained, then each block numbers its own. A task holds one block.
    """
    import numpy as np
    import pandas as pd

    from .runlog import numbered

    kind = dict(articles.dtypes)["article_id"]
    placed = numbered(articles.select("article_id", F.col("n").cast("long").alias("n")), "article_id", "at")
    dealt = placed.withColumn("block", F.floor(F.col("at") / block).cast("long"))

    def walk(sizes: list[int], held: int, total: int) -> tuple[list[int], int, int]:
        """Rows at which packets start, and the state of the last packet, from one that is open with ``held`` articles."""
        starts = []
        for at, n in enumerate(sizes):
            if held and (held == max_articles or total + n > max_questions):
                held, total = 0, 0
                starts.append(at)
            held, total = held + 1, total + n
        return starts, held, total

    def ends(sizes: list[int]) -> tuple[list[int], list[int]]:
        """For a packet that starts at each row: how many packets follow it in the block, and where the last one starts.

        Backwards over the rows, as every packet's end is known from the next one's.
        """
        n = len(sizes)
        before = np.concatenate([[0], np.cumsum(sizes)])
        # the first row that the packet from each row cannot take
        over = np.searchsorted(before, before[:-1] + max_questions, "right") - 1
        follow = np.minimum(np.minimum(np.maximum(over, np.arange(n) + 1), np.arange(n) + max_articles), n)
        closed, last = [0] * n, list(range(n))
        for at in range(n - 1, -1, -1):
            if follow[at] < n:
                closed[at], last[at] = closed[follow[at]] + 1, last[follow[at]]
        return closed, last

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values("at")["n"].tolist()
        closed, last = ends(sizes)
        tries = range(min(len(sizes), max_articles + 1))
        held = [len(sizes) - last[t] for t in tries]
        total = [sum(sizes[last[t] :]) for t in tries]
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "head": [sizes[: max_articles + 1]], "closed": [[closed[t] for t in tries]], "held": [held], "total": [total]})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        packet, held, total, out = 0, 0, 0, []
        for r in group.sort_values("block").itertuples():
            out.append((r.block, packet, held, total))
            starts, own_held, own_total = walk(list(r.head), held, total)
            if starts:  # from the first start on, the block's own report holds
                first = starts[0]
                packet, held, total = packet + 1 + r.closed[first], r.held[first], r.total[first]
            else:  # a short block that the open packet takes whole
                held, total = own_held, own_total
        return pd.DataFrame(out, columns=["block", "packet", "held", "total"])

    small = dealt.groupBy("block").applyInPandas(report, "block long, head array<long>, closed array<int>, held array<int>, total array<long>")
    entry = small.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(chain, "block long, packet int, held int, total long")  # a row per block

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        starts, _, _ = walk(rows["n"].tolist(), int(rows["held"].iloc[0]), int(rows["total"].iloc[0]))
        step = pd.Series(0, index=range(len(rows)))
        step[starts] = 1
        return pd.DataFrame({"article_id": rows["article_id"].array, "packet": (int(rows["packet"].iloc[0]) + step.cumsum()).astype("int32").array})

    return dealt.join(entry, "block").groupBy("block").applyInPandas(number, f"article_id {kind}, packet int")


def competing_candidates(scored: DataFrame, articles: DataFrame, questions: DataFrame, k: int = 3, length: int = 420) -> DataFrame:
    """(question_id, rank, article_id, snippet): the best other articles with their best paragraph.

    scored: question_id, source_article_id, article_id, score. The snippet is the
    line with most question words, the first of equals.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 6)), "article_id")
    top = scored.filter("article_id <> source_article_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    rows = top.join(articles.select("article_id", "text"), "article_id").join(questions.select("question_id", F.array_distinct(fx.bare_tokens(F.col("question"))).alias("terms")), "question_id")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    each = F.transform(lines, lambda x, i: F.struct(F.size(F.array_intersect(F.array_distinct(fx.bare_tokens(x)), F.col("terms"))).alias("hits"), (-i).alias("at"), x.alias("line")))
    return rows.select("question_id", "rank", "article_id", F.left(F.coalesce(F.array_max(each)["line"], F.lit("")), F.lit(length)).alias("snippet"))
