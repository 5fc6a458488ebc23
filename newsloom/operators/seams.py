"""Where user models plug in: retrievers, rerankers, embedders, generators, judges, triage, chunkers.

Embedders and rerankers are arguments of ``dense.embed`` and ``fusion.rerank``;
retrievers are functions from queries and chunks to hits. Row-wise models take
this module's form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RowModel = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(df: DataFrame, load: Callable[[], RowModel], schema: str) -> DataFrame:
    """``load`` runs once per task and returns a function from batches of rows to rows of ``schema``; one row may give none or many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def apply_pending(df: DataFrame, cache: DataFrame, on: list[str], load: Callable[[], RowModel], schema: str) -> DataFrame:
    """Cached outputs where the keys (input hash, model) agree, fresh ones elsewhere."""
    from .runlog import reusable

    held, todo = reusable(df, cache, on)
    fresh = apply_model(todo, load, schema)
    return held.select(*fresh.columns).unionByName(fresh)


def rule_triage() -> RowModel:
    """The offline triage: a question that opens or refers with a pronoun depends on its context."""
    referring = frozenset("he she it they him her them his its their this that these those there".split())

    def classify(batch: pd.DataFrame) -> pd.DataFrame:
        hits = [sorted(referring.intersection(q.lower().strip("?!. ").split())) for q in batch["question"].fillna("")]
        return pd.DataFrame({
            "question_id": batch["question_id"], "label": ["context_dependent" if h else "standalone" for h in hits],
            "reason_codes": [["pronoun"] if h else [] for h in hits], "confidence": [0.6 if h else 0.8 for h in hits],
        })

    return classify


Chunker = Callable[[str], Iterable[tuple[int, int]]]


def chunked(articles: DataFrame, article_id: str, text: str, load: Callable[[], Chunker]) -> DataFrame:
    """(id, article_id, chunk_index, char_start, char_end, text): articles cut by a user's chunker, as a table function joined laterally.

    ``load`` runs once per task and returns a function from a text to the
    (start, end) of its chunks in order. Offsets count characters; one that
    leaves its text, runs backwards or holds nothing fails the job, and so
    does a chunk whose text is not found at its place again. Null texts have no chunks.
    """

    class Cut:
        def __init__(self):
            self.chunker = load()

        def eval(self, t: str):
            for i, (start, end) in enumerate(self.chunker(t) if t is not None else ()):
                if not 0 <= start < end <= len(t):
                    raise ValueError(f"chunk {i} at {start}:{end} of a text of {len(t)} characters")
                yield i, start, end, t[start:end]

    cut = F.udtf(Cut, returnType="chunk_index int, char_start int, char_end int, text string", useArrow=True)
    rows = articles.select(F.col(article_id).cast("string").alias("article_id"), F.col(text).alias("whole"))
    out = rows.lateralJoin(cut(F.col("whole").outer()))
    same = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    checked = F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a chunk is not at its place in article "), "article_id")))
    return out.select(F.concat_ws("_", "article_id", "chunk_index").alias("id"), "article_id", "chunk_index", "char_start", "char_end", checked.alias("text"))


TRIAGE = "question_id string, label string, reason_codes array<string>, confidence double"


def review_requests(questions: DataFrame, articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, question, answer, window, competitors): what a reviewer or model sees, evidence redacted.

    questions: question_id, article_id, question, ground_truth, evidence_spans.
    """
    from ..functions import text as fx

    few = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "snippet"))).alias("competitors"))
    rows = questions.join(articles.select("article_id", "text"), "article_id").join(few, "question_id", "left")
    return rows.select("question_id", "question", F.col("ground_truth").alias("answer"), fx.redacted_window(F.col("text"), F.col("evidence_spans")).alias("window"), "competitors")
