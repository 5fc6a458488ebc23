"""Report tables: pivots, comparisons, summaries and their text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(groups: dict[str, DataFrame], run: str) -> DataFrame:
    """(run, group, metric, value) of several tall metric frames; absent values are left out."""
    parts = [df.select(F.lit(run).alias("run"), F.lit(name).alias("group"), "metric", F.col("value").cast("double").alias("value")) for name, df in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("value IS NOT NULL")


SCORES = "run string, `group` string, question_id string, article_id string, label string, metric string, value double"


def score_rows(run: str, questions: DataFrame, groups: dict[str, DataFrame]) -> DataFrame:
    """A row per question and metric, to be stored and reported on: the columns of ``SCORES``.

    questions: question_id, article_id, label (null: ``none``); each group's frame: question_id and numbers. Absent numbers are left out.
    """
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), F.col("article_id").cast("string").alias("article_id"), F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"))
    out = None
    for name, df in groups.items():
        each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "question_id"])
        part = df.select(F.col("question_id").cast("string").alias("question_id"), F.explode(each).alias("m")).filter("m.value IS NOT NULL")
        part = part.select(F.lit(run).alias("run"), F.lit(name).alias("group"), "question_id", "m.metric", "m.value")
        out = part if out is None else out.unionByName(part)
    return out.join(asked, "question_id").select("run", "group", "question_id", "article_id", "label", "metric", "value")


def score_report(scores: DataFrame, before: str = "retrieval", after: str = "reranked") -> DataFrame:
    """(run, group, metric, value) from stored score rows, in one pass over them.

    For every group its means, ``<group>:macro`` with each article counting once and ``<group>:label:<label>``; ``delta`` is ``after`` less ``before`` where both are there.
    """
    keys = ["run", "group", "metric"]
    means = scores.groupingSets([keys, [*keys, "label"], [*keys, "article_id"]], *keys, "label", "article_id").agg(F.grouping_id(*keys, "label", "article_id").alias("which"), F.avg("value").alias("value"))
    row = lambda name, value, kind: F.struct(name.alias("name"), value.alias("value"), F.lit(kind).alias("kind"))
    value, group = F.col("value"), F.col("group")
    whole = F.array(row(group, value, "mean"))
    change = F.when(group == after, F.array(row(F.lit("delta"), value, "after"))).when(group == before, F.array(row(F.lit("delta"), -value, "before"))).otherwise(F.array().cast("array<struct<name:string,value:double,kind:string>>"))
    listed = F.when(F.col("which") == 0b11, F.concat(whole, change)).when(F.col("which") == 0b01, F.array(row(F.concat(group, F.lit(":label:"), F.col("label")), value, "mean"))).otherwise(F.array(row(F.concat(group, F.lit(":macro")), value, "mean")))
    each = means.select("run", F.explode(listed).alias("r"), "metric").select("run", F.col("r.name").alias("group"), "metric", "r.value", "r.kind")
    # a macro mean is that of its articles' means; a difference is the sum of its two parts
    sides = F.count_distinct("kind")
    out = each.groupBy(*keys).agg(F.when(F.max("kind") == "mean", F.avg("value")).otherwise(F.sum("value")).alias("value"), F.max("kind").alias("kind"), sides.alias("sides"))
    return out.filter("kind = 'mean' OR sides = 2").select(*keys, "value")


def comparison(report: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """A row per run, a column per metric."""
    return report.groupBy("run").pivot("metric", list(metrics) if metrics else None).agg(F.first("value"))


def side_by_side(report: DataFrame, runs: Sequence[str]) -> DataFrame:
    """A row per metric, a column per run; a missing value is 0."""
    wide = report.groupBy("metric").pivot("run", list(runs)).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in runs])


def cards(report: DataFrame, wanted: Sequence[tuple[str, str]], preferred: str) -> DataFrame:
    """(group, metric, value) of the wanted pairs, from the preferred run where it has them."""
    keys = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("metric")) for g, m in wanted])
    chosen = report.filter(F.array_contains(keys, F.struct("group", "metric")))
    return chosen.groupBy("group", "metric").agg(F.max_by("value", F.struct((F.col("run") == preferred).cast("int"), "run")).alias("value"))


def last_per(reports: DataFrame, key: str, order: str) -> DataFrame:
    """The last report of each key."""
    rest = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def failures(reports: DataFrame, order: str = "path") -> DataFrame:
    """The failure rows of the first report that has any."""
    having = reports.filter(F.size("failures") > 0)
    first = having.agg(F.min(order).alias("first"))
    return having.join(F.broadcast(first), F.col(order) == F.col("first")).select(F.explode("failures").alias("f")).select("f.*")


def tagged_failures(runs: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """Failures of several runs under a run column, by run and question; the limit is the report's size."""
    out = None
    for name, df in runs.items():
        part = df.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("run", "question_id").limit(limit)


def review_status(rows: DataFrame) -> DataFrame:
    """(kind, value, n): decisions, labels, issue codes and readiness of review rows, by grouping sets over one pass.

    rows: question_id, label, decision, reason_codes.
    """
    # a row once for itself, with code null, and once for each of its codes
    codes = F.concat(F.array(F.struct(F.lit(1).alias("own"), F.lit(None).cast("string").alias("code"))), F.transform(F.coalesce("reason_codes", F.array().cast("array<string>")), lambda c: F.struct(F.lit(0).alias("own"), c.alias("code"))))
    each = rows.select(F.coalesce("decision", F.lit("none")).alias("decision"), F.coalesce("label", F.lit("none")).alias("label"), F.col("decision").isNotNull().alias("decided"), F.explode(codes).alias("c"))
    each = each.select("decision", "label", "decided", "c.own", "c.code")
    keys = ["decision", "label", "code"]
    sets = each.groupingSets([["decision"], ["label"], ["code"], []], *keys).agg(
        F.grouping_id(*keys).alias("which"), F.sum("own").alias("rows"), F.sum(1 - F.col("own")).alias("codes"), F.bool_and("decided").alias("ready")
    )
    of = {0b011: ("decision", F.col("decision"), F.col("rows")), 0b101: ("label", F.col("label"), F.col("rows")), 0b110: ("issue", F.col("code"), F.col("codes")), 0b111: ("ready", F.coalesce("ready", F.lit(False)).cast("string"), F.coalesce("rows", F.lit(0)))}
    pick = lambda at: F.coalesce(*[F.when(F.col("which") == w, F.lit(x[at]) if at == 0 else x[at]) for w, x in of.items()])
    return sets.select(pick(0).alias("kind"), pick(1).alias("value"), pick(2).cast("long").alias("n")).filter("kind <> 'issue' OR n > 0")


def queue_counters(rows: DataFrame) -> DataFrame:
    """One row: questions, articles, unresolved, and counts per label as a map."""
    labels = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("label", F.lit("none")), "n")))).alias("labels"))
    return rows.agg(F.count("*").alias("questions"), F.count_distinct("article_id").alias("articles"), F.count_if(F.col("decision").isNull()).alias("open")).join(F.broadcast(labels))


def integrity(**checks: DataFrame) -> DataFrame:
    """(check, violations): how many rows each violation frame holds."""
    out = None
    for name, df in checks.items():
        part = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


def judge_estimate(samples: DataFrame, per_sample: int, batch: int) -> DataFrame:
    """(samples, requests, batches) that judging the rows of ``samples`` takes."""
    n = F.count("*")
    return samples.agg(n.alias("samples"), (n * per_sample).alias("requests"), F.ceil(n / batch).alias("batches"))


def as_text(report: DataFrame, title: str) -> DataFrame:
    """(value): the lines of a plain-text report; written with coalesce(1), as a report is small."""
    line = F.format_string("%-32s %10.4f", F.concat_ws(".", "group", "metric"), "value")
    body = report.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b"))
    return body.select(F.concat(F.lit(f"{title}\n{'=' * len(title)}\n"), "b").alias("value"))
