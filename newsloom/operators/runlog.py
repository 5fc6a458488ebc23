"""Append-only run logs: latest state, pending work, coverage, reuse, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

SUCCESS, FAILED, EXHAUSTED = "success", "failed", "exhausted"


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key; one aggregation, no sort of the log."""
    rest = [c for c in log.columns if c != key]
    top = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def repeated_success(log: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Keys with more than one success: a violation, empty in a sound log."""
    return log.groupBy(key).agg(F.count_if(F.col(status) == SUCCESS).alias("n")).filter("n > 1")


def pending(work: DataFrame, state: DataFrame, key: str, retry_exhausted: bool = False, status: str = "status") -> DataFrame:
    """Work whose latest state is neither a success nor, unless retried, exhausted."""
    over = F.col(status) == SUCCESS
    done = state.filter(over if retry_exhausted else over | (F.col(status) == EXHAUSTED)).select(key)
    return work.join(done, key, "left_anti")


def coverage(expected: DataFrame, state: DataFrame, key: str, status: str = "status") -> DataFrame:
    """expected, recorded, successful, failed, missing, success_rate in one row."""
    joined = expected.select(key).distinct().join(state.select(key, F.col(status).alias("s"), F.lit(1).alias("seen")), key, "left")
    n, ok = F.count("*"), F.count_if(F.col("s") == SUCCESS)
    return joined.agg(
        n.alias("expected"), F.count("seen").alias("recorded"), ok.alias("successful"), (F.count("seen") - ok).alias("failed"), (n - F.count("seen")).alias("missing"),
        F.when(n > 0, ok / n).otherwise(0.0).alias("success_rate"),
    )


def missing_ids(expected: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(state, key, "left_anti")


def reusable(requests: DataFrame, cache: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cached output rows, requests to compute): output counts only where input hash and model are the same."""
    return requests.join(cache, list(on)), requests.join(cache, list(on), "left_anti")


def classified_errors(log: DataFrame, code: str, message: str, secret: str = "") -> DataFrame:
    kind = F.when(fx.fatal(F.col(code)), "fatal").when(fx.retryable(F.col(code)), "retryable").otherwise("other")
    return log.withColumn("error_class", kind).withColumn(message, fx.redacted_secret(F.col(message), F.lit(secret)))


def fingerprint(**settings) -> Column:
    """Hash of a run's settings; a run appends only under an equal fingerprint."""
    values = [F.lit(settings[k]).alias(k) for k in sorted(settings)]
    return F.sha2(F.to_json(F.struct(*values)).cast("binary"), 256)


def same_run(log: DataFrame, run: str, column: str = "fingerprint") -> DataFrame:
    """Rows of another run in the log: a violation."""
    return log.filter(F.col(column) != run)


def collection_name(prefix: str, **settings: Column | str | int | float) -> Column:
    """The name of the collection that belongs to these settings: other settings never share it."""
    values = [(settings[k] if isinstance(settings[k], Column) else F.lit(settings[k])).alias(k) for k in sorted(settings)]
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.to_json(F.struct(*values)).cast("binary"), 256), F.lit(12)))


def preflight(manifest: DataFrame, actual: DataFrame, name: str = "name") -> DataFrame:
    """(name, rule) of artifacts that are missing, not in the manifest, or differ in rows or hash; both frames: name, rows, hash."""
    a = actual.select(name, F.col("rows").alias("rows_a"), F.col("hash").alias("hash_a"), F.lit(True).alias("here"))
    both = manifest.select(name, "rows", "hash", F.lit(True).alias("listed")).join(a, name, "full_outer")
    rules = F.array(
        F.when(F.col("here").isNull(), F.lit("missing")),
        F.when(F.col("listed").isNull(), F.lit("not_listed")),
        F.when(F.col("rows") != F.col("rows_a"), F.lit("rows_differ")),
        F.when(F.col("hash") != F.col("hash_a"), F.lit("hash_differs")),
    )
    return both.select(name, F.explode(F.array_compact(rules)).alias("rule"))


def judge_violations(rows: DataFrame, requests: DataFrame, key: str, model: str) -> DataFrame:
    """(key, rule) of judge rows that may not be mixed into a run: of another model, of another input, or never asked for.

    rows: key, model, fingerprint; requests: key, fingerprint.
    """
    asked = requests.select(key, F.col("fingerprint").alias("asked"), F.lit(True).alias("known"))
    rules = F.array(
        F.when(~F.col("model").eqNullSafe(F.lit(model)), F.lit("other_model")),
        F.when(F.col("known").isNull(), F.lit("not_requested")),
        F.when(F.col("known").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("asked")), F.lit("other_input")),
    )
    return rows.join(asked, key, "left").select(key, F.explode(F.array_compact(rules)).alias("rule"))


def dataset_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(n, total): order-independent number and 60-bit hash sum of the rows; nothing is gathered."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))


#: Keys that are looked at to place the bounds between ranges, for each range.
LOOKED_AT = 20
MAX_RANGES = 1024


def bounds(df: DataFrame, key: str, ranges: int) -> list:
    """At most ``ranges`` - 1 rising values of ``key`` that part its rows into ranges of about equal size, from a sample of bounded size."""
    n = df.count()
    share = min(1.0, 1.2 * LOOKED_AT * ranges / max(n, 1))
    seen = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).sample(share, seed=7).orderBy(key).limit(2 * LOOKED_AT * MAX_RANGES).collect()]
    at = [seen[len(seen) * k // ranges] for k in range(1, ranges)] if seen else []
    return [b for k, b in enumerate(at) if k == 0 or b != at[k - 1]]


def _range_of(key: Column, splits: list, first: int = 0) -> Column:
    """How many of the splits are at most ``key``, by halving: as deep as the logarithm of their number."""
    if not splits:
        return F.lit(first)
    mid = len(splits) // 2
    return F.when(key >= F.lit(splits[mid]), _range_of(key, splits[mid + 1 :], first + mid + 1)).otherwise(_range_of(key, splits[:mid], first))


def numbered(df: DataFrame, key: str, out: str = "at", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place by key order, from 0, without meeting in one task.

    The bounds of key ranges are fixed first and stand as values in the plan,
    so a row falls into the same range wherever and however often the plan is
    run. Ranges are counted, and each starts at the sum of those before. Null
    keys come first; rows with equal keys are numbered in any order. ``ranges``
    is one for about a million rows where it is not given.
    """
    from pyspark.sql import Window

    if ranges is None:
        ranges = min(MAX_RANGES, df.count() // 1_000_000 + 1)
    dealt = df.withColumn("range", _range_of(F.col(key), bounds(df, key, ranges)) if ranges > 1 else F.lit(0))
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}  # a row per range
    starts = [sum(counts.get(r, 0) for r in range(k)) for k in range(max(counts, default=0) + 1)]
    place = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1 + F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("range"))
    return dealt.withColumn(out, place).drop("range")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Numbers the rows in batches of ``size`` by key order."""
    return numbered(df, key, "at").withColumn("batch", F.floor(F.col("at") / size)).drop("at")


def last_n(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The last ``n`` rows of each key, numbered in order."""
    from pyspark.sql import Window

    down = Window.partitionBy(key).orderBy(F.desc(order))
    up = Window.partitionBy(key).orderBy(order)
    return df.withColumn("rn", F.row_number().over(down)).filter(F.col("rn") <= n).withColumn("position", F.row_number().over(up)).drop("rn")
