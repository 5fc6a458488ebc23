"""Writers. The commit protocol makes every write whole or absent; single files are written for small results alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, run: str = "run") -> None:
    df.write.mode("append").partitionBy(run).json(path)


def articles(df: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Gzipped article records under source and hash prefix; stored urls are not written again. df: source, url_hash, ..."""
    rows = df if existing is None else df.join(existing.select("url_hash").distinct(), "url_hash", "left_anti")
    rows.withColumn("hash_prefix", F.left("url_hash", F.lit(2))).write.mode("append").partitionBy("source", "hash_prefix").option("compression", "gzip").json(path)


def manifest(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Run manifests under year, month and day."""
    parts = {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")}
    df.withColumns(parts).repartition(*parts).write.mode("append").partitionBy(*parts).option("compression", "gzip").json(path)


@dataclass(frozen=True)
class Store:
    """Where rows go: ``write`` appends rows, ``held`` gives those that are there, or None before the first write."""

    name: str
    write: Callable[[DataFrame], None]
    held: Callable[[SparkSession], DataFrame | None]


def parquet_store(name: str, path: str) -> Store:
    def held(spark: SparkSession) -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None

    return Store(name, lambda df: df.write.mode("append").parquet(path), held)


def bucketed_store(name: str, path: str, id: str, buckets: int = 64) -> Store:
    """A collection of ``tables``: rows of a key that comes again are replaced."""
    return Store(name, lambda df: tables.upsert(df, path, id, buckets=buckets), lambda spark: tables.read(spark, path))


def holdings(spark: SparkSession, stores: Sequence[Store], key: str) -> DataFrame | None:
    """(key, missing, everywhere): which stores lack a key that some store has, in one aggregation over all stores."""
    parts = [frame.select(key, F.lit(s.name).alias("store")) for s in stores if (frame := s.held(spark)) is not None]
    if not parts:
        return None
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    has = [F.bool_or(F.col("store") == s.name) for s in stores]
    lacks = F.array_compact(F.array(*[F.when(~h, s.name) for h, s in zip(has, stores)]))
    return seen.groupBy(key).agg(lacks.alias("missing")).withColumn("everywhere", F.size("missing") == 0)


def fan_out(df: DataFrame, stores: Sequence[Store], key: str) -> None:
    """Rows to several stores; each store gets the rows whose key it lacks.

    A key exists if all stores hold it. A run that broke off between two
    stores is completed by running it again: nothing is written twice.
    """
    known = holdings(df.sparkSession, stores, key)
    every = F.array(*[F.lit(s.name) for s in stores])
    rows = df.withColumn("missing_stores", every) if known is None else df.join(known.select(key, F.col("missing").alias("missing_stores")), key, "left").withColumn("missing_stores", F.coalesce("missing_stores", every))
    held = rows.filter(F.size("missing_stores") > 0).persist()
    try:
        for s in stores:
            part = held.filter(F.array_contains("missing_stores", s.name)).drop("missing_stores").select(*df.columns)
            if part.limit(1).count():
                s.write(part)
    finally:
        held.unpersist()


def complete(source: Store, stores: Sequence[Store], spark: SparkSession, key: str) -> None:
    """Copy to every store what only ``source`` is sure to hold, for runs whose input is gone."""
    rows = source.held(spark)
    if rows is not None:
        fan_out(rows, stores, key)


def review_csv(df: DataFrame, path: str) -> None:
    """Review rows with list cells as JSON."""
    lists = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(lists).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def text_report(df: DataFrame, path: str) -> None:
    """A small text report as one file. df: value."""
    df.coalesce(1).write.mode("overwrite").text(path)


def review_documents(df: DataFrame, path: str) -> None:
    """Nested review documents, a line each, with one article in it."""
    from ..operators.review import readable_queue

    one = F.array(F.struct("article_id", "questions"))
    readable_queue(df).select(F.lit("1").alias("schema_version"), one.alias("articles")).write.mode("overwrite").json(path)


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rn = 1").drop("rn")
