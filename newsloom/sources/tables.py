"""Collections that are updated in place: rows in hash buckets, and manifests that name the live files of every bucket.

An upsert reads and rewrites only the buckets that its rows fall into. Readers
follow one manifest and never see a half-written version; a writer that fails
leaves files that no manifest names, and ``expire`` removes them.

    <path>/data/<writing>/bucket=<b>/part-*.parquet
    <path>/manifest/v=<n>            one JSON row each
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, id string, key string, buckets int, columns string, live map<string, string>"
BUCKET = "bucket"


@dataclass(frozen=True)
class Collection:
    """One version of a table folder: ``live`` names the folder under data/ that holds each bucket's rows."""

    version: int
    id: str
    key: str
    buckets: int
    columns: str
    live: dict[int, str]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, place = _files(spark, path)
    fs.delete(place, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first; none where there is no table."""
    fs, _ = _files(spark, path)
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}/_SUCCESS"))
    return sorted(int(n[2:]) for n in _names(spark, f"{path}/manifest") if n.startswith("v=") and done(n))


def opened(spark: SparkSession, path: str, version: int | None = None) -> Collection | None:
    """The latest or a given version; None where there is no table."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        return None
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest/v={found[-1] if version is None else version}").first()
    return Collection(**row.asDict() | {"live": {int(b): name for b, name in row.live.items()}})


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a version, or those of given buckets; None where there is no table."""
    known = opened(spark, path, version)
    return None if known is None else _rows(spark, path, known, buckets)


def _rows(spark: SparkSession, path: str, known: Collection, buckets: list[int] | None = None) -> DataFrame:
    wanted = known.live if buckets is None else {b: known.live[b] for b in buckets if b in known.live}
    places = [f"{path}/data/{name}/{BUCKET}={b}" for b, name in sorted(wanted.items())]
    return spark.read.schema(known.schema).parquet(*places) if places else spark.createDataFrame([], known.schema)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def lookup(spark: SparkSession, path: str, keys: list, version: int | None = None) -> DataFrame | None:
    """Rows by the column that the table is bucketed by; only the keys' buckets are read."""
    known = opened(spark, path, version)
    if known is None:
        return None
    kind = known.schema[known.key].dataType
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(known.key, kind)]))
    touched = [r[0] for r in asked.select(bucket_of(F.col(known.key), known.buckets)).distinct().collect()]
    return _rows(spark, path, known, touched).filter(F.col(known.key).isin(*keys))


def once(new: DataFrame, id: str) -> DataFrame:
    """One row an id, the greatest by its content."""
    rest = [c for c in new.columns if c != id]
    return new.groupBy(id).agg(F.max(F.struct(*rest)).alias("r")).select(id, *[F.col(f"r.`{c}`").alias(c) for c in rest]).select(*new.columns)


def _without(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Rows of ``old`` whose value ``new`` does not hold; null is a value like others."""
    return old.join(new.select(F.col(column).alias("new_value")).distinct(), F.col(column).eqNullSafe(F.col("new_value")), "left_anti")


def upsert(df: DataFrame, path: str, id: str = "id", replace: str | None = None, buckets: int = 64) -> int:
    """Write ``df`` into the table at ``path`` by ``id`` and return the new version.

    New rows win by id; of equal ids in ``df`` the greatest row by its content
    stays. ``replace`` names a column, such as an article id, whose rows are
    replaced as a whole: what the new rows no longer hold goes. The table is
    bucketed by that column then, so an id belongs to one value of it for
    good. ``buckets`` is fixed when the table is made; choose it so that a
    bucket is some hundred MB, as each is rewritten by one task.

    Running an upsert again gives the same rows. Two writers cannot commit the
    same version: the later one fails and changes nothing.
    """
    spark = df.sparkSession
    known = opened(spark, path)
    key = known.key if known else replace or id
    if known and (id != known.id or replace and replace != key):
        raise ValueError(f"the table at {path} is kept by {known.id} and bucketed by {key}")
    count = known.buckets if known else buckets
    columns = known.schema.fieldNames() if known else df.columns
    writing = uuid.uuid4().hex
    # the new rows are written first: their buckets are then known, and a batch is not computed twice
    staged = f"{path}/data/staged-{writing}"
    once(df.select(*columns), id).withColumn(BUCKET, bucket_of(F.col(key), count)).write.partitionBy(BUCKET).parquet(staged)
    touched = sorted(int(n.split("=")[1]) for n in _names(spark, staged) if n.startswith(BUCKET))
    if touched or not known:
        schema = known.schema if known else df.schema
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(staged)
        if known:
            old = _without(_rows(spark, path, known, touched), rows, id)
            if replace:
                old = _without(old, rows, replace)
            rows = rows.unionByName(old.select(*columns).withColumn(BUCKET, bucket_of(F.col(key), count)))
        rows.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{writing}")
    written = {int(n.split("=")[1]) for n in _names(spark, f"{path}/data/{writing}") if n.startswith(BUCKET)}
    live = {b: name for b, name in (known.live if known else {}).items() if b not in touched} | dict.fromkeys(written, writing)
    version = (known.version if known else 0) + 1
    ddl = known.columns if known else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    row = spark.createDataFrame([(version, id, key, count, ddl, {str(b): name for b, name in live.items()})], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/v={version}")
    _delete(spark, staged)
    return version


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what the last ``keep`` versions do not need: older manifests, buckets that were replaced, leftovers of failed writers.

    Run it while nobody writes; returns the folders that went.
    """
    found = versions(spark, path)
    needed = {(name, b) for v in found[-keep:] for b, name in opened(spark, path, v).live.items()}
    gone = [f"{path}/manifest/v={v}" for v in found[:-keep]]
    whole = {name for name, _ in needed}
    for name in _names(spark, f"{path}/data"):
        if name not in whole:
            gone.append(f"{path}/data/{name}")
            continue
        old = [n for n in _names(spark, f"{path}/data/{name}") if n.startswith(BUCKET) and (name, int(n.split("=")[1])) not in needed]
        gone += [f"{path}/data/{name}/{n}" for n in old]
    for place in gone:
        _delete(spark, place)
    return gone
