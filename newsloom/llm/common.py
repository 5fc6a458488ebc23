"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of this process's tables that stand in the shared folder, oldest first.
WRITTEN: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set in local mode, as
    in tests; on a cluster, whose machines share no such folder, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = spark.sparkContext.getCheckpointDir()
        path = known
    return path.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """While this holds, Spark deletes the shuffle files of a job when it ends; what was written needs them no more."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again; ``options`` go to the writer.

    Cuts the lineage: an executor that is lost later costs no recomputation.
    Tables that a returned frame still reads stay in the folder until
    ``drop_tables`` or the folder's own clean-up; operators drop all others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    WRITTEN.append(path)
    return out


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nobody reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in WRITTEN:
            WRITTEN.remove(name)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``stored`` returned and nobody reads any more."""
    for df in frames:
        drop_tables(df.sparkSession, [df.stored_path])


def nested(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, *columns): each row whole, so that no column of an operator's result can clash with one of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale says of other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text 'null'."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
