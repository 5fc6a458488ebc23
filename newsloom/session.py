"""The Spark session that the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "newsloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow transfer; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share, under ``spark.checkpoint.dir``; a temporary one in local mode alone."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
    return f"{place.rstrip('/')}/store-{uuid.uuid4().hex}"


def sent(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read again: what reads it more than once computes it once, and its size is known."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
