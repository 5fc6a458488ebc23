"""Readers with explicit schemas. Every path is one that Spark reads; nothing opens files itself."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def html_directory(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(filename, html): UTF-8, and windows-1252 for files that are not valid UTF-8; unreadable files are skipped.

    The five bytes without a windows-1252 sign become U+FFFD.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("filename"), decoded(F.col("content")).alias("html"))


#: What windows-1252 has at 0x80 to 0x9F; the rest equals ISO-8859-1. Fixed values of that code page.
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def decoded(content: Column) -> Column:
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.coalesce(F.try_validate_utf8(content.cast("string")), western)


def clean_articles(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned article documents; the article id defaults to the file name without its ending."""
    rows = spark.read.schema(schemas.CLEAN_ARTICLE).option("multiLine", "true").json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(_clean)?\.json$", "")
    m = F.col("metadata")
    return rows.select(
        F.coalesce(F.nullif(m["article_id"], F.lit("")), name).alias("article_id"), F.coalesce("text", F.lit("")).alias("text"),
        *[F.coalesce(m[c], F.lit("")).alias(c) for c in ("title", "url", "publish_date", "author", "publisher")],
    )


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, torn, broken): parsed lines of log files as variants, a torn last line of each file, and bad lines elsewhere.

    Appends are one line each, so a torn line can only be the last; any other
    bad line is a violation that callers must reject.
    """
    # a long file is read in splits: a line's place is its split's start and its order inside it
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line")).filter("line <> ''")
    parsed = lines.withColumn("record", F.try_parse_json("line"))
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    bad = parsed.filter("record IS NULL").join(last, "file")
    return parsed.filter("record IS NOT NULL").select("file", "at", "record"), bad.filter("at = last").select("file", "at", "line"), bad.filter("at <> last").select("file", "at", "line")


def quarantined_log(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """(file, record): the sound lines of log files as variants, after one pass that sets the others aside.

    Every line is written once, with what it is, under ``quarantine``: a torn
    last line of a file is left there for inspection (``set_aside``), and any
    other line that is no record makes the read fail, with the line.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bad line is torn if it ends its file: the file's last split, and no further line of it in the task."""

        def rows(b: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
            ok, last = b["ok"].to_numpy(zero_copy_only=False), ends & b["last_split"].to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([b["file"], b["line"], pa.array(np.where(ok, "sound", np.where(last, "torn", "broken")))], ["file", "line", "state"])

        held = None  # the last row so far, until the next one tells whether it ends its file
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            files, held = b["file"], b.slice(b.num_rows - 1)
            yield rows(b.slice(0, b.num_rows - 1), pc.not_equal(files[:-1], files[1:]).to_numpy(zero_copy_only=False))
        if held is not None:
            yield rows(held, np.array([True]))

    m = F.col("_metadata")
    last_split = m["file_block_start"] + m["file_block_length"] >= m["file_size"]
    lines = spark.read.text(path).select(m["file_path"].alias("file"), last_split.alias("last_split"), F.col("value").alias("line")).filter("line <> ''")
    place = f"{quarantine}/read-{uuid.uuid4().hex}"
    lines.withColumn("ok", F.try_parse_json("line").isNotNull()).mapInArrow(told, "file string, line string, state string").write.partitionBy("state").parquet(place)
    kept = spark.read.schema("file string, line string, state string").parquet(place)
    broken = kept.filter("state = 'broken'").select(F.assert_true(F.lit(False), F.concat(F.lit("no record: "), "file", F.lit(": "), "line")).alias("x"))
    broken.write.format("noop").mode("overwrite").save()
    return kept.filter("state = 'sound'").select("file", F.parse_json("line").alias("record"))


def set_aside(spark: SparkSession, quarantine: str) -> DataFrame:
    """(file, line, state) of the lines that were no records, of all reads under ``quarantine``."""
    return spark.read.schema("file string, line string, state string").option("basePath", quarantine).parquet(f"{quarantine}/*").filter("state <> 'sound'").select("file", "line", "state")


def snapshot(spark: SparkSession, path: str, revision: str) -> DataFrame:
    """One pinned revision of a dataset kept as <path>/revision=<id>; it can be scanned again and again."""
    return spark.read.parquet(f"{path}/revision={revision}")


def review_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flat review rows of nested review documents: one a file, or with ``lines`` one a line."""
    from ..operators.review import flattened

    return flattened(spark.read.schema(schemas.REVIEW_DOCUMENT).option("multiLine", str(not lines)).json(path))


def review_csv(spark: SparkSession, path: str, known: DataFrame, schema: str = schemas.REVIEW) -> DataFrame:
    """Review rows of a CSV with JSON list cells; unknown and repeated ids raise."""
    from ..functions.text import json_list
    from ..operators.review import coverage_violations, require_none

    flat = ", ".join(c.replace("ARRAY<STRING>", "STRING") for c in schema.split(", "))
    rows = csv(spark, path, flat)
    require_none(coverage_violations(known, rows).filter("rule <> 'missing'"), "review rows with unknown or repeated ids")
    rows = rows.withColumn("raw", F.col("reason_codes")).withColumn("reason_codes", json_list(F.col("reason_codes")))
    require_none(rows.filter("reason_codes IS NULL").select("question_id", "raw"), "review rows with a broken list")
    return rows.drop("raw")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """The last report by path of every retriever under a folder tree."""
    from ..operators.reports import last_per

    rows = spark.read.schema("config STRUCT<retriever: STRING>, metrics MAP<STRING, DOUBLE>, failures ARRAY<STRUCT<question_id: STRING, question: STRING>>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return last_per(rows.select(F.col("config.retriever").alias("retriever"), "metrics", "failures", F.col("_metadata.file_path").alias("path")), "retriever", "path")


def collection(df: DataFrame, ids: list[str] | None = None, where: Column | None = None, contains: str | None = None, limit: int | None = None, offset: int = 0, include: list[str] | None = None, id: str = "id", text: str = "text") -> DataFrame:
    """Rows of a collection by ids, metadata condition and text, in id order, with only the wanted columns."""
    rows = df
    if ids is not None:
        rows = rows.filter(F.col(id).isin(*ids))
    if where is not None:
        rows = rows.filter(where)
    if contains is not None:
        rows = rows.filter(F.contains(text, F.lit(contains)))
    if limit is not None or offset:
        rows = rows.orderBy(id).offset(offset)
        rows = rows.limit(limit) if limit is not None else rows
    return rows.select(id, *include) if include is not None else rows


def stats(df: DataFrame, id: str = "id", peek: int = 5) -> DataFrame:
    """(count, sample): number of rows and the first ids; zeros for an empty collection."""
    first = df.orderBy(id).limit(peek).agg(F.array_sort(F.collect_list(id)).alias("sample"))
    return df.agg(F.count("*").alias("count")).join(F.broadcast(first))
