"""Dates from feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted layouts, tried in order, after the weekday is dropped.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy",
)


def lenient(value: Column) -> Column:
    """A timestamp from ISO, mail and plain date texts in the session's zone; null where none fits."""
    bare = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s*(?i)(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,?\s+", ""))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(x)) for x in LAYOUTS])


def iso_z(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("undated"))


def recent(ts: Column, cutoff: Column) -> Column:
    """Not older than the cutoff; undated passes."""
    return ts.isNull() | (ts >= cutoff)
