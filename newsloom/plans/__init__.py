"""Registered queries; importing this package registers all of them."""

from . import corpus, gates, ingest, pages, retrieval, review, runs, stores, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
