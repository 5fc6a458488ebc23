"""From landed feed and index pages to candidates, and from pages to crawl outcomes; nothing is fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, html, urls


def feed_candidates(entries: DataFrame, domains: Sequence[str], cutoff: Column, categories: Sequence[str] = (), least_name: int = 12) -> DataFrame:
    """Feed entries that may be articles: canonical link, allowed, article-like, recent or undated, in a category.

    entries: source_key, url, title, summary, published_at, category.
    """
    rows = entries.withColumn("url", urls.canonical(F.col("url")))
    rows = rows.filter(urls.allowed(F.col("url"), domains) & urls.probable_article(F.col("url"), least_name=least_name) & dates.recent(F.col("published_at"), cutoff))
    return rows.filter(F.col("category").isin(*categories)) if categories else rows


def page_anchors(pages: DataFrame, page_id: str = "page_id", url: str = "url", page_html: str = "html") -> DataFrame:
    """(page_id, pos, url, text): the first link to each canonical url of a page, resolved, in page order."""
    links = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("base"), F.posexplode(html.anchors(F.col(page_html))).alias("pos", "a"))
    full = links.withColumn("url", urls.canonical(urls.resolved(F.col("base"), F.trim("a.href")))).filter(F.col("url") != "")
    return full.groupBy("page_id", "url").agg(F.min(F.struct("pos", "a.text")).alias("f")).select("page_id", F.col("f.pos").alias("pos"), "url", F.col("f.text").alias("text"))


def index_candidates(pages: DataFrame, domains: Sequence[str], limit: int, least_parts: int = 2, least_name: int = 12) -> DataFrame:
    """Article-like links of index pages, the first ``limit`` per page."""
    rows = page_anchors(pages).filter(urls.allowed(F.col("url"), domains) & urls.probable_article(F.col("url"), least_parts, least_name))
    order = Window.partitionBy("page_id").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")


def first_by_url(df: DataFrame, url: str, *order: str) -> DataFrame:
    """The first row of each canonical url by ``order``."""
    ranked = df.withColumn("canonical_url", urls.canonical(F.col(url)))
    window = Window.partitionBy("canonical_url").orderBy(*order)
    return ranked.withColumn("rn", F.row_number().over(window)).filter("rn = 1").drop("rn")


def newest_first(df: DataFrame, published: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(published), *ties)


def per_source(df: DataFrame, source: str, n: int, *order) -> DataFrame:
    window = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n).drop("rn")


def discover(entries: DataFrame, arrival: str, domains: Sequence[str], cutoff: Column, blocked: Sequence[str], per_source_limit: int, limit: int | None = None, least_name: int = 12, categories: Sequence[str] = ()) -> DataFrame:
    """Feed candidates deduplicated before the newest-first order, blocked ones out, limits last."""
    rows = first_by_url(feed_candidates(entries, domains, cutoff, categories, least_name), "url", arrival)
    rows = rows.filter(urls.skip_reason(F.col("url"), F.col("title"), F.col("summary"), domains, blocked, least_name) == "")
    rows = per_source(rows, "source_key", per_source_limit, F.desc_nulls_last("published_at"), F.asc(arrival))
    return newest_first(rows, "published_at", arrival).limit(limit) if limit else rows


def stored_urls(objects: DataFrame, kinds: int = 3) -> DataFrame:
    """(url_hash): articles of which all object kinds are stored; objects: url_hash, kind."""
    return objects.groupBy("url_hash").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") >= kinds).select("url_hash")


def new_articles(candidates: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    rows = candidates.withColumn("url_hash", urls.url_hash(F.col(url)))
    return rows.join(stored, "url_hash", "left_anti")


def crawl_outcomes(pages: DataFrame, stored: DataFrame, blocked: Sequence[str], least_words: int) -> DataFrame:
    """(page_id, url_hash, words, status, reason): exists, blocked, too short with its words, or saved."""
    body = html.stripped(html.article_html(F.col("html")))
    rows = pages.select("page_id", urls.url_hash(F.col("url")).alias("url_hash"), "url", body.alias("body"))
    rows = rows.join(stored.withColumn("known", F.lit(True)), "url_hash", "left")
    words = F.size(F.filter(F.split("body", " "), lambda w: w != ""))
    reason = (
        F.when(F.col("known"), "already_exists").when(urls.names_term(blocked, F.col("url"), F.col("body")), "blocked_term")
        .when(words < least_words, F.concat(F.lit("too_short:"), words.cast("string"))).otherwise("")
    )
    rows = rows.select("page_id", "url_hash", words.alias("words"), reason.alias("reason"))
    return rows.withColumn("status", F.when(F.col("reason") == "", "saved").otherwise("skipped"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def article_paths(articles: DataFrame, source: str, url: str) -> DataFrame:
    """Where an article is kept: articles/<source>/<2 digits>/<hash>; the same url always has the same place."""
    h = urls.url_hash(F.col(url), 24)
    return articles.withColumn("path", F.concat_ws("/", F.lit("articles"), F.col(source), F.left(h, F.lit(2)), h))
