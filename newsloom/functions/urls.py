"""URL functions and filters as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track the reader.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
#: Path parts of pages that are not articles. Fixed values.
EXCLUDED_PARTS = (
    "/audio/", "/authors/", "/cartoons/", "/help/", "/live/", "/live-news/", "/live-updates/", "/newsletter", "/newsletters",
    "/opinion/", "/podcast", "/podcasts", "/pictures/", "/video/", "/videos/",
)


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-cased host without user, port and leading www."""
    return F.lower(F.coalesce(part(url, "HOST"), F.lit("")))


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased; user, fragment, tracking keys and the trailing slash dropped; blank for blank."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    scheme, authority = F.lower(part(trimmed, "PROTOCOL")), F.lower(part(trimmed, "AUTHORITY"))
    bare = F.regexp_replace(authority, "^.*@", "")
    path = F.regexp_replace(F.coalesce(part(trimmed, "PATH"), F.lit("")), "/+$", "")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(F.coalesce(part(trimmed, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~key(p).startswith(TRACKING_PREFIX) & ~key(p).isin(*TRACKING_KEYS))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.coalesce(F.concat(scheme, F.lit("://"), bare, path, query), trimmed)


def url_hash(url: Column, length: int = 16) -> Column:
    return F.left(F.sha2(canonical(url).cast("binary"), 256), F.lit(length))


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """Host equals an allowed domain or is below one."""
    h = host(url)
    known = F.array(*[F.lit(d.lower()) for d in domains]) if domains else F.array().cast("array<string>")
    return F.exists(known, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def excluded(url: Column, parts: Sequence[str] = EXCLUDED_PARTS) -> Column:
    path = F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(path, p))


def probable_article(url: Column, least_parts: int = 2, least_name: int = 12) -> Column:
    """Two path parts or more, the last one long, none excluded."""
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (F.size(parts) >= least_parts) & (F.length(name) >= least_name) & ~excluded(url)


def resolved(base: Column, link: Column) -> Column:
    """An absolute link from a page's url and a link on it; fragment-only and script links give null."""
    root = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    folder = F.concat(root, F.regexp_replace(F.coalesce(F.nullif(part(base, "PATH"), F.lit("")), F.lit("/")), "[^/]*$", ""))
    return (
        F.when(link.rlike(r"^(?i)(#|javascript:|mailto:|tel:|$)"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def names_term(terms: Sequence[str], *texts: Column) -> Column:
    """Whether any text holds any of the terms, in any case."""
    if not terms:
        return F.lit(False)
    whole = F.lower(F.concat_ws(" ", *texts))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(whole, t))


def skip_reason(url: Column, title: Column, summary: Column, domains: Sequence[str], terms: Sequence[str] = (), least_name: int = 12) -> Column:
    """Why a candidate is skipped; empty if it is not."""
    return (
        F.when(~allowed(url, domains), "domain")
        .when(excluded(url), "excluded_url")
        .when(~probable_article(url, least_name=least_name), "not_article")
        .when(names_term(terms, url, title, summary), "blocked_term")
        .otherwise("")
    )
