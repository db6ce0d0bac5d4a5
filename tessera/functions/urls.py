"""Addresses, identifiers and keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import col, component, text


def host(x) -> Column:
    return F.lower(F.try_parse_url(col(x), F.lit("HOST")))


def domain(x) -> Column:
    return F.regexp_replace(host(x), r"^www\.", "")


def is_public(x) -> Column:
    """http or https with a dotted host that is no local name."""
    return F.coalesce(col(x).rlike(r"(?i)^https?://") & host(x).rlike(r"\.") & ~host(x).rlike(r"^(localhost|127\.|10\.|192\.168\.)|\.local$"), F.lit(False))


def joined(base, link) -> Column:
    """A link resolved against its page: absolute, scheme-relative, root-relative, else beside the page."""
    origin = F.regexp_extract(text(base), r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(text(base), r"^(https?://[^/?#]+[^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    link = text(link)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(text(base), r"^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def identifier(x) -> Column:
    """An id from known query keys, else the path segment after the last jobs, postings or positions; null without one."""
    query = F.coalesce(*[F.nullif(F.trim(F.try_url_decode(F.try_parse_url(col(x), F.lit("QUERY"), F.lit(k)))), F.lit("")) for k in V.ID_KEYS])
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(col(x), F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    after = F.transform(parts, lambda s, i: F.when((i > 0) & F.get(parts, i - 1).isin("jobs", "job", "postings", "posting", "positions", "position"), F.regexp_replace(s, r"^[/.;]+|[/.;]+$", "")))
    found = F.filter(after, lambda s: F.octet_length(s) >= 3)
    return F.coalesce(query, F.try_element_at(found, F.lit(-1)))


def cross_key(company, title, location) -> Column:
    return F.sha2(F.concat_ws("|", component(company), component(title), component(location)), 256)


def source_identifier(external_id, url, company, title, location) -> Column:
    return F.coalesce(F.nullif(F.trim(text(external_id)), F.lit("")), identifier(url), F.concat(F.lit("content:"), cross_key(company, title, location)))


def links(base, html) -> Column:
    """array of (url, label) of a page's anchors: http only, each address once with its first label."""
    anchors = F.regexp_extract_all(text(html), F.lit(r'(?is)(<a\b[^>]*href\s*=\s*["\'][^"\']*["\'][^>]*>.*?</a>)'), F.lit(1))
    pairs = F.transform(anchors, lambda a: F.struct(F.trim(F.regexp_extract(a, r'(?is)href\s*=\s*["\']([^"\']*)["\']', 1)).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("label")))
    real = F.filter(pairs, lambda p: (p["href"] != "") & ~p["href"].startswith("#"))
    full = F.filter(F.transform(real, lambda p: F.struct(joined(base, p["href"]).alias("url"), p["label"].alias("label"))), lambda p: p["url"].rlike(r"(?i)^https?://"))
    urls = F.array_distinct(F.transform(full, lambda p: p["url"]))
    return F.transform(urls, lambda u: F.get(F.filter(full, lambda p: p["url"] == u), F.lit(0)))
