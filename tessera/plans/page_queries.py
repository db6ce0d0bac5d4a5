"""Queries of the page readers over `pages`, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.relational_queries import t
from tessera.sources import elements as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def plain(x: str) -> str:
    """SQL of markup as text: tags are blanks, entities decoded, white space normal. The tables have these entities only."""
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, value in (("&middot;", "&middot;"), ("&copy;", "&copy;"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{value}')" if entity != value else out
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_LINKS = """SELECT page_id, url AS base, unnest(range(1, 1 + len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>')))) AS item_no,
unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS link, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS label FROM pages"""


@query(f"SELECT page_id, CAST(item_no AS INTEGER) AS item_no, {plain('label')} AS title, {plain('link')} AS link FROM ({_LINKS})")
def selector_items(spark, sf):
    """Items and fields of every page: the entries of its navigation, each with text and address."""
    return E.items(t(spark, sf, "pages").select("page_id", "html"), "nav li", {"title": ("a",), "link": ("a", "href")}).drop("missing")


@query(f"SELECT page_id, {plain('label')} AS title, regexp_extract(base, '^https?://[^/?#]+') || {plain('link')} AS url, 'html' AS source_kind FROM ({_LINKS})")
def selector_records(spark, sf):
    """The same items as records, with whole addresses."""
    pages = t(spark, sf, "pages").select("page_id", F.col("html").alias("body"), F.col("url").alias("base_url"))
    return E.selector_pages(pages, "nav > ul > li", {"title": ("a[href]",), "url": ("a", "href")}).select("page_id", "title", "url", "source_kind")


@query(f"""SELECT page_id, sha256({plain("regexp_extract(html, '(?s)<article>.*</article>')")}) AS article, sha256({plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS heading,
{plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad, len(regexp_extract_all(html, '<p>|<p [^>]*>')) AS paragraphs FROM (SELECT page_id, regexp_replace(html, '(?s)<style>.*?</style>|<script>.*?</script>', '', 'g') AS html FROM pages)""")
def selector_fields(spark, sf):
    """Named parts of every page by tag, class and descendant; paragraphs that are never closed are told apart."""
    rows = E.with_elements(t(spark, sf, "pages").select("page_id", "html"))
    first = lambda s: E.text_of(F.col("_tokens"), F.get(E.select(F.col("_tokens"), F.col("_elements"), s), F.lit(0)))
    count = F.size(E.select(F.col("_tokens"), F.col("_elements"), "article p, article > p")).cast("long")
    return rows.select("page_id", F.sha2(first("article"), 256).alias("article"), F.sha2(first("article > h1"), 256).alias("heading"), first("body .ad").alias("ad"), count.alias("paragraphs"))


@query(r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)(<style>).*?</style>|(<script>).*?</script>|<!--.*?-->', '\1\2', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY ALL""")
def page_elements(spark, sf):
    """Elements of each page by tag."""
    return E.element_rows(t(spark, sf, "pages").select("page_id", "html")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
