"""Queries of the readers and sinks over payloads that Spark makes of the tables; SQL has what was put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.urls import host
from tessera.plans.relational_queries import t
from tessera.sources import feeds, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def parts(spark, sf):
    return t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.floor(F.col("p_partkey") / 20).alias("page"), F.col("p_partkey").cast("string").alias("k"))


def payload(rows, item, wrap):
    """A payload for each twenty parts."""
    return rows.groupBy("page").agg(F.collect_list(item).alias("items")).select("page", F.to_json(wrap(F.col("items"))).alias("body"), F.lit("https://w.io/x").alias("base_url"))


def link(name):
    return F.concat(F.lit(f"https://{name}.io/jobs/"), "k")


BOARDS = {
    "greenhouse": (lambda: F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), link("g").alias("absolute_url"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.lit("2026-10-02T00:00:00Z").alias("updated_at")), lambda x: F.struct(x.alias("jobs"))),
    "lever": (lambda: F.struct(F.col("k").alias("id"), F.col("p_name").alias("text"), link("l").alias("hostedUrl"), F.struct(F.col("p_brand").alias("location")).alias("categories"), (F.lit(1790899200000)).alias("createdAt")), lambda x: x),
    "ashby": (lambda: F.struct(F.col("k").alias("jobId"), F.col("p_name").alias("title"), link("a").alias("jobUrl"), F.col("p_brand").alias("location"), F.lit("2026-10-02").alias("publishedAt")), lambda x: F.struct(x.alias("jobs"))),
    "workday": (lambda: F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/jobs/"), "k").alias("externalPath"), F.col("k").alias("jobPostingId"), F.col("p_brand").alias("locationsText")), lambda x: F.struct(x.alias("jobPostings"))),
}


@query(" UNION ALL ".join(f"SELECT '{b}' AS board, p_name AS title, 'https://{h}.io/jobs/' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS external_id, p_brand AS location, {'NULL' if b == 'workday' else 1790899200} AS posted FROM part" for b, h in (("greenhouse", "g"), ("lever", "l"), ("ashby", "a"), ("workday", "w"))))
def board_records(spark, sf):
    """Listings of four boards, twenty parts a page."""
    out = None
    for board, (item, wrap) in BOARDS.items():
        rows = feeds.board(payload(parts(spark, sf), item(), wrap), board).select(F.lit(board).alias("board"), "title", "url", "external_id", "location", F.unix_seconds("posted_at").alias("posted"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT p_name AS title, 'https://c.io/' || p_partkey AS url, 'p' || (p_partkey // 20 + 1) AS next_page FROM part WHERE p_size > 5")
def configured_records(spark, sf):
    """Items and fields by configured paths, a cursor, items without an address left out."""
    item = F.struct(F.struct(F.col("p_name").alias("value")).alias("t"), F.when(F.col("p_size") > 5, F.array(F.concat(F.lit("https://c.io/"), "k"))).alias("u"))
    pages = parts(spark, sf).groupBy("page").agg(F.collect_list(item).alias("items"))
    body = F.to_json(F.struct(F.concat(F.lit("p"), (F.col("page") + 1).cast("string")).alias("next"), F.struct(F.col("items").alias("items")).alias("data")))
    return feeds.board(pages.select(body.alias("body")), "json", {"items": feeds.path("data.items"), "title": ["$.t"], "url": ["$.u"], "next_page": "$.next"}).select("title", "url", "next_page")


@query("SELECT p_partkey // 20 AS page, 20 + count(*) AS offset FROM part GROUP BY ALL HAVING count(*) >= 20")
def listing_offsets(spark, sf):
    """The next page of full listings."""
    item, wrap = BOARDS["workday"]
    pages = payload(parts(spark, sf), item(), wrap).withColumn("offset", F.lit(20).cast("long"))
    return feeds.next_offset(pages, 20).select("page", "offset")


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind, p_name AS title, 'https://r.io/' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 2 = 0 THEN 'Size ' || p_size || ' & more' END AS description, 1790899200 AS posted FROM part
UNION ALL SELECT 'sitemap', NULL, 'https://r.io/' || p_partkey || '?a=1&b=2', NULL, NULL, NULL FROM part WHERE p_size > 5""")
def feed_records(spark, sf):
    """RSS and Atom entries and addresses of sitemaps."""
    rows = parts(spark, sf)
    rss = F.concat(F.lit("<item><title>"), "p_name", F.lit("</title><link>https://r.io/"), "k", F.lit("</link><guid>"), "k", F.lit("</guid><description><![CDATA[<p>Size "), F.col("p_size").cast("string"), F.lit(" &amp; more</p>]]></description><pubDate>Fri, 02 Oct 2026 00:00:00 GMT</pubDate></item>"))
    atom = F.concat(F.lit('<entry><title> '), "p_name", F.lit('</title><link href="https://r.io/'), "k", F.lit('"/><id>'), "k", F.lit("</id><updated>2026-10-02T00:00:00Z</updated></entry>"))
    loc = F.concat(F.lit("<url><loc> "), F.when(F.col("p_size") > 5, "https://r.io/").otherwise("ftp://r.io/"), "k", F.lit("?a=1&amp;b=2</loc></url>"))
    body = lambda df, item, tag: df.groupBy("page").agg(F.concat(F.lit(f"<{tag}>"), F.array_join(F.collect_list(item), ""), F.lit(f"</{tag}>")).alias("body"))
    read = lambda df: feeds.rss(df).select("kind", "title", "url", "external_id", F.nullif("description", F.lit("")).alias("description"), F.unix_seconds("posted_at").alias("posted"))
    two = read(body(rows.filter("p_partkey % 2 = 0"), rss, "rss").withColumn("kind", F.lit("rss"))).unionAll(read(body(rows.filter("p_partkey % 2 = 1"), atom, "feed").withColumn("kind", F.lit("atom"))))
    site = feeds.sitemap(body(rows, loc, "urlset")).select(F.lit("sitemap").alias("kind"), "url")
    return two.unionByName(site, allowMissingColumns=True)


@query("""SELECT 'C' || p_partkey AS company, substring(p_name, 1, 160) AS title, p_brand || ' | Remote' AS location, 'hn-' || p_partkey AS external_id, 'j' || p_partkey || '@acme.dev' AS email FROM part WHERE p_size > 5""")
def thread_records(spark, sf):
    """Comments of hiring threads: the first line names company, role and place; addresses are spelled out."""
    said = F.when(F.col("p_size") > 5, F.concat(F.lit("C"), "k", F.lit(" | "), "p_name", F.lit(" | "), "p_brand", F.lit(" | Remote<p>Mail j"), "k", F.lit(" [at] acme [dot] dev"))).otherwise("no format")
    item = F.struct(F.col("p_partkey").alias("id"), F.lit("2026-10-02T00:00:00Z").alias("created_at"), said.alias("text"))
    return feeds.hiring_thread(payload(parts(spark, sf), item, lambda x: F.struct(x.alias("children"))).drop("base_url")).select("company", "title", "location", "external_id", F.array_join("emails", ",").alias("email"))


@query("""SELECT p_name AS title, 'https://v.io/' || p_partkey AS url, 'Acme, "' || p_brand || '"' || chr(10) || 'Inc' AS company, NULL AS location FROM part""")
def csv_records(spark, sf):
    """CSV files with quoted cells that hold delimiters, quotes and line ends."""
    row = F.concat("k", F.lit(","), "p_name", F.lit(",https://v.io/"), "k", F.lit(',"Acme, ""'), "p_brand", F.lit('""\nInc",'))
    files = parts(spark, sf).groupBy("page").agg(F.concat(F.lit("id,title,url,company,city\r\n"), F.array_join(F.collect_list(row), "\r\n")).alias("body"))
    return feeds.csv_rows(files, {"title": "title", "url": 2, "company": "company", "location": "city"}).select("title", "url", "company", "location")


@query("""SELECT page_id, 'Job ' || page_id AS title, 'https://l.io/jobs/' || (1000 + page_id) AS url, CAST(1000 + page_id AS VARCHAR) AS external_id, 'Acme' AS company, 'Berlin, DE' AS location, len(regexp_extract_all(html, '<a href="/')) > 0 AS linked, 'hr@a.io' AS email FROM pages""")
def nested_postings(spark, sf):
    """Pages as one row each; a posting lies in up to eleven graphs within one another."""
    n = F.col("page_id").cast("string")
    posting = F.concat(F.lit('{"@type": "JobPosting", "title": "Job '), n, F.lit('", "url": "https://l.io/jobs/'), (F.col("page_id") + 1000).cast("string"), F.lit('", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Berlin", "addressCountry": "DE"}}}'))
    depth = (F.col("page_id") % 12).cast("int")
    script = F.concat(F.lit('<p>hr@a.io</p><script type="application/ld+json">'), F.repeat(F.lit('{"@graph": [[{"@type": "Person"}], '), depth), posting, F.repeat(F.lit("]}"), depth), F.lit("</script>"))
    pages = t(spark, sf, "pages").select("page_id", F.concat("html", script).alias("body"), F.col("url").alias("base_url"))
    out = feeds.page_rows(pages, "page_id").select("page_id", "links", F.explode("jobs").alias("j"))
    return out.select("page_id", "j.title", "j.url", "j.external_id", "j.company", "j.location", (F.size("links") > 0).alias("linked"), F.when(F.array_contains("j.emails", "hr@a.io"), "hr@a.io").alias("email"))


@query(r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages), p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (path LIKE '/en/%' OR path LIKE '/fr/1%') OR path LIKE '/en/2%' AS crawler, path NOT LIKE '/de/%' AS mybot, NOT (path LIKE '/en/%' OR path LIKE '/fr/1%') AS simple FROM p""")
def robots_verdicts(spark, sf):
    """Addresses of pages against the rules of their hosts: the longest rule of the longest agent name, and plain prefixes."""
    rules = "User-agent: *\nDisallow: /en/ # all\nAllow: /en/2\nDisallow: /fr/1*\nUser-agent: bot\nUser-agent: other\nDisallow: /de/\n"
    asked = t(spark, sf, "pages").select("page_id", host("url").alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))
    files = asked.select("host").distinct().withColumn("body", F.lit(rules.replace(" # all", "")))
    table = feeds.robots(files)
    out = feeds.allowed(asked, table, "crawler").withColumnRenamed("allowed", "crawler")
    out = feeds.allowed(out, table, "mybot").withColumnRenamed("allowed", "mybot")
    simple = feeds.simple_robots(files.withColumn("body", F.lit(rules)))
    return feeds.simply_allowed(out, simple).select("page_id", "crawler", "mybot", F.col("allowed").alias("simple"))


@query("""SELECT p_partkey // 20 AS page, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS at, 'https://s.io/' || p_partkey AS url, p_name AS title, 'Size ' || p_size || ' ' || p_brand AS snippet FROM part""")
def search_results(spark, sf):
    """Hits of a search service, in order, tags taken out."""
    item = F.struct(F.col("p_partkey").alias("n"), F.concat(F.lit("https://s.io/"), "k").alias("url"), F.col("p_name").alias("title"), F.concat(F.lit("Size <b>"), F.col("p_size").cast("string"), F.lit("</b>")).alias("description"), F.array("p_brand").alias("extra_snippets"))
    bodies = payload(parts(spark, sf), item, lambda x: F.struct(F.struct(F.array_sort(x).alias("results")).alias("web"))).drop("base_url")
    return feeds.search_hits(bodies, "brave").select("page", F.col("at").cast("long").alias("at"), "url", "title", "snippet")


@query("""SELECT p_partkey AS slug, CASE WHEN p_size % 3 = 0 THEN 'greenhouse' WHEN p_size % 3 = 1 THEN 'ashby' ELSE 'lever' END AS kind, CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS jobs, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'Acme ' || p_partkey END AS company FROM part""")
def probed_boards(spark, sf):
    """Of each name the first board that lists a job."""
    k = F.col("p_size") % 3
    slug = F.concat(F.lit("acme-"), "k")
    probe = lambda kind, body: parts(spark, sf).select("p_partkey", slug.alias("slug"), F.lit(kind).alias("kind"), body.alias("body"))
    green = F.when(k == 0, F.concat(F.lit('{"jobs": [{"company_name": "'), "p_brand", F.lit('"}, {}]}'))).otherwise('{"jobs": []}')
    rows = probe("lever", F.lit('[{"id": 1}]')).unionAll(probe("ashby", F.when(k < 2, '{"jobs": [{}]}').otherwise("{}"))).unionAll(probe("greenhouse", green))
    return feeds.first_board(rows).select(F.substring("slug", 6, 20).cast("long").alias("slug"), "kind", "jobs", "company")


@query("""SELECT p_partkey, '"' || p_partkey || '","' || CASE WHEN p_partkey % 2 = 0 THEN '''=' || p_name ELSE replace('a"' || p_name, '"', '""') END || '"' AS line, '{"ok":true,"data":{"name":"' || p_name || '"}}' AS envelope, sha256(p_name || chr(31) || p_brand) <> '' AS digest, '{"ok":false,"error":{"code":"not_found","message":"no ' || p_name || '"}}' AS error FROM part""")
def written_rows(spark, sf):
    """Lines of CSV files and envelopes of answers."""
    rows = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.concat(F.lit('a"'), "p_name")).alias("name"))
    lines = sinks.csv_lines(rows).withColumn("p_partkey", F.regexp_extract("line", '^"([0-9]+)"', 1).cast("long"))
    more = sinks.with_digest(t(spark, sf, "part"), ["p_name", "p_brand"]).select("p_partkey", sinks.envelope(F.struct(F.col("p_name").alias("name"))).alias("envelope"), (F.length("input_digest") == 64).alias("digest"), sinks.error_envelope("not_found", F.concat(F.lit("no "), "p_name")).alias("error"))
    return lines.join(more, "p_partkey").select("p_partkey", "line", "envelope", "digest", "error")
