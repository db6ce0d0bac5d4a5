"""Readers: payload rows -> one record schema. Each takes (payload columns) and explodes with built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import dates, urls
from tessera.functions.text import emails, html_blocks, normal_space, plain_addresses, strip_html, text
from tessera.shared import stored

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "apply_url", "external_id", "company", "location", "description")] + [T.StructField("posted_at", T.TimestampType()), T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("source_kind", T.StringType())])

#: The fields of the job boards, first choice first. `url` may be joined to a base.
BOARDS = {
    "greenhouse": {"items": "$.jobs", "title": ["$.title"], "url": ["$.absolute_url"], "apply_url": ["$.absolute_url"], "external_id": ["$.id"], "company": ["$.company_name"], "location": ["$.location.name"], "description": ["$.content"], "posted_at": ["$.first_published", "$.updated_at"]},
    "lever": {"items": "$", "title": ["$.text"], "url": ["$.hostedUrl", "$.applyUrl"], "apply_url": ["$.applyUrl"], "external_id": ["$.id"], "company": [], "location": ["$.categories.location"], "description": ["$.descriptionPlain", "$.description"], "posted_at": ["$.createdAt"]},
    "ashby": {"items": "$.jobs", "title": ["$.title"], "url": ["$.jobUrl", "$.applyUrl"], "apply_url": ["$.applyUrl"], "external_id": ["$.id", "$.jobId"], "company": ["$.organizationName"], "location": ["$.location"], "description": ["$.descriptionHtml", "$.descriptionPlain"], "posted_at": ["$.publishedAt", "$.publishedDate"]},
    "workday": {"items": "$.jobPostings", "title": ["$.title"], "url": ["$.externalPath"], "apply_url": ["$.jobPostingInfo.applyUrl"], "external_id": ["$.jobPostingId", "$.id"], "company": [], "location": ["$.locationsText"], "description": ["$.jobPostingInfo.jobDescription"], "posted_at": ["$.postedOn"]},
    "json": {"items": "$.jobs", "title": ["$.title"], "url": ["$.url"], "apply_url": ["$.apply_url"], "external_id": ["$.id"], "company": ["$.company"], "location": ["$.location"], "description": ["$.description"], "posted_at": ["$.posted_at"]},
}


def path(dotted: str) -> str:
    """A dotted path (numbers are positions) as a JSON path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split(".") if p)


def value_text(item: Column, at: str) -> Column:
    """Scalars as text; of an object its value, name or text; of an array its first such element. Empty is null."""

    def scalar(p: str) -> Column:
        found = F.get_json_object(item, p)
        return F.when(~found.rlike(r"^\s*[\[{]"), F.nullif(F.trim(found), F.lit("")))

    inside = [scalar(f"{at}.{k}") for k in ("value", "name", "text")]
    return F.coalesce(scalar(at), *inside, scalar(f"{at}[0]"), *[scalar(f"{at}[0].{k}") for k in ("value", "name", "text")])


def json_items(body: Column, at: str) -> Column:
    """The array at a path as JSON texts."""
    return F.from_json(F.get_json_object(body, at) if at != "$" else body, "array<string>")


def board(payloads: DataFrame, kind: str, fields: dict | None = None, strict: bool = False) -> DataFrame:
    """(body, base_url, ...) -> RECORD rows with the payload's other columns. Items without title or address are skipped, or raise if strict.

    `fields` replaces the board's own: a field that is configured has no other choice to fall back on. With a JSON path
    under "next_page" each row also has the payload's cursor.
    """
    m = BOARDS[kind] | (fields or {})
    next_page = value_text(F.col("body"), m["next_page"]) if m.get("next_page") else None
    rows = payloads.withColumn("_item", F.explode(json_items(F.col("body"), m["items"])))
    pick = lambda k: F.coalesce(*[value_text(F.col("_item"), p) for p in m[k]], F.lit(None).cast("string"))
    base = F.col("base_url") if "base_url" in payloads.columns else F.lit(None).cast("string")
    out = {k: pick(k) for k in ("title", "url", "apply_url", "external_id", "company", "location", "description", "posted_at")}
    if kind == "workday":
        out["external_id"] = F.coalesce(out["external_id"], F.translate(F.regexp_replace(out["url"], "^/", ""), "/", ":"))
        out["url"] = urls.joined(base, out["url"])
    if next_page is not None:
        out["next_page"] = next_page
    made = rows.select(*[c for c in payloads.columns if c not in ("body", "base_url")], *[v.alias(k) for k, v in out.items()])
    whole = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    if strict:
        made = made.withColumn("title", F.when(whole, F.col("title")).otherwise(F.raise_error(F.lit("an item has no title or no url"))))
    else:
        made = made.filter(whole)
    blocks = html_blocks("description")
    return made.withColumns({"description": blocks, "posted_at": dates.parsed("posted_at"), "emails": emails(blocks), "source_kind": F.lit(kind)})


def rss(payloads: DataFrame) -> DataFrame:
    """(body) of RSS 2.0 or Atom -> RECORD rows: entries are found in any name space, tags in any case."""
    entries = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>(.*?)</(?:\w+:)?(?:item|entry)>"), F.lit(1))
    rows = payloads.select(*[c for c in payloads.columns if c != "body"], F.explode(entries).alias("_e"))

    def tag(*names: str) -> Column:
        def one(n: str) -> Column:
            inner = F.regexp_extract("_e", rf"(?is)<(?:\w+:)?{n}\b[^>]*>(.*?)</(?:\w+:)?{n}>", 1)
            return F.nullif(F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))

        return F.coalesce(*[one(n) for n in names])

    href = F.nullif(F.regexp_extract("_e", r'(?is)<(?:\w+:)?link\b[^>]*href\s*=\s*["\']([^"\']+)', 1), F.lit(""))
    url, body = F.coalesce(tag("link"), href), html_blocks(tag("description", "summary", "content"))
    out = rows.select(*[c for c in payloads.columns if c != "body"], normal_space(tag("title")).alias("title"), url.alias("url"), F.lit(None).cast("string").alias("apply_url"), tag("guid", "id").alias("external_id"), tag("company", "creator").alias("company"), tag("location").alias("location"), body.alias("description"), dates.parsed(tag("pubdate", "published", "updated")).alias("posted_at"), emails(body).alias("emails"), F.lit("rss").alias("source_kind"))
    return out.filter("title <> '' and url is not null")


def sitemap(payloads: DataFrame) -> DataFrame:
    """(body) -> url, at: the http addresses of all loc elements in their order."""
    loc = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    rows = payloads.select(*[c for c in payloads.columns if c != "body"], F.posexplode(loc).alias("at", "url"))
    return rows.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&"))).filter("url rlike '(?i)^https?://'")


#: Levels of arrays and graphs that a round opens.
LEVELS = 6


def is_posting(item: Column) -> Column:
    kinds = F.get_json_object(item, "$['@type']")
    many = F.coalesce(F.from_json(kinds, "array<string>"), F.array(kinds))
    return F.coalesce(F.exists(many, lambda k: F.lower(k) == "jobposting"), F.lit(False))


def json_ld(payloads: DataFrame) -> DataFrame:
    """(body, base_url) of HTML pages -> RECORD rows of their JobPosting objects: single ones, in arrays and in @graph, however deep.

    A posting is not looked into for others. Each round opens what the last one found and is written as a table, until
    nothing is left to open; so it is for batches, not for streams.
    """
    kept = [c for c in payloads.columns if c not in ("body", "base_url")]
    scripts = F.regexp_extract_all(F.col("body"), F.lit(r'(?is)<script\b[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    none, item, jobs = F.array().cast("array<string>"), F.col("_item"), None
    done = lambda x: ~F.ltrim(x).startswith("[") & is_posting(x)

    def below(x: Column) -> Column:
        graph = F.get_json_object(x, "$['@graph']")
        inside = F.coalesce(F.from_json(graph, "array<string>"), F.when(graph.isNotNull(), F.array(graph)), none)
        return F.when(F.ltrim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), none)).when(is_posting(x), F.array(x)).otherwise(inside)

    level = payloads.select(*kept, emails("body").alias("_page"), F.explode(scripts).alias("_item"))
    while True:
        opened = F.array("_item")
        for _ in range(LEVELS):
            opened = F.flatten(F.transform(opened, below))
        level = stored(level.select(*kept, "_page", F.explode(opened).alias("_item")), "json-ld")
        found = level.filter(done(item))
        jobs = found if jobs is None else jobs.unionAll(found)
        level = level.filter(~F.coalesce(done(item), F.lit(False)))
        if level.isEmpty():
            break
    pick = lambda *ps: F.coalesce(*[value_text(F.col("_item"), p) for p in ps], F.lit(None).cast("string"))
    place = F.concat_ws(", ", *[pick(f"$.jobLocation.address.{k}", f"$.jobLocation[0].address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")])
    url = pick("$.url", "$.mainEntityOfPage", "$['@id']")
    body = html_blocks(pick("$.description"))
    own, page = emails(body), F.col("_page")
    out = jobs.select(
        *[c for c in payloads.columns if c not in ("body", "base_url")], pick("$.title", "$.name").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("apply_url"),
        F.coalesce(pick("$.identifier"), urls.identifier(url)).alias("external_id"), pick("$.hiringOrganization").alias("company"), F.nullif(F.coalesce(F.nullif(place, F.lit("")), pick("$.jobLocation", "$.jobLocation.address")), F.lit("")).alias("location"),
        body.alias("description"), dates.parsed(pick("$.datePosted")).alias("posted_at"), F.when(F.size(own) > 0, own).otherwise(page).alias("emails"), F.lit("html").alias("source_kind"),
    )
    return out.filter("title is not null and url rlike '(?i)^https?://'")


def hiring_thread(payloads: DataFrame) -> DataFrame:
    """(body) of comment threads -> RECORD rows: the first line is `Company | Role | Place ...`; others are skipped."""
    rows = payloads.select(*[c for c in payloads.columns if c != "body"], F.explode(json_items(F.col("body"), "$.children")).alias("_c"))
    lines = F.filter(F.transform(F.split(F.coalesce(F.get_json_object("_c", "$.text"), F.lit("")), "<p>"), lambda p: plain_addresses(strip_html(p))), lambda p: p != "")
    rows = rows.withColumns({"_lines": lines, "_id": F.get_json_object("_c", "$.id"), "_at": F.get_json_object("_c", "$.created_at")})
    parts = F.filter(F.transform(F.split(F.coalesce(F.get("_lines", F.lit(0)), F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    rows = rows.withColumn("_parts", parts).filter(F.size("_parts") >= 2)
    body = F.array_join("_lines", "\n")
    return rows.select(
        *[c for c in payloads.columns if c != "body"], F.substring(F.get("_parts", F.lit(1)), 1, 160).alias("title"), F.concat(F.lit("https://news.ycombinator.com/item?id="), "_id").alias("url"), F.lit(None).cast("string").alias("apply_url"),
        F.concat(F.lit("hn-"), "_id").alias("external_id"), F.substring(F.get("_parts", F.lit(0)), 1, 80).alias("company"), F.nullif(F.array_join(F.slice("_parts", 3, 3), " | "), F.lit("")).alias("location"), body.alias("description"), dates.parsed("_at").alias("posted_at"), emails(body).alias("emails"), F.lit("json").alias("source_kind"),
    )


def csv_rows(payloads: DataFrame, fields: dict[str, str | int], delimiter: str = ",", header: bool = True) -> DataFrame:
    """(body) of CSV files -> RECORD rows: fields by header name or position. A row without title or url raises.

    Quoted cells may hold delimiters, doubled quotes and line ends; a quote that is never closed holds the rest of the file.
    """
    d = re.escape(delimiter)
    # possessive, so that a cell or file of any length is read without recursion and in one pass
    cell = rf'{d}(?:"((?:[^"]++|"")*+)"|([^"{d}]*+))'
    every = F.regexp_extract_all(F.col("body"), F.lit(r'(?:[^"\n]++|"(?:[^"]++|"")*+"?)++'), F.lit(0))
    lines = F.filter(F.transform(every, lambda line: F.regexp_replace(line, r"\r$", "")), lambda line: F.trim(line) != "")
    quoted, plain = (F.regexp_extract_all(F.concat(F.lit(delimiter), F.col("_line")), F.lit(cell), F.lit(i)) for i in (1, 2))
    cells = F.zip_with(quoted, plain, lambda q, p: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p))
    kept = [c for c in payloads.columns if c != "body"]
    rows = payloads.select(*kept, lines.alias("_lines")).select(*kept, F.get("_lines", F.lit(0)).alias("_line"), F.explode(F.slice("_lines", 2 if header else 1, 2**30)).alias("_row"))
    rows = rows.withColumn("_head", cells).drop("_line").withColumnRenamed("_row", "_line").withColumn("_cells", cells)
    pick = lambda k: F.lit(None).cast("string") if k not in fields else F.nullif(F.trim(F.get("_cells", F.lit(fields[k]) if isinstance(fields[k], int) else F.array_position("_head", fields[k]).cast("int") - 1)), F.lit(""))
    need = lambda k: F.coalesce(pick(k), F.raise_error(F.lit(f"a row has no {k}")).cast("string"))
    body = html_blocks(pick("description"))
    return rows.select(*kept, need("title").alias("title"), need("url").alias("url"), *[pick(k).alias(k) for k in ("apply_url", "external_id", "company", "location")], body.alias("description"), dates.parsed(pick("posted_at")).alias("posted_at"), emails(body).alias("emails"), F.lit("csv").alias("source_kind"))


def labelled_cases(lines: DataFrame) -> DataFrame:
    """(value) lines of JSON -> cases; blank lines are skipped. `fault` tells what is wrong, null if nothing is; repeated ids are faults."""
    shape = "id string, title string, description string, country string, label boolean, reason string, seniority string"
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", shape).alias("c"), "value")
    flat = rows.select("c.*", F.try_parse_json("value").isNull().alias("_bad")).withColumn("country", F.upper(F.trim("country")))
    fault = F.when(F.col("_bad"), "not JSON")
    for f in ("id", "title", "description", "country", "reason"):
        fault = fault.when(F.trim(text(f)) == "", f"no {f}")
    fault = fault.when(F.col("label").isNull(), "no label")
    twice = flat.groupBy("id").agg((F.count("*") > 1).alias("_twice"))
    out = flat.withColumn("fault", fault).join(twice, "id", "left")
    return out.withColumn("fault", F.coalesce("fault", F.when(F.coalesce("_twice", F.lit(False)), "repeated id"))).drop("_bad", "_twice")


def robots(files: DataFrame) -> DataFrame:
    """(host, body) -> (host, agent, allow, pattern): one row a rule. Consecutive agent lines share the rules that follow."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line"))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    rows = F.array_agg(F.struct("at", key.alias("k"), value.alias("v")))
    kept = lines.filter(key.isin("user-agent", "allow", "disallow")).groupBy("host").agg(F.array_sort(rows).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        agent, new = F.array(F.lower(x["v"])), s["ruled"]
        named = F.when(new, agent).otherwise(F.concat(s["agents"], agent))
        rule = F.transform(s["agents"], lambda a: F.struct(a.alias("agent"), (x["k"] == "allow").alias("allow"), x["v"].alias("pattern")))
        is_agent = x["k"] == "user-agent"
        return F.struct(F.when(is_agent, named).otherwise(s["agents"]).alias("agents"), F.when(is_agent, F.lit(False)).otherwise(F.lit(True)).alias("ruled"), F.when(is_agent | (x["v"] == ""), s["rules"]).otherwise(F.concat(s["rules"], rule)).alias("rules"))

    start = F.expr("named_struct('agents', CAST(array() AS array<string>), 'ruled', true, 'rules', CAST(array() AS array<struct<agent:string,allow:boolean,pattern:string>>))")
    return kept.select("host", F.explode(F.aggregate("rows", start, step)["rules"]).alias("r")).select("host", "r.*")


def allowed(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(host, path, ...) with `allowed`: rules of the longest agent name in ours, then the longest pattern; a tie allows."""
    mine = rules.filter((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent")))
    rank = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = mine.groupBy("host").agg(F.max(rank).alias("best"))
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"(?<!\\)\$(?!$)", r"\\$")
    chosen = mine.join(best, "host").filter(rank == F.col("best")).select("host", "allow", F.concat(F.lit("^"), regex).alias("regex"), F.length("pattern").alias("n"))
    sets = chosen.groupBy("host").agg(F.array_agg(F.struct("n", "allow", "regex")).alias("rules"))
    hits = F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["regex"]))
    verdict = F.get(F.array_sort(hits, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(b["allow"].cast("int") - a["allow"].cast("int"))), F.lit(0))["allow"]
    return requests.join(sets, "host", "left").withColumn("allowed", F.coalesce(verdict, F.lit(True))).drop("rules")


def next_offset(payloads: DataFrame, size: int) -> DataFrame:
    """(body, offset, ...) of Workday listings -> the payloads whose page was full, with the offset of the next one."""
    n = F.size(json_items(F.col("body"), BOARDS["workday"]["items"]))
    return payloads.filter(n >= size).withColumn("offset", F.col("offset") + size).drop("body")


def hiring_threads(listings: DataFrame, most: int = 2) -> DataFrame:
    """(body) of thread searches, newest first -> (thread_id) of the first ones asking who is hiring, of each payload."""
    hits = F.filter(json_items(F.col("body"), "$.hits"), lambda h: F.lower(F.coalesce(F.get_json_object(h, "$.title"), F.lit(""))).contains("who is hiring"))
    ids = F.filter(F.transform(hits, lambda h: F.get_json_object(h, "$.objectID")), lambda x: x.isNotNull())
    return listings.select(*[c for c in listings.columns if c != "body"], F.explode(F.slice(ids, 1, most)).alias("thread_id"))


#: Of each board the part that tells an endpoint, the configured name, the host and the endpoint of a name.
ENDPOINTS = {
    "greenhouse": ("boards-api.greenhouse.io/v1/boards/", ["$.board_token"], "greenhouse.io", "https://boards-api.greenhouse.io/v1/boards/%s/jobs?content=true"),
    "lever": ("api.lever.co/v0/postings/", ["$.organization", "$.org"], "lever.co", "https://api.lever.co/v0/postings/%s?mode=json"),
    "ashby": ("api.ashbyhq.com/posting-api/job-board/", ["$.board", "$.organization"], "ashbyhq.com", "https://api.ashbyhq.com/posting-api/job-board/%s?includeCompensation=true"),
}


def endpoint(kind: str, url, config) -> Column:
    """The listing's address of a board: the url if it is one, else made of the configured name or that in the url; null without one."""
    url, config = F.col(url) if isinstance(url, str) else url, F.col(config) if isinstance(config, str) else config
    configured = lambda p: F.nullif(F.trim(F.get_json_object(config, p)), F.lit(""))
    if kind == "workday":
        origin = F.regexp_extract(url, r"^(https?://[^/?#:]+)", 1)
        made = F.concat(origin, F.lit("/wday/cxs/"), configured("$.tenant"), F.lit("/"), configured("$.site"), F.lit("/jobs"))
        return F.when(url.contains("/wday/cxs/"), url).otherwise(made)
    known, names, host, address = ENDPOINTS[kind]
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    own = F.when(urls.host(url).endswith(host), F.get(parts, F.lit(0)))
    if kind == "greenhouse":
        at = F.array_position(F.transform(parts, lambda p: F.lower(p)), "boards")
        own = F.coalesce(F.when(at > 0, F.get(parts, at.cast("int"))), own)
    name = F.coalesce(*[configured(p) for p in names], own)
    before, after = address.split("%s")
    return F.when(url.contains(known), url).otherwise(F.concat(F.lit(before), name, F.lit(after)))


def first_board(probes: DataFrame) -> DataFrame:
    """(slug, kind, body) of probed boards -> (slug, kind, jobs, company): of each slug the first of greenhouse, ashby and lever that lists a job."""
    jobs = F.size(F.when(F.col("kind") == "lever", json_items(F.col("body"), "$")).otherwise(json_items(F.col("body"), "$.jobs")))
    order = F.array_position(F.array(*[F.lit(k) for k in ("greenhouse", "ashby", "lever")]), F.col("kind"))
    named = F.when(F.col("kind") == "greenhouse", F.nullif(F.get_json_object("body", "$.jobs[0].company_name"), F.lit("")))
    words = F.transform(F.split("slug", "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30)))
    rows = probes.select("slug", "kind", jobs.alias("jobs"), F.coalesce(named, F.array_join(words, " ")).alias("company"), order.alias("_n")).filter("jobs > 0 and _n > 0")
    return rows.groupBy("slug").agg(F.min_by(F.struct("kind", "jobs", "company"), "_n").alias("b")).select("slug", "b.*")


#: Where the search services have their results, and links that are no results.
SEARCHES = {
    "brave": {"items": "$.web.results", "url": "$.url", "snippet": ["$.description", "$.extra_snippets"]},
    "serper": {"items": "$.organic", "url": "$.link", "snippet": ["$.snippet"]},
    "google_cse": {"items": "$.items", "url": "$.link", "snippet": ["$.snippet"]},
}
NO_RESULT = r"yahoo\.|yimg\.|bing\.com|doubleclick|/search\?"


def search_hits(payloads: DataFrame, kind: str) -> DataFrame:
    """(body) of search services -> at, url, title, snippet, tags taken out of snippets."""
    m = SEARCHES[kind]
    rows = payloads.select(*[c for c in payloads.columns if c != "body"], F.posexplode(json_items(F.col("body"), m["items"])).alias("at", "_i"))
    get = lambda p: F.coalesce(F.get_json_object("_i", p), F.lit(""))
    parts = [F.when(get(p).startswith("["), F.array_join(F.from_json(get(p), "array<string>"), " ")).otherwise(get(p)) for p in m["snippet"]]
    said = F.array_join(F.filter(F.array(*parts), lambda s: s != ""), " ")
    snippet = F.regexp_replace(said, r"<[^>]+>", "") if kind == "brave" else said
    return rows.select(*[c for c in payloads.columns if c != "body"], "at", get(m["url"]).alias("url"), get("$.title").alias("title"), snippet.alias("snippet"))


def markdown_hits(payloads: DataFrame, most: int = 15) -> DataFrame:
    """(body) of result pages in Markdown -> at, url, title, snippet: links without the service's own, unwrapped, each once, `most` of a page."""
    link = r"\[([^\]]{3,200})\]\((https?://[^)\s]+)\)"
    body = F.regexp_replace("body", link, "\u0001$0")
    pieces = F.slice(F.split(body, "\u0001"), 2, 2**30)  # each begins with its link
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\([+\-!().#*_\[\]])", "$1"), r"[*_`#]", ""), r"\s+", " "))

    def hit(p: Column, i: Column) -> Column:
        raw = F.regexp_extract(p, link, 2)
        inner = F.regexp_extract(raw, r"/RU=([^/]+)/", 1)
        rest = F.array_join(F.slice(pieces, i + 1, 2**30), "")
        after = F.substring(F.regexp_replace(rest, "^" + link, ""), 1, 400)
        return F.struct(F.when(inner != "", F.try_url_decode(inner)).otherwise(raw).alias("url"), tidy(F.regexp_extract(p, link, 1)).alias("title"), tidy(F.regexp_replace(after, r"\[[^\]]*\]\([^)]*\)", " ")).alias("snippet"))

    hits = F.filter(F.transform(pieces, hit), lambda h: ~h["url"].rlike(NO_RESULT))
    addresses = F.slice(F.array_distinct(F.transform(hits, lambda h: h["url"])), 1, most)
    once = F.transform(addresses, lambda u: F.get(F.filter(hits, lambda h: h["url"] == u), F.lit(0)))
    kept = [c for c in payloads.columns if c != "body"]
    return payloads.select(*kept, F.posexplode(once).alias("at", "h")).select(*kept, "at", "h.*")


def simple_robots(files: DataFrame) -> DataFrame:
    """(host, body) -> (host, prefix): the Disallow prefixes of the group of all agents, up to a star; comments don't count."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", r"^[^:]*:?", ""))
    rows = lines.select("host", "at", key.alias("k"), value.alias("v")).filter("k in ('user-agent', 'disallow')")
    every = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "k", "v"))).alias("r"))

    def step(s: Column, x: Column) -> Column:
        agent = x["k"] == "user-agent"
        found = F.when(~agent & s["mine"] & (x["v"] != ""), F.concat(s["found"], F.array(x["v"]))).otherwise(s["found"])
        return F.struct(F.when(agent, x["v"] == "*").otherwise(s["mine"]).alias("mine"), found.alias("found"))

    start = F.struct(F.lit(False).alias("mine"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate("r", start, step)["found"]
    return every.select("host", F.explode(found).alias("prefix")).withColumn("prefix", F.regexp_replace("prefix", r"(?s)\*.*$", ""))


def simply_allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, ...) with `allowed`: no prefix of the host begins the path."""
    sets = rules.groupBy("host").agg(F.collect_set("prefix").alias("_p"))
    out = requests.join(sets, "host", "left")
    return out.withColumn("allowed", ~F.coalesce(F.exists("_p", lambda p: F.col("path").startswith(p)), F.lit(False))).drop("_p")


def page_rows(payloads: DataFrame, key: str) -> DataFrame:
    """(key, body, base_url) -> one row a page: jobs (array of RECORD), emails, links, ats (known hosts named), content_hash. A page without postings has none."""
    from tessera.functions import rules

    jobs = json_ld(payloads.select(key, "body", "base_url")).groupBy(key).agg(F.collect_list(F.struct(*[f.name for f in RECORD.fields])).alias("jobs"))
    own = payloads.select(key, emails("body").alias("emails"), urls.links("base_url", "body").alias("links"), rules.ats_markers("body").alias("ats"), F.sha2("body", 256).alias("content_hash"))
    return own.join(jobs, key, "left").withColumn("jobs", F.coalesce("jobs", F.array().cast(T.ArrayType(RECORD))))
