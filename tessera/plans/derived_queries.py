"""Queries of texts, addresses, dates, scores and views over the tables and over what is derived from them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, rules, scoring, text, urls, views
from tessera.functions import vocabulary as V
from tessera.operators import state as S
from tessera.plans.posting_queries import has, many, q
from tessera.plans.relational_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def decoded(x: str) -> str:
    """Named entities in the order of their replacement."""
    for name, value in text.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(value)})"
    return x


@query(f"SELECT doc_id, sha256({decoded("replace(text, '&', '&amp;')")}) AS digest FROM documents")
def entities_decoded(spark, sf):
    """Texts whose e is a numeric entity and whose & is a named one."""
    coded = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("e"), F.lit("&#101;"))
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.decode_entities(coded), 256).alias("digest"))


_SPACE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_GONE = lambda x, p, v: f"regexp_replace({x}, {q(p)}, {v}, 'g')"
_LINES = lambda x, out: f"array_to_string(list_filter(list_transform(string_split({x}, E'\\n'), lambda s: {_SPACE('s')}), lambda s: s NOT IN ({out})), E'\\n')"
_NO_SCRIPT = lambda x, v: _GONE(_GONE(x, r"(?is)<script\b[^>]*>.*?</script>", v), r"(?is)<style\b[^>]*>.*?</style>", v)
_STRIP = _SPACE(decoded(_GONE(_GONE("html", text.BLOCK_TAG, "' '"), "<[^>]*>", "''")))
_BLOCKS = _LINES(decoded(_GONE(_GONE(_GONE(_GONE(decoded("html"), r"(?i)<li\b[^>]*>", "E'\\n• '"), r"(?i)<h[1-6]\b[^>]*>", "E'\\n## '"), text.BLOCK_TAG, "E'\\n'"), "<[^>]*>", "''")), "'', '•', '##'")
_PAGE = _LINES(decoded(_GONE(_GONE(_NO_SCRIPT("html", "' '"), text.BLOCK_TAG, "E'\\n'"), "<[^>]*>", "' '")), "''")
_READ = _NO_SCRIPT("html", "''")
for _p, _v in ((r"(?i)<\s*br\s*/?>", "E'\\n'"), (r"(?i)<\s*/\s*(?:p|div|li|h[1-6]|ul|ol|tr|section)\s*>", "E'\\n'"), (r"(?i)<\s*li[^>]*>", "E'\\n- '"), ("<[^>]*>", "''"), ("<[^>]*$", "''")):
    _READ = _GONE(_READ, _p, _v)
_READ = decoded(_READ)
for _p, _v in ((r"[ \t]+\n", "E'\\n'"), (r"\n{3,}", "E'\\n\\n'"), (r"[ \t]{2,}", "' '"), (r"^\s+|\s+$", "''")):
    _READ = _GONE(_READ, _p, _v)


@query(f"SELECT page_id, sha256({_STRIP}) AS plain, sha256({_BLOCKS}) AS blocks, sha256({_PAGE}) AS page, sha256({_READ}) AS readable FROM pages")
def page_texts(spark, sf):
    """The four ways that markup becomes text."""
    ways = {"plain": text.strip_html, "blocks": text.html_blocks, "page": text.page_text, "readable": text.readable}
    return t(spark, sf, "pages").select("page_id", *[F.sha2(f("html"), 256).alias(k) for k, f in ways.items()])


@query(f"SELECT page_id, {_SPACE("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, CAST(NULL AS VARCHAR) AS site_name, sha256(substring({_PAGE}, 1, 40000)) AS text FROM pages")
def page_records(spark, sf):
    """What a reader sees of each page."""
    return t(spark, sf, "pages").select("page_id", views.page_record("html").alias("r")).select("page_id", "r.title", "r.site_name", F.sha2("r.text", 256).alias("text"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1) || coalesce(substr(regexp_extract(p_name, '^\\S+ (\\S)', 1), 1, 1), '')) AS initials, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, p_name AS composed FROM part")
def part_names(spark, sf):
    """Initials, slugs, and full-width letters composed to plain ones."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    return t(spark, sf, "part").select("p_partkey", text.initials("p_name").alias("initials"), text.slug("p_name").alias("slug"), text.nfkc(F.translate("p_name", plain, wide)).alias("composed"))


_MAILS = "SELECT DISTINCT doc_id, lower(regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), '[.,;:]+$', '')) AS email FROM documents WHERE text LIKE '%@%'"


def mails(spark, sf):
    return t(spark, sf, "documents").filter("text like '%@%'").select("doc_id", F.explode(text.emails("text")).alias("email"))


@query(f"SELECT doc_id, email, email AS plain, email AS linked, length(split_part(email, '@', 1)) <= 64 AND regexp_matches(email, '\\.[a-z]{{2,6}}$') AS plausible FROM ({_MAILS})")
def address_forms(spark, sf):
    """Addresses of documents spelled out and as links come back; whether they are plausible."""
    spelled = F.replace(F.replace("email", F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" (dot) "))
    link = F.concat(F.lit("MAILTO:"), F.replace("email", F.lit("@"), F.lit("%40")), F.lit("?subject=x"))
    return mails(spark, sf).select("doc_id", "email", text.plain_addresses(spelled).alias("plain"), text.mailto(link).alias("linked"), rules.plausible_email("email").alias("plausible"))


@query(f"""WITH e AS ({_MAILS}), x AS (SELECT *, split_part(email, '@', 2) AS host, doc_id % 3 AS k FROM e)
SELECT doc_id, email, CASE WHEN k = 0 THEN 'email_not_evidenced' WHEN k = 1 THEN 'invalid_contact_source' END AS fault, CASE doc_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE 'unverified' END AS verdict,
length(regexp_replace(regexp_extract(host, '([^.]+)\\.[^.]+$', 1), '[^a-z0-9]', '', 'g')) >= 3 AS own FROM x""")
def contact_checks(spark, sf):
    """Faults of contacts, their verdicts, and whether the address is at the company's own domain."""
    k, four = F.col("doc_id") % 3, F.col("doc_id") % 4
    company = F.concat(F.get(F.reverse(F.split(F.split_part("email", F.lit("@"), F.lit(2)), r"\.")), F.lit(1)), F.lit(" Inc"))
    fault = views.contact_fault("email", F.when(k == 1, "http://a.io").otherwise("https://a.io"), F.when(k == 0, "nobody").otherwise(F.concat(F.lit("Mail "), "email")))
    verdict = views.contact_verdict(F.when(four == 0, "2024"), F.when(four == 1, True).when(four == 2, False))
    return mails(spark, sf).select("doc_id", "email", fault.alias("fault"), verdict.alias("verdict"), views.own_domain("email", company).alias("own"))


_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"


@query(f"""WITH x AS (SELECT page_id, page_id % 5 AS k, {_HOST} AS host, url FROM pages) SELECT page_id, CASE k WHEN 0 THEN (1000 + page_id) || '-engineer' WHEN 1 THEN CAST(page_id AS VARCHAR) || 'x' WHEN 2 THEN 'p7' || page_id END AS found,
CASE WHEN page_id % 2 = 0 THEN 'own' || page_id WHEN k = 0 THEN (1000 + page_id) || '-engineer' WHEN k = 1 THEN CAST(page_id AS VARCHAR) || 'x' WHEN k = 2 THEN 'p7' || page_id ELSE 'content:' || sha256('acme|dev|' || trim(regexp_replace(host, '[^a-z0-9]+', ' ', 'g'))) END AS source, k <> 4 AS public FROM x""")
def address_identifiers(spark, sf):
    """Ids in addresses: path segments, query keys, none; what a source falls back on; public hosts."""
    k, n, host = F.col("page_id") % 5, F.col("page_id").cast("string"), urls.host("url")
    address = (
        F.when(k == 0, F.concat(F.lit("https://"), host, F.lit("/jobs/"), (F.col("page_id") + 1000).cast("string"), F.lit("-engineer;")))
        .when(k == 1, F.concat(F.lit("https://"), host, F.lit("/x?a=1&gh_jid="), n, F.lit("x")))
        .when(k == 2, F.concat(F.lit("https://"), host, F.lit("/postings/p7"), n))
        .when(k == 3, F.concat(F.lit("https://"), host, F.lit("/about")))
        .otherwise(F.concat(F.lit("http://localhost/"), n))
    )
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("own"), n)).otherwise(" ")
    rows = t(spark, sf, "pages").withColumn("a", address)
    return rows.select("page_id", urls.identifier("a").alias("found"), urls.source_identifier(own, "a", F.lit("Acme"), F.lit("Dev"), host).alias("source"), urls.is_public("a").alias("public"))


@query(f"""WITH a AS (SELECT page_id, url, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS i, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages),
f AS (SELECT page_id, {_ORIGIN} || href AS url, arg_min({_SPACE("label")}, i) AS label FROM a WHERE href LIKE '/%' GROUP BY ALL)
SELECT page_id, url, label, CASE WHEN regexp_matches(lower(label), 'apply now|apply for') OR lower(label) = 'apply' OR regexp_matches(lower(url), 'application|/apply') THEN 'apply' WHEN regexp_matches(lower(label), 'job|position|opening') OR regexp_matches(lower(url), '/job|/career|gh_jid=') THEN 'job'
WHEN regexp_matches(lower(url), 'greenhouse\\.io|lever\\.co|ashbyhq\\.com|myworkdayjobs\\.com') THEN 'ats' ELSE 'career' END AS kind FROM f""")
def page_links(spark, sf):
    """Every address that a page links to, once with its first label, and its kind."""
    rows = t(spark, sf, "pages").select("page_id", F.explode(urls.links("url", "html")).alias("l")).select("page_id", "l.*")
    return rows.withColumn("kind", rules.link_kind("url", "label"))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^https?:') || '//c.io/z' WHEN 2 THEN {_ORIGIN} || '/z' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+[^?#]*'), '([^/:])/[^/]*$', '\\1') || '/z' END AS joined,
CASE WHEN page_id % 3 = 0 THEN 'api.lever.co/v0/postings/' || page_id ELSE {_HOST} END AS breaker, CASE page_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'rss' ELSE 'workday' END AS reader, regexp_matches(url, {q(V.LISTING_URL)}) AS listing FROM pages""")
def address_uses(spark, sf):
    """Links resolved against their page, what rests together, which reader an address gets, list pages."""
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.col("url")).when(k == 1, "//c.io/z").when(k == 2, "/z").otherwise("z")
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://api.lever.co/v0/postings/"), "page_id", F.lit("?mode=json"))).otherwise(F.col("url"))
    kind = F.col("page_id") % 3
    reader = views.reader_kind(F.when(kind == 0, "Greenhouse"), F.when(kind == 1, "rss"), F.concat(F.lit("https://x.myworkdayjobs.com/"), "page_id"))
    return t(spark, sf, "pages").select("page_id", urls.joined("url", link).alias("joined"), S.breaker_key(address).alias("breaker"), reader.alias("reader"), views.listing_url("url").alias("listing"))


_NOW = "2024-01-30 00:00:00"


@query(f"""SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL ELSE epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) // 1000000 END AS seconds, epoch_us(date_trunc('milliseconds', CAST(ts AS TIMESTAMP))) - 25200000000 AS tolerant_us,
CASE WHEN date_diff('microsecond', CAST(ts AS TIMESTAMP), TIMESTAMP '{_NOW}') < 86400000000 THEN 'Today' WHEN date_diff('microsecond', CAST(ts AS TIMESTAMP), TIMESTAMP '{_NOW}') < 604800000000 THEN 'This week' ELSE 'Older' END AS age,
{many([*V.COUNTRY_ZONES.values(), "UTC"], f"event_id % {len(V.COUNTRY_ZONES) + 1}")} AS zone FROM events""")
def event_dates(spark, sf):
    """Times in six spellings and one that is none, offsets of hours only, ages, zones of countries."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    at = lambda shape: F.date_format(ts, shape)
    later = F.timestamp_micros(F.unix_micros(ts) + 7_200_000_000)
    spelled = (
        F.when(k == 0, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, at("yyyy-MM-dd HH:mm:ss")).when(k == 2, at("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 3, F.concat(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(k == 4, F.unix_seconds(ts).cast("string")).when(k == 5, F.unix_millis(ts).cast("string")).otherwise("soon")
    )
    codes = F.array(F.lit("XX"), F.get(F.array(*[F.lit(c.lower()) for c in V.COUNTRY_ZONES], F.lit("YY")), (F.col("event_id") % (len(V.COUNTRY_ZONES) + 1)).cast("int")))
    return t(spark, sf, "events").select("event_id", F.unix_seconds(dates.parsed(spelled)).alias("seconds"), F.unix_micros(dates.tolerant(at("yyyy-MM-dd HH:mm:ss.SSSSSS'+07'"))).alias("tolerant_us"), dates.age_group(ts, F.lit(_NOW).cast("timestamp")).alias("age"), dates.zone_of(codes).alias("zone"))


_PICK = lambda values, n: many(values, f"{n} % {len(values)}")
_FORM = f"replace(replace(replace({_PICK(V.SEARCH_FORMS, 'n')}, '{{role}}', {_PICK(V.SEARCH_ROLES, 'n')}), '{{place}}', {_PICK(V.SEARCH_PLACES, f'(n // {len(V.SEARCH_ROLES)})')}), '{{phrase}}', {_PICK(V.SEARCH_PHRASES, f'(n // {len(V.SEARCH_ROLES) * len(V.SEARCH_PLACES)})')})"


@query(f"WITH x AS (SELECT event_id, event_id * 7 AS n FROM events) SELECT event_id, {_FORM} AS query, n % 2520 AS turn, n % 2520 + 1 AS next FROM x")
def search_queries(spark, sf):
    """Queries of the search plan by number, and the cursor that goes over them."""
    n = F.col("event_id") * 7
    return t(spark, sf, "events").select("event_id", rules.search_query(n).alias("query"), S.search_turn(n, 630)["query"].alias("turn"), S.search_turn(n, 630)["next"].alias("next"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS s, l_discount * 10 AS f, CASE WHEN l_returnflag <> 'N' THEN l_tax * 10 END AS p, l_linestatus = 'O' AS e, l_returnflag = 'R' AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, least(100.0, floor(s * (0.7 + 0.3 * f) * coalesce(0.6 + 0.4 * p, 1.0) * CASE WHEN e THEN 1.3 ELSE 1.0 END * CASE WHEN n THEN 1.2 ELSE 1.0 END * 10 + 0.5) / 10) AS final, round(coalesce(0.7 * f + 0.3 * p, f), 6) AS blended, round(s * 1000 / 1e6 * 2 + l_linenumber * 100 / 1e6 * 8, 9) AS cost FROM x""")
def line_scores(spark, sf):
    """Final scores, blends of two judges and costs over rows of orders."""
    s, f, p = F.col("l_quantity") * 2, F.col("l_discount") * 10, F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 10)
    final = scoring.final_score(s, f, p, F.col("l_linestatus") == "O", F.col("l_returnflag") == "R")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", final.alias("final"), F.round(scoring.blend(f, p), 6).alias("blended"), F.round(scoring.cost_usd(s * 1000, F.col("l_linenumber") * 100), 9).alias("cost"))


_PCT = "floor(CASE WHEN v <= 1 THEN v * 100 ELSE v END + 0.5)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 ELSE l_quantity * 2 END AS v, l_quantity AS n FROM lineitem), p AS (SELECT *, CAST({_PCT} AS BIGINT) AS p FROM x)
SELECT l_orderkey, l_linenumber, p AS percent, CASE WHEN p >= 75 THEN 'Strong' WHEN p >= 50 THEN 'Partial' ELSE 'Weak' END AS word, CASE WHEN p >= 70 THEN 'good' WHEN p >= 40 THEN 'mid' ELSE 'low' END AS band, 'Agentic focus ' || CASE WHEN p >= 70 THEN 'high' WHEN p >= 40 THEN 'some' ELSE 'low' END AS focus,
least(86400.0, 30 * pow(2, l_linenumber + 5)) AS rest, least(86400.0, 60 * pow(2, greatest(1, l_linenumber))) AS wait FROM p""")
def line_labels(spark, sf):
    """Percentages and their words, rests after failures, waits before the next try."""
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 10).otherwise(F.col("l_quantity") * 2)
    rows = t(spark, sf, "lineitem").withColumn("v", v).withColumn("percent", views.percent("v").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "percent", views.fit_word("percent").alias("word"), views.score_band("percent").alias("band"), views.agentic_label("v").alias("focus"), S.open_circuit(F.col("l_linenumber") + 5, F.lit(False)).alias("rest"), scoring.backoff_seconds("l_linenumber").alias("wait"))


_WORDS = lambda c: f"list_transform(list_filter(parts, lambda x: x.p {c}), lambda x: x.k)"
_JOIN = lambda ks: f"CASE WHEN len({ks}) <= 1 THEN array_to_string({ks}, '') ELSE array_to_string({ks}[1:len({ks}) - 1], ', ') || ' and ' || {ks}[len({ks})] END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, list_filter([{{'k': 'role fit', 'p': CAST(floor(l_discount * 1000 + 0.5) AS BIGINT)}}, {{'k': 'seniority', 'p': CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_tax * 1000 + 0.5) AS BIGINT) END}}, {{'k': 'freshness', 'p': CAST(floor(l_quantity / 50 * 100 + 0.5) AS BIGINT)}}], lambda x: x.p IS NOT NULL) AS parts FROM lineitem),
w AS (SELECT *, {_WORDS(">= 75")} AS strong, {_WORDS("< 50")} AS weak FROM x)
SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' ', CASE WHEN len(strong) > 0 THEN 'Strong on ' || {_JOIN("strong")} || '.' END, CASE WHEN len(weak) > 0 THEN 'Weak on ' || {_JOIN("weak")} || '.' END), ''), 'A middling fit on every part.') AS summary FROM w""")
def line_summaries(spark, sf):
    """A sentence of the strong and weak parts of a score."""
    parts = {"roleFit": F.col("l_discount") * 10, "seniority": F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 10), "freshness": F.col("l_quantity") / 50}
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", views.fit_summary(parts).alias("summary"))


@query("""SELECT p_partkey, upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS label, trim(regexp_replace(p_name || ' Go now 5 # ' || p_brand, '\\s{2,}', ' ', 'g')) AS shown, CASE WHEN p_size >= 30 AND p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'active' ELSE 'candidate' END AS admitted FROM part""")
def part_labels(spark, sf):
    """Names of types for people, quotes without pictographs, admission of found sources."""
    shown = F.concat("p_name", F.lit(" \U0001f680 Go️ now ✨ 5 # "), "p_brand", F.lit(" ❤"))
    admitted = views.admission(F.when(F.col("p_size") >= 30, 0.8).otherwise(0.5), F.col("p_partkey") % 2 == 0, F.when(F.col("p_partkey") % 3 == 0, "other").otherwise("rss"), ["rss", "json"], F.lit(_NOW).cast("timestamp"))
    return t(spark, sf, "part").select("p_partkey", views.humanized(F.lower(F.translate("p_type", " ", "_"))).alias("label"), views.without_pictographs(shown).alias("shown"), admitted["status"].alias("admitted"))


_DRAFT = "text || ' See https://b.io/' || doc_id || CASE doc_id % 3 WHEN 0 THEN ' Can we chat? Remote from Indonesia, available now.' WHEN 1 THEN ' We could meet. Visa sponsorship, notice period 2 weeks.' ELSE ' Thanks.' END"


@query(f"""WITH x AS (SELECT doc_id, {_DRAFT} AS body FROM documents) SELECT doc_id, length('Engineer ' || doc_id) BETWEEN 8 AND 180 AND {has("body", "[0-9]")} AND {has("body", "(?i)(call|chat|meet|conversation|discussion)")} AND {has("body", "(?i)(remote(ly)? from indonesia|relocat|visa sponsorship|work authorization)")} AND {has("body", "(?i)(available|availability|notice period|start date)")} AS valid,
doc_id % 2 = 0 AS grounded FROM x""")
def draft_checks(spark, sf):
    """Whether a letter is complete, and whether its quotes stand in the source."""
    k = F.col("doc_id") % 3
    link = F.concat(F.lit("https://b.io/"), "doc_id")
    tail = F.when(k == 0, " Can we chat? Remote from Indonesia, available now.").when(k == 1, " We could meet. Visa sponsorship, notice period 2 weeks.").otherwise(" Thanks.")
    rows = t(spark, sf, "documents").withColumn("body", F.concat("text", F.lit(" See "), link, tail))
    quote = F.when(F.col("doc_id") % 2 == 0, "SEE  https://b.io/").otherwise("never said anywhere in it")
    return rows.select("doc_id", views.draft_valid(F.concat(F.lit("Engineer "), "doc_id"), "body", link).alias("valid"), views.draft_grounded(F.array(quote), F.lit("see https"), "body", "body", link).alias("grounded"))


@query("""SELECT o_orderkey, CASE WHEN k IN ('network', 'body_too_large') OR (k = 'http' AND (code BETWEEN 500 AND 599 OR code IN (408, 425, 429))) THEN 'retryable' WHEN k IN ('blocked', 'robots_denied') THEN 'blocked' WHEN k IS NOT NULL THEN 'permanent' END AS fault, CASE WHEN o_custkey % 3 = 0 THEN DATE '9999-12-31' WHEN o_custkey % 3 = 1 THEN DATE '2024-01-30' ELSE CAST(o_orderdate AS DATE) END AS due
FROM (SELECT *, ['network', 'http', 'blocked', 'parse', 'body_too_large', NULL, 'robots_denied'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS k, 400 + CAST(o_orderkey % 120 AS INTEGER) AS code FROM orders)""")
def fault_classes(spark, sf):
    """Classes of faults by kind and status, and when paused sources are due."""
    kinds = F.array(*[F.lit(x) for x in ("network", "http", "blocked", "parse", "body_too_large", None, "robots_denied")])
    kind, code = F.get(kinds, (F.col("o_orderkey") % 7).cast("int")), (400 + F.col("o_orderkey") % 120).cast("int")
    three = F.col("o_custkey") % 3
    due = S.paused_until(three == 0, F.when(three == 1, F.to_timestamp(F.lit("9999-12-31"))).otherwise(F.col("o_orderdate").cast("timestamp")), F.lit(_NOW).cast("timestamp"))
    return t(spark, sf, "orders").select("o_orderkey", rules.error_class(kind, code).alias("fault"), F.to_date(due).alias("due"))


#: Result pages made of documents with addresses: a link, the text, another link, an address without a link before it in every fifth.
_RESULT = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<a href=\"https://src' || doc_id || '.io/a?b=1\">x</a>' END || '<p>' || text || '</p><script>var a = \"no@script.io\";</script><a href=\"https://late.io/' || doc_id || '\">y</a> Hire: Ann.Lee@acme.dev, talk <b>now</b> &amp; here.'"
_LISTED = """m AS MATERIALIZED (SELECT doc_id, x, pieces, hits, k FROM (SELECT doc_id, x, string_split_regex(x, {0}) AS pieces, regexp_extract_all(x, {0}) AS hits FROM r), range(1, 100000) g(k) WHERE k <= len(hits)),
{1} AS MATERIALIZED (SELECT doc_id, x, hits[k] AS hit, CAST(list_sum(list_transform(pieces[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda p: length(p))), 0) AS BIGINT) AS start FROM m)"""
_AROUND = "substring(x, greatest(0, start - 400) + 1, start + length(email) + 200 - greatest(0, start - 400))"
for _p in (r"<[^>]+>", r"<[^>]*$", r"^[^<]*>", r"(?i)&[a-z#0-9]+;"):
    _AROUND = f"regexp_replace({_AROUND}, {q(_p)}, ' ', 'g')"


@query(f"""WITH r AS (SELECT doc_id, regexp_replace({_RESULT}, '(?is)<script.*?</script>', ' ', 'g') AS x FROM documents WHERE text LIKE '%@%'), {_LISTED.format(q(views.ADDRESS), "mails")}, {_LISTED.format(q(views.HREF), "links").replace("m AS", "n AS").replace("FROM m)", "FROM n)")},
e AS (SELECT doc_id, x, start, regexp_replace(lower(hit), '\\.+$', '') AS email FROM mails), a AS (SELECT e.doc_id, e.start, any_value(email) AS email, any_value(e.x) AS x, arg_max(regexp_extract(hit, 'href="([^"]+)"', 1), l.start) AS url FROM e LEFT JOIN links l ON l.doc_id = e.doc_id AND l.start + length(l.hit) <= e.start GROUP BY ALL)
SELECT doc_id, start AS at, email, url, md5(trim(regexp_replace({_AROUND}, '\\s+', ' ', 'g'))) AS said FROM a""".replace("\\\\", "\\"))
def mails_and_links(spark, sf):
    """Every address of a page with the link before it and what is said around it."""
    d = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit('<a href="https://src'), d, F.lit('.io/a?b=1">x</a>')))
    page = F.concat(head, F.lit("<p>"), "text", F.lit('</p><script>var a = "no@script.io";</script><a href="https://late.io/'), d, F.lit('">y</a> Hire: Ann.Lee@acme.dev, talk <b>now</b> &amp; here.'))
    rows = t(spark, sf, "documents").filter("text like '%@%'").select("doc_id", F.explode(views.mails_with_links(page)).alias("m"))
    return rows.select("doc_id", F.col("m.at").cast("long").alias("at"), "m.email", "m.url", F.md5("m.window").alias("said"))
