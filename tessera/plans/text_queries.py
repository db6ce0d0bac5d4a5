"""Queries of the text rules over documents, pages and conversations, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules, scoring, text, urls, views
from tessera.operators import evaluate
from tessera.plans.relational_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: DuckDB text of the sentence splitter: RE2 has no look-behind, so a line end is put after the marks.
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n+', E'\n', 'g'), E'\n'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENTENCES}) AS n FROM documents")
def sentence_split_counts(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(text.sentences("text")).cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter({SENTENCES}, lambda s: regexp_matches(s, '(?i)\\b(the|der|die|les)\\b'))[1:3], lambda s: CASE WHEN length(s) > 60 THEN s[1:57] || '...' ELSE s END), ' | ') AS quotes FROM documents")
def evidence_quotes(spark, sf):
    """Up to three sentences that match, clipped, joined."""
    hit = F.slice(F.filter(text.sentences("text"), lambda s: s.rlike(text.js(r"(?i)\b(the|der|die|les)\b"))), 1, 3)
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(hit, lambda s: text.clip(s, 60)), " | ").alias("quotes"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def whitespace_normalise(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.normal_space("text"), 256).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda m: lower(m)))), ',') AS emails FROM documents WHERE text LIKE '%@%'""")
def extract_emails(spark, sf):
    return t(spark, sf, "documents").filter("text like '%@%'").select("doc_id", F.array_join(text.emails("text"), ",").alias("emails"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents WHERE text LIKE '%@%')
SELECT DISTINCT doc_id FROM m WHERE split_part(lower(e), '@', 2) IN ('mail1.example.com', 'mail8.example.com')""")
def email_or_domain_block(spark, sf):
    """Documents whose addresses are blocked by address or by domain."""
    contacts = t(spark, sf, "documents").filter("text like '%@%'").select("doc_id", F.explode(text.emails("text")).alias("email"))
    blocked = spark.createDataFrame([("Mail1.example.com",), ("mail8.example.com",)], "email_or_domain string")
    from tessera.operators.relational import blocked_addresses

    return blocked_addresses(contacts, blocked, "doc_id")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, (length(html) - length(replace(lower(html), 'href', 'hre'))) AS n_href FROM pages""")
def page_title_links(spark, sf):
    title = F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return t(spark, sf, "pages").select("page_id", urls.host("url").alias("host"), title.alias("title"), F.regexp_count(F.lower("html"), F.lit("href")).cast("long").alias("n_href"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def strip_markup(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>", " "), r"<[^>]*>", " ")
    return t(spark, sf, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace(plain, r"\s+", " ")), 256).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(html), 'captcha|verify you are human|access denied|unusual traffic|cloudflare ray id') AND strlen(html) <= 60000 THEN true ELSE false END AS wall,
(CASE WHEN contains(lower(html), 'greenhouse.io') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'lever.co') THEN 1 ELSE 0 END) AS n_markers FROM pages""")
def page_markers(spark, sf):
    marks = F.size(F.filter(rules.ats_markers("html"), lambda m: m.isin("greenhouse.io", "lever.co")))
    return t(spark, sf, "pages").select("page_id", rules.bot_wall("html", F.lit("text/html")).alias("wall"), marks.alias("n_markers"))


@query(r"""SELECT page_id, sha256(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', ' ', 'g'))) || '|' || 'x y' || '|') AS cross_key, sha256(html) AS content_hash FROM pages""")
def content_and_cross_keys(spark, sf):
    return t(spark, sf, "pages").select("page_id", urls.cross_key("url", F.lit(" X--y "), F.lit(None).cast("string")).alias("cross_key"), F.sha2("html", 256).alias("content_hash"))


STOP = "'" + "', '".join("the and to of a in you we with for is our will are on as be this your or an at by from that have".split()) + "'"


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN trim(text) <> '' THEN substring(text, 1, 6000) ELSE '' END AS h FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(h, '\p{{L}}')) AS letters, len(regexp_extract_all(h, '[A-Za-z]')) AS latin, regexp_extract_all(lower(h), '[a-z'']+') AS words FROM d)
SELECT doc_id, CASE WHEN letters = 0 THEN 'english' WHEN latin / letters < 0.6 THEN 'non_english' WHEN len(words) < 15 THEN 'english' WHEN len(list_filter(words, lambda w: w IN ({STOP}))) / len(words) >= 0.08 THEN 'english' ELSE 'non_english' END AS language FROM c""")
def language_gate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", rules.job_language(F.lit(""), "text").alias("language"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'delivery failed|undeliverable|mailbox unavailable|address not found|550 5\.1\.') THEN 'bounce' WHEN regexp_matches(lower(text), 'out of office|automatic reply|auto-reply|vacation responder') THEN 'auto_reply'
WHEN regexp_matches(lower(text), 'unfortunately|not moving forward|decided not to|other candidates|position has been filled|no longer considering') THEN 'negative' ELSE 'positive' END AS reply FROM conversations""")
def reply_class(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", rules.reply_class("text").alias("reply"))


@query(r"""SELECT p_partkey, '"' || replace(CASE WHEN regexp_matches(v, '^[=+\-@]') THEN '''' || v ELSE v END, '"', '""') || '"' AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '=' || p_name WHEN p_partkey % 3 = 1 THEN 'a"' || p_name ELSE p_name END AS v FROM part)""")
def csv_cell_escape(spark, sf):
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('a"'), "p_name")).otherwise(F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", text.csv_cell(v).alias("cell"))


@query("""WITH w AS (SELECT DISTINCT d.doc_id, quality = 1 AS liked, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}')) AS token FROM documents d JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (WHERE quality = 1) AS likes, count(*) FILTER (WHERE quality <> 1) AS dislikes FROM labels JOIN documents USING (doc_id)),
c AS (SELECT token, count(*) FILTER (WHERE liked) AS l, count(*) FILTER (WHERE NOT liked) AS d FROM w WHERE token NOT IN ('the', 'and', 'for', 'with', 'you', 'our', 'are', 'will', 'this', 'that', 'from', 'have', 'your', 'senior', 'staff', 'lead', 'junior', 'engineer', 'engineering', 'software', 'developer', 'team') GROUP BY token)
SELECT token, round(ln((l + 1) / (likes + 2)) - ln((d + 1) / (dislikes + 2)), 6) AS weight FROM c, n WHERE l + d >= 20""")
def preference_logodds(spark, sf):
    """Token weights of the preference model (those of twenty documents or more)."""
    examples = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select((F.col("quality") == 1).alias("liked"), "text")
    seen = examples.select(F.explode(scoring.tokens("text")).alias("token")).groupBy("token").count().filter("count >= 20").select("token")
    return scoring.token_weights(examples).join(seen, "token", "left_semi").select("token", F.round("weight", 6).alias("weight"))


@query("""WITH w AS (SELECT DISTINCT d.doc_id, quality = 1 AS liked, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}')) AS token FROM documents d JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (WHERE quality = 1) AS likes, count(*) FILTER (WHERE quality <> 1) AS dislikes FROM labels JOIN documents USING (doc_id)),
c AS (SELECT token, count(*) FILTER (WHERE liked) AS l, count(*) FILTER (WHERE NOT liked) AS d FROM w WHERE token NOT IN ('the', 'and', 'for', 'with', 'you', 'our', 'are', 'will', 'this', 'that', 'from', 'have', 'your', 'senior', 'staff', 'lead', 'junior', 'engineer', 'engineering', 'software', 'developer', 'team') GROUP BY token)
SELECT token, round(ln((l + 1) / (likes + 2)) - ln((d + 1) / (dislikes + 2)), 6) AS weight FROM c, n""")
def preference_logodds_all(spark, sf):
    """Token weights of the preference model: those of all tokens."""
    examples = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select((F.col("quality") == 1).alias("liked"), "text")
    return scoring.token_weights(examples).select("token", F.round("weight", 6).alias("weight"))


@query("""WITH r AS (SELECT lang, toxic = 1 AS y, regexp_matches(text, '(?i)\\b(idiot|moron|stupid|trash|scum)\\b') AS p FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn,
round(CASE WHEN count(*) FILTER (WHERE p) > 0 THEN count(*) FILTER (WHERE y AND p) / count(*) FILTER (WHERE p) END, 6) AS precision,
round(CASE WHEN count(*) FILTER (WHERE y) > 0 THEN count(*) FILTER (WHERE y AND p) / count(*) FILTER (WHERE y) END, 6) AS recall FROM r GROUP BY GROUPING SETS ((), (lang))""".replace("\\\\b", "\\b"))
def precision_recall_grouped(spark, sf):
    """A word rule against labels: overall and by language."""
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("lang", (F.col("toxic") == 1).alias("label"), F.col("text").rlike(text.js(r"(?i)\b(idiot|moron|stupid|trash|scum)\b")).alias("predicted"))
    return evaluate.metrics(rows, ["lang"]).select("lang", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT k AS skill, n FROM (SELECT 'and' AS k, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\band\\b')) AS n FROM documents UNION ALL SELECT 'und', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bund\\b')) FROM documents
UNION ALL SELECT 'de', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bde\\b')) FROM documents) WHERE n > 0""".replace("\\\\b", "\\b"))
def skill_demand(spark, sf):
    """How many documents match each pattern: all counted in one pass."""
    words = ["and", "und", "de"]
    one = t(spark, sf, "documents").agg(*[F.count_if(F.col("text").rlike(text.js(rf"(?i)\b{w}\b"))).alias(w) for w in words])
    return one.unpivot([], words, "skill", "n").filter("n > 0")


@query("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has, list_contains(['en', 'de'], lang) AS known FROM documents")
def array_membership(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_contains(F.split("text", " "), "the").alias("has"), F.array_contains(F.array(F.lit("en"), F.lit("de")), F.col("lang")).alias("known"))


@query("""SELECT doc_id, CASE WHEN length(text) < 100 THEN 'too short' WHEN lang <> 'en' THEN 'other language' WHEN regexp_matches(text, '[0-9]{13,}') THEN 'long numbers' WHEN text LIKE '%License%' THEN 'licence' END AS reason FROM documents""")
def rule_chain_reason(spark, sf):
    """The first rule that fails gives the reason."""
    x = F.col("text")
    reason = F.when(F.char_length(x) < 100, "too short").when(F.col("lang") != "en", "other language").when(x.rlike("[0-9]{13,}"), "long numbers").when(x.like("%License%"), "licence")
    return t(spark, sf, "documents").select("doc_id", reason.alias("reason"))


@query(r"""WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n+', E'\n', 'g'), E'\n'), lambda s: trim(s)), lambda s: s <> '') AS lines FROM documents), range(1, 100000) r(i) WHERE i <= len(lines)),
k AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '^[•*-]\s+') THEN 'list' WHEN regexp_matches(line, '^#{1,6}\s+') OR (length(line) < 60 AND line LIKE '%:') THEN 'heading' WHEN length(line) > 480 THEN 'long' ELSE 'para' END AS kind FROM l),
n AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = 'list' THEN 0 ELSE 1 END AS opens FROM k)
SELECT doc_id, CAST(sum(CASE WHEN kind = 'list' THEN opens ELSE 0 END) AS BIGINT) AS lists, count(*) FILTER (WHERE kind = 'list') AS items, count(*) FILTER (WHERE kind = 'heading') AS headings,
CAST(sum(CASE kind WHEN 'para' THEN 1 WHEN 'long' THEN (len(regexp_extract_all(line, '[.!?]\s+[A-Z0-9"“(]')) + 3) // 3 ELSE 0 END) AS BIGINT) AS paragraphs FROM n GROUP BY doc_id""")
def jd_blocks(spark, sf):
    """Headings, lists and paragraphs of descriptions."""
    b = views.description_blocks("text")
    rows = t(spark, sf, "documents").select("doc_id", b.alias("b")).filter(F.size("b") > 0)
    count = lambda kind: F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long")
    items = F.aggregate(F.filter("b", lambda x: x["kind"] == "list"), F.lit(0), lambda n, x: n + F.size(x["items"])).cast("long")
    return rows.select("doc_id", count("list").alias("lists"), items.alias("items"), count("heading").alias("headings"), count("para").alias("paragraphs"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 280 THEN text[1:277] || '...' ELSE text END) AS digest FROM documents")
def clip_ellipsis(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.clip("text"), 256).alias("digest"))


@query(r"""SELECT host, page_id AS first_page, n FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, count(*) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS n FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1""")
def stable_url_dedupe(spark, sf):
    """The first page of each host and how many it has."""
    return t(spark, sf, "pages").groupBy(urls.host("url").alias("host")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
