"""Queries of what a page says of who hires, of a reader's desk, and of logs and files, over the tables; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import dates, scoring, text, views
from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.plans.derived_queries import _MAILS, mails
from tessera.plans.relational_queries import t
from tessera.shared import shared_dir
from tessera.sources import sinks, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""WITH x AS (SELECT p_partkey, p_partkey % 4 AS k, upper(substr(p_brand, 1, 1)) || lower(regexp_replace(substr(p_brand, 2), '[^A-Za-z]', '', 'g')) AS w, p_name FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN w || ' Engineer' WHEN 1 THEN w || ' and Data Architect' WHEN 2 THEN trim(p_name) ELSE trim(p_name) || ' wanted' END AS title FROM x""")
def hired_roles(spark, sf):
    """Titles of pages made of parts: two that name a role, two whose title has a site's name behind or before it."""
    k, brand = F.col("p_partkey") % 4, F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.regexp_replace(F.substring("p_brand", 2, 100), "[^A-Za-z]", "")))
    body = F.when(k == 0, F.concat(F.lit("Hello! We are hiring a new "), brand, F.lit(" Engineer, and one Developer."))).when(k == 1, F.concat(F.lit("open positions: "), brand, F.lit(" and Data Architect"))).otherwise("Nothing of note; an engineer.")
    title = F.when(k == 2, F.concat("p_name", F.lit(" | LinkedIn jobs"))).when(k == 3, F.concat(F.lit("Ann Lee on linkedin: "), "p_name", F.lit(" wanted - X"))).otherwise("p_name")
    return t(spark, sf, "part").select("p_partkey", views.role_title(body, title).alias("title"))


@query(f"""WITH m AS ({_MAILS}), x AS (SELECT doc_id, email, doc_id % 2 = 0 AS free, doc_id % 3 AS k, split_part(email, '@', 2) AS mailed, 'site' || doc_id || '.example.org' AS host FROM m),
d AS (SELECT *, CASE WHEN NOT free THEN mailed WHEN k < 2 THEN host END AS domain FROM x), l AS (SELECT *, string_split(coalesce(domain, 'm.linkedin.com'), '.') AS parts FROM d)
SELECT doc_id, email, domain, CASE WHEN k = 1 THEN 'Works of ' || doc_id ELSE upper(substr(parts[-2], 1, 1)) || substr(parts[-2], 2) END AS name FROM l""")
def hiring_companies(spark, sf):
    """Who hires, for each address of a document: even documents write from a free mail service, each third page is a social site's."""
    k, free = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    email = F.when(free, F.concat(F.split_part("email", F.lit("@"), F.lit(1)), F.lit("@GMail.com"))).otherwise(F.col("email"))
    url = F.when(k == 2, "https://m.linkedin.com/posts/1").otherwise(F.concat(F.lit("https://www.site"), "doc_id", F.lit(".example.org/jobs/1?q=a")))
    site = F.when(k == 2, "LinkedIn").when(k == 1, F.concat(F.lit("Works of "), "doc_id"))
    return mails(spark, sf).select("doc_id", "email", views.hiring_company(site, email, url).alias("c")).select("doc_id", "email", "c.domain", "c.name")


@query("""WITH x AS (SELECT event_id, ts + INTERVAL 7 HOUR AS here, ts FROM events), n AS (SELECT TIMESTAMP '2024-01-20 03:00:00' AS now)
SELECT event_id, CASE WHEN hour(here) < 5 THEN 'Working late' WHEN hour(here) < 12 THEN 'Good morning' WHEN hour(here) < 18 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting,
CASE WHEN CAST(here AS DATE) >= CAST(now + INTERVAL 7 HOUR AS DATE) THEN 'Today' WHEN ts > now - INTERVAL 7 DAY THEN 'This week' ELSE 'Older' END AS age FROM x, n""")
def greetings(spark, sf):
    """How a reader is met at each event's time in a fixed zone, and its age there."""
    now = F.lit("2024-01-20 03:00:00").cast("timestamp")
    return t(spark, sf, "events").select("event_id", dates.greeting("ts", "Etc/GMT-7").alias("greeting"), dates.age_group(F.col("ts").cast("timestamp"), now, "Etc/GMT-7").alias("age"))


_N = lambda n, one, more: f"{n} || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {more}' END"


@query(f"""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS r, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'view') AS f, count(*) FILTER (event_type = 'click') AS w FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN r > 0 AND a > 0 THEN {_N("r", "reply", "replies")} || ' in, and ' || a || ' sent this week. Keep going.' WHEN f > 0 THEN {_N("f", "fresh role", "fresh roles")} || ' landed in the last 72 hours.'
WHEN a > 0 THEN {_N("a", "application", "applications")} || ' out this week. Keep the streak.' WHEN w > 0 THEN w || ' targets are waiting. Pick the best one and draft an email.' ELSE 'The scout is out looking. New roles will show up here.' END AS said FROM c""")
def motivations(spark, sf):
    """A sentence of each user's counts of a day."""
    kinds = {"replied": "signup", "applied": "purchase", "fresh": "view", "waiting": "click"}
    counts = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
    return counts.select("user_id", "day", views.motivation("replied", "applied", "fresh", "waiting").alias("said"))


@query("""SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 5 = 1 THEN 'applied' ELSE o_orderstatus END AS status FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 97 = 0)""")
def acted_targets(spark, sf):
    """Orders as targets once every fifth is applied to and each 97th is blacklisted, with all of its customer's."""
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("status"))
    action = F.when(F.col("id") % 97 == 0, "blacklist").when(F.col("id") % 5 == 1, "applied")
    changes = rows.select("id", action.alias("action"), F.array(F.lit("status")).alias("set"), F.lit("applied").alias("status")).filter("action is not null")
    return S.after_action(rows, changes, ["status"])


@query("""SELECT conv_id, count(*) AS calls, count(DISTINCT turn) AS turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS tokens, round(sum(CASE WHEN role = 'user' THEN length(coalesce(text, '')) * 2.0 ELSE length(coalesce(text, '')) * 8.0 END) / 1e6, 9) AS cost FROM conversations GROUP BY conv_id""")
def logged_usage(spark, sf):
    """A usage log of conversations in two batches, of which one is written twice: calls, tokens and cost of each conversation."""
    size, user = F.char_length(text.text("text")), F.col("role") == "user"
    calls = t(spark, sf, "conversations").select(F.lit("m1").alias("model"), F.col("role").alias("purpose"), F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.when(user, size).otherwise(0).alias("tokens_in"), F.when(user, 0).otherwise(size).alias("tokens_out"), (F.col("conv_id") % 2).alias("batch"))
    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    for batch in (0, 1, 0):
        sinks.append_batch(sinks.usage_rows(calls.filter(F.col("batch") == batch)), path, batch)
    log = sinks.logged(spark, path).withColumns({"conv_id": F.split_part("request_id", F.lit("-"), F.lit(1)).cast("long"), "turn": F.split_part("request_id", F.lit("-"), F.lit(2))})
    return log.groupBy("conv_id").agg(F.count("*").alias("calls"), F.countDistinct("turn").alias("turns"), F.sum(F.col("tokens_in") + F.col("tokens_out")).cast("long").alias("tokens"), F.round(F.sum("cost_usd"), 9).alias("cost"))


@query(f"""SELECT d.artifact, coalesce(array_to_string(list_sort(list(DISTINCT m.email) FILTER (m.email IS NOT NULL)), ','), '') AS emails FROM (SELECT doc_id, doc_id // 8 AS artifact FROM documents) d LEFT JOIN ({_MAILS}) m ON d.doc_id = m.doc_id GROUP BY d.artifact""")
def emails_of_artifacts(spark, sf):
    """Sorted distinct addresses of every eight documents, as a crawl's artifact holds eight postings."""
    rows = t(spark, sf, "documents").select(F.expr("doc_id div 8").alias("artifact"), text.emails("text").alias("found"))
    return R.artifact_emails(rows, "artifact", "found").select("artifact", F.array_join("emails", ",").alias("emails"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2.0, 0) AS INTEGER) AS half FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') OR l_orderkey IN (1, 2, 3)""")
def listed_lines(spark, sf):
    """Lines of urgent orders, by a table of keys, and of three more, by a list; half their quantity as a whole number, halves to the even one."""
    lines = t(spark, sf, "lineitem")
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    both = R.listed(lines, "l_orderkey", urgent).unionAll(R.without_overlap(R.listed(lines, "l_orderkey", [1, 2, 3, None]), urgent, "l_orderkey").select(lines.columns))
    return both.select("l_orderkey", "l_linenumber", scoring.whole(F.col("l_quantity") / 2).alias("half"))


@query("SELECT c_custkey // 100 AS block, sha256(string_agg(c_name || ' ' || c_mktsegment, E'\\n' ORDER BY c_custkey) || E'\\n') AS digest, CAST(NULL AS VARCHAR) AS error FROM customer GROUP BY 1")
def text_files(spark, sf):
    """Text files of a hundred customers each, written, and read back whole."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    rows = t(spark, sf, "customer").select(F.expr("c_custkey div 100").alias("block"), "c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"))
    rows.repartition("block").sortWithinPartitions("block", "c_custkey").select("block", "value").write.partitionBy("block").text(path)
    return texts.whole_texts(spark, path).select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("long").alias("block"), F.sha2("text", 256).alias("digest"), "error")
