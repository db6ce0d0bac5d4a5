"""Queries of the read side over the test tables, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, scoring
from tessera.operators import relational as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""SELECT n_name, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, CAST(sum(o_totalprice) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_open DESC, n_name LIMIT 10""")
def top_nations_by_open_orders(spark, sf):
    """Counts of orders a nation, the ten with most open ones: pre-aggregated by customer before the joins."""
    own = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.sum("o_totalprice").alias("price"))
    rows = own.join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.sum("open").alias("n_open"), F.round(F.sum("price"), 2).alias("total")).orderBy(F.desc("n_open"), "n_name").limit(10)


SQL["top_nations_by_open_orders"] = SQL["top_nations_by_open_orders"].replace("CAST(sum(o_totalprice) AS DOUBLE)", "round(sum(o_totalprice), 2)")


@query("""SELECT o_orderkey, c_name, o_totalprice, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01') AS total
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01'
ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def list_filtered_page(spark, sf):
    """Optional equality filters, recency, join, order with nulls last, a page with the total."""
    rows = R.filtered(t(spark, sf, "orders"), o_orderstatus="O", o_orderpriority=None).filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    found = R.page(rows, [F.desc_nulls_last("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")], 2, 50)
    return found.join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice", "o_orderdate", "total")


@query("""SELECT CASE WHEN lower(p_type) LIKE '%brass%' THEN 'brass' WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%tin%' THEN 'tin' ELSE 'other' END AS label, count(*) AS n FROM part GROUP BY 1""")
def role_bucket_counts(spark, sf):
    """Ordered pattern buckets and their counts."""
    from tessera.functions.text import first_case

    return t(spark, sf, "part").groupBy(first_case("p_type", [("brass", "(?i)brass"), ("steel", "(?i)steel"), ("tin", "(?i)tin")], "other").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(nullif(n_name, ''), 'Other') AS label, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, label LIMIT 8""")
def country_breakdown(spark, sf):
    """Top groups with a fallback label."""
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.coalesce(F.nullif("n_name", F.lit("")), F.lit("Other")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(8)


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM events) AS events,
(SELECT count(*) FROM events WHERE event_type = 'purchase') AS purchases, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned""")
def conditional_counters(spark, sf):
    """All counters of a dashboard: one pass a table, one row each."""
    o = t(spark, sf, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    e = t(spark, sf, "events").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.countDistinct("user_id").alias("users"))
    return o.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(t(spark, sf, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))))  # one row each


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_status_counts(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def company_source_rollup(spark, sf):
    """Left join with first and last times; the many side is aggregated first."""
    own = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    return t(spark, sf, "customer").select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "first_order", "last_order")


@query("""SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1 WHERE l_returnflag = 'R' AND l_quantity >= 45""")
def four_way_mixed_join(spark, sf):
    lines = t(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45")
    rows = lines.join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t(spark, sf, "nation").filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name")


@query("""SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') o ON o_custkey = c_custkey
WHERE o_custkey IS NULL OR o_orderstatus IN ('P') GROUP BY ALL""")
def left_null_or_status(spark, sf):
    recent = t(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select("o_custkey", "o_orderstatus").distinct()
    return t(spark, sf, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_custkey is null or o_orderstatus in ('P')").select("c_custkey", "c_name").distinct()


@query("""SELECT n_name, count(*) AS n FROM events JOIN nation ON n_nationkey = CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 GROUP BY n_name""")
def json_key_join(spark, sf):
    """A join on a field inside JSON."""
    key = F.get_json_object("props", "$.k").cast("int") % 25
    return t(spark, sf, "events").groupBy(key.alias("k")).agg(F.count("*").alias("c")).join(t(spark, sf, "nation"), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c").alias("n"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def exists_flag_column(spark, sf):
    return R.with_exists(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id", "has_label")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))""")
def nested_semi_anti(spark, sf):
    clean = t(spark, sf, "orders").join(t(spark, sf, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return t(spark, sf, "customer").join(clean, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey, c_name, m.best FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) m ON o_custkey = c_custkey ORDER BY best DESC, c_custkey LIMIT 20""")
def max_score_per_company_topk(spark, sf):
    best = t(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return t(spark, sf, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "best").orderBy(F.desc("best"), "c_custkey").limit(20)


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nest_contacts(spark, sf):
    """Children as an ordered array, shown as text."""
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    out = R.nested(t(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_returnflag"], "c")
    return out.select("o_orderkey", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",").alias("lines"))


@query("""WITH d AS (SELECT CAST(g AS DATE) AS day FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) s(g))
SELECT day, count(event_id) FILTER (WHERE event_type = 'view') AS views, count(event_id) FILTER (WHERE event_type = 'purchase') AS purchases, count(event_id) AS n FROM d LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def dense_daily_series(spark, sf):
    return R.dense_days(t(spark, sf, "events"), "ts", "2023-12-30", "2024-02-02", {"views": F.col("event_type") == "view", "purchases": F.col("event_type") == "purchase", "n": F.lit(True)})


@query("SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_by_zone(spark, sf):
    """Days as a fixed zone has them."""
    return t(spark, sf, "events").groupBy(dates.local_day("ts", "Etc/GMT-7").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, round(sum(value) OVER w, 6) AS spent, sum(value) OVER w <= 1500 AS fits FROM events WINDOW w AS (PARTITION BY date_trunc('month', ts), user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def month_budget(spark, sf):
    """Running cost of a month and user against a cap. Sums are compared to nine digits: what is added up to exactly the cap fits, in whatever order."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.date_trunc("month", "ts"), "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("value").over(w)
    return t(spark, sf, "events").select("user_id", "event_id", F.round(total, 6).alias("spent"), (F.round(total, 9) <= 1500).alias("fits"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_contacts(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase')) AS b, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS c, count(*) FILTER (WHERE event_type = 'purchase') AS d FROM events)
SELECT unnest(['all', 'seen', 'active', 'bought']) AS stage, unnest([a, b, c, d]) AS n FROM c""")
def funnel(spark, sf):
    """Counters of one pass as rows."""
    k = F.col("event_type")
    one = t(spark, sf, "events").agg(F.count("*").alias("all"), F.count_if(k.isin("view", "click", "purchase")).alias("seen"), F.count_if(k.isin("click", "purchase")).alias("active"), F.count_if(k == "purchase").alias("bought"))
    return one.unpivot([], ["all", "seen", "active", "bought"], "stage", "n")


@query("""SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_per_group(spark, sf):
    """The last turn of each conversation: a partial aggregate, not a sort."""
    last = t(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", F.char_length("text").cast("long").alias("n_chars")), "turn").alias("x"))
    return last.select("conv_id", "x.*")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top_n_per_group(spark, sf):
    return R.top_of_groups(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def nearest_previous_row(spark, sf):
    from pyspark.sql import Window

    return t(spark, sf, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous_role"))


@query("""WITH r AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_id, CAST(max(t - k * 3600000000) OVER (PARTITION BY user_id ORDER BY k) + k * 3600000000 AS BIGINT) AS slot_us FROM r""")
def rate_reservation(spark, sf):
    """One slot an hour for each user."""
    from tessera.operators.state import reserve_slots

    rows = t(spark, sf, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return reserve_slots(rows, 3600).select(F.col("host").alias("user_id"), F.col("id").alias("event_id"), F.unix_micros("slot").alias("slot_us"))


@query("""SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def stable_dedupe(spark, sf):
    """The first row of each text: least id by digest."""
    return t(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey LIMIT 100")
def boolean_first_sort(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT source, count(*) AS items, sum(CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END) AS relevant, sum(dup) AS duplicates,
floor(sum(CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END) * 100 / count(*) * 100 + 0.5) / 100 AS relevant_per_100, floor(sum(dup) / count(*) * 100 + 0.5) / 100 AS duplicate_ratio,
CASE WHEN count(*) >= 100 AND sum(dup) / count(*) > 0.07 THEN 'paused' ELSE 'active' END AS action
FROM (SELECT source, n_chars, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 1 ELSE 0 END AS dup FROM documents) GROUP BY source""")
def source_yield_rates(spark, sf):
    """Rates of each source and whether it is worth its work. A copy is a row that is not the first of its text."""
    docs = t(spark, sf, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, "digest")
    out = R.shares(rows, "source", F.lit(1), (F.col("n_chars") >= 2000).cast("int"), (F.col("doc_id") != F.col("first")).cast("int"))
    return out.withColumn("action", scoring.source_action("items", F.lit(1), "duplicates", F.lit(99), 0.0, 0.07, 14.0))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 600000 AS fit, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.7 ELSE 0.5 END AS sw,
CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'P' THEN 0.8 ELSE 0.6 END AS mw, greatest(0, (epoch_us(TIMESTAMP '1998-12-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 86400000000) AS age FROM orders),
f AS (SELECT *, CASE WHEN age <= 30 THEN 1.0 WHEN age <= 365 THEN 0.8 WHEN age <= 1000 THEN 0.5 ELSE 0.3 END AS fw FROM s)
SELECT o_orderkey, floor(greatest(0.0, least(1.0, CAST(1 AS DOUBLE) * greatest(0.0, least(1.0, fit)) * sw * mw * fw * 0.75 * 1.1)) * 100 * 10 + 0.5) / 10 AS score FROM f""")
def weighted_score(spark, sf):
    """Six weights, their product, one digit."""
    rows = t(spark, sf, "orders")
    weights = {"seniority": {"1-URGENT": 1.0, "2-HIGH": 0.9, "3-MEDIUM": 0.7}, "modeVisa": {"remote_global": 1.0, "remote_apac": 0.8, "sponsor_unknown": 0.6}, "freshnessDays": [(30, 1.0), (365, 0.8), (1000, 0.5)]}
    scope = F.when(F.col("o_orderstatus") == "O", "remote_global").when(F.col("o_orderstatus") == "P", "remote_apac").otherwise("onsite")
    score = scoring.job_score(F.col("o_totalprice") / 600000, F.col("o_orderpriority"), scope, F.lit("unknown"), F.col("o_orderdate").cast("timestamp"), F.lit(0.75), F.lit(1.1), F.lit("1998-12-01").cast("timestamp"), weights)
    return rows.select("o_orderkey", score["score"].alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'not_approved' WHEN o_orderstatus = 'F' THEN 'job_closed' WHEN o_orderstatus = 'P' THEN 'job_unverified'
WHEN c_acctbal < 0 THEN 'invalid_contact' WHEN c_mktsegment = 'MACHINERY' THEN 'do_not_contact' WHEN rn > 1 THEN 'duplicate_outreach' ELSE 'ok' END AS code
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) JOIN customer ON o_custkey = c_custkey""")
def send_gate(spark, sf):
    """The first check of a send that fails."""
    from pyspark.sql import Window

    rows = t(spark, sf, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "approved").otherwise("draft")
    job = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "unverified").otherwise("targeted")
    code = scoring.send_gate(status, job, F.col("c_name"), F.when(F.col("c_acctbal") < 0, F.lit(1)), F.col("c_mktsegment") == "MACHINERY", F.col("rn") > 1, F.lit(0), F.lit(20))
    return rows.select("o_orderkey", code.alias("code"))


@query("""WITH u AS (SELECT user_id, 1 + user_id % 3 AS tier, count(*) FILTER (WHERE event_type = 'purchase') AS relevant, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE value > 20) / count(*) AS success FROM events GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN relevant > 0 AND success >= 0.9 AND failures = 0 THEN CASE WHEN tier = 3 THEN 2 ELSE 1 END WHEN failures >= 3 OR success < 0.5 THEN CASE WHEN tier = 1 THEN 2 ELSE 3 END ELSE tier END AS BIGINT) AS new_tier,
CAST(CASE tier WHEN 1 THEN 90 WHEN 2 THEN 50 ELSE 10 END AS INTEGER) AS priority FROM u""")
def tier_adjust(spark, sf):
    k = F.col("event_type")
    u = t(spark, sf, "events").groupBy("user_id").agg(F.count_if(k == "purchase").alias("relevant"), F.count_if(k == "error").alias("failures"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("success"))
    u = u.withColumn("tier", (1 + F.col("user_id") % 3).cast("int"))
    return u.select("user_id", scoring.adjusted_tier("tier", "relevant", "failures", "success").cast("long").alias("new_tier"), scoring.queue_priority("tier", F.lit("closed_check")).alias("priority"))
