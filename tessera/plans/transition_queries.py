"""Queries of the state transitions, lists and counters over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import views
from tessera.operators import judging, scan
from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.plans.posting_queries import SQL as POSTING_SQL
from tessera.plans.posting_queries import postings
from tessera.plans.relational_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


NOW = "1998-07-29 00:00:00"
MICROS = f"epoch_us(TIMESTAMP '{NOW}')"


def now():
    return F.lit(NOW).cast("timestamp")


def suppliers(spark, sf):
    """Suppliers as sources: some with failures, some at rest."""
    rested = F.when(F.col("s_suppkey") % 5 == 0, F.lit("1998-07-01").cast("timestamp"))
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 3).cast("int").alias("fail_count"), rested.alias("blocked_until"), F.when(F.col("s_suppkey") % 3 > 0, "old").alias("last_error"))


_SOURCES = "s AS (SELECT s_suppkey AS id, s_nationkey AS company_id, CAST(s_suppkey % 3 AS INTEGER) AS fail_count, CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '1998-07-01' END AS until, CASE WHEN s_suppkey % 3 > 0 THEN 'old' END AS last_error FROM supplier)"


@query(f"""WITH {_SOURCES}, f AS (SELECT l_suppkey AS id, count(*) AS n, bool_or(l_linenumber = 7) AS b, max('line ' || l_linenumber) AS e FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 40 = 0 GROUP BY 1)
SELECT s.id, CAST(s.fail_count + coalesce(n, 0) AS BIGINT) AS fail_count, CASE WHEN n IS NOT NULL AND (s.fail_count + n >= 3 OR b) THEN {MICROS} + 86400000000 ELSE epoch_us(until) END AS until_us, coalesce(e, last_error) AS last_error FROM s LEFT JOIN f USING (id)""")
def failing_sources(spark, sf):
    """Returned lines as failed crawls of their supplier: counts, rests, last errors."""
    failures = t(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_orderkey % 40 = 0").select(F.col("l_suppkey").alias("id"), (F.col("l_linenumber") == 7).alias("blocked"), F.concat(F.lit("line "), "l_linenumber").alias("error"))
    return S.source_failures(suppliers(spark, sf), failures, now()).select("id", F.col("fail_count").cast("long").alias("fail_count"), F.unix_micros("blocked_until").alias("until_us"), "last_error")


@query(f"WITH {_SOURCES}, ok AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_orderkey % 50 = 0) SELECT s.id, CASE WHEN ok.id IS NULL THEN fail_count ELSE 0 END AS fail_count, CASE WHEN ok.id IS NULL THEN epoch_us(until) END AS until_us, CASE WHEN ok.id IS NULL THEN last_error END AS last_error FROM s LEFT JOIN ok USING (id)")
def answering_sources(spark, sf):
    """Failures are forgotten once a source answers."""
    done = t(spark, sf, "lineitem").filter("l_orderkey % 50 = 0").select(F.col("l_suppkey").alias("id"))
    return S.source_successes(suppliers(spark, sf), done).select("id", "fail_count", F.unix_micros("blocked_until").alias("until_us"), "last_error")


@query("""WITH e AS (SELECT s_nationkey AS id, bool_and(s_acctbal > 0) AS ok, bool_or(s_suppkey % 7 = 0) AS blocked FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT n_nationkey AS id, CASE WHEN e.id IS NULL THEN 'unknown' WHEN ok THEN 'ok' WHEN blocked THEN 'blocked' ELSE 'failing' END AS health FROM nation LEFT JOIN e ON e.id = n_nationkey""")
def nation_health(spark, sf):
    """Health of nations by the last word of their suppliers."""
    nations = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit("unknown").alias("health"))
    ends = t(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("ok"), (F.col("s_suppkey") % 7 == 0).alias("blocked"))
    return S.company_health(nations, suppliers(spark, sf), ends)


@query(f"""WITH s AS (SELECT l_partkey AS job_id, l_suppkey AS source_id, max('o' || l_orderkey) AS url FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_partkey AS job_id, l_suppkey AS source_id, arg_max('n' || l_orderkey, l_orderkey * 10 + l_linenumber) AS url FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(s.job_id, b.job_id) AS job_id, coalesce(s.source_id, b.source_id) AS source_id, coalesce(b.url, s.url) AS url, CASE WHEN b.url IS NOT NULL THEN {MICROS} ELSE 0 END AS seen_us FROM s FULL JOIN b ON s.job_id = b.job_id AND s.source_id = b.source_id""")
def part_sightings(spark, sf):
    """Where parts were seen: the last address of each part and supplier."""
    lines = t(spark, sf, "lineitem")
    old = lines.filter("l_orderkey % 2 = 0").groupBy(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("source_id")).agg(F.max(F.concat(F.lit("o"), "l_orderkey")).alias("url")).withColumn("seen_at", F.timestamp_seconds(F.lit(0)))
    new = lines.filter("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("source_id"), F.concat(F.lit("n"), "l_orderkey").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return S.upsert_sightings(old, new, now()).select("job_id", "source_id", "url", F.unix_micros("seen_at").alias("seen_us"))


_JOBS = f"""j AS (SELECT o_orderkey AS id, ['new', 'targeted', 'pending_judge', 'sent', 'unverified'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS status, o_custkey % 2 = 0 AS verified, o_orderkey % 11 = 0 AS needs_rescore, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '{NOW}' END AS closed_at, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS posted_at,
TIMESTAMP '1995-01-01' AS first_seen_at, TIMESTAMP '{NOW}' + to_minutes(CAST(o_orderkey % 4 - 2 AS INTEGER)) AS next_judge_at, o_totalprice AS score FROM orders)"""


def jobs(spark, sf):
    k = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(x) for x in ("new", "targeted", "pending_judge", "sent", "unverified")]), (k % 5).cast("int"))
    return t(spark, sf, "orders").select(
        k.alias("id"), status.alias("status"), F.lit(None).cast("string").alias("skip_reason"), (F.col("o_custkey") % 2 == 0).alias("verified"), (k % 11 == 0).alias("needs_rescore"), F.when(F.col("o_orderstatus") == "P", now()).alias("closed_at"), F.when(k % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("posted_at"),
        F.lit("1995-01-01").cast("timestamp").alias("first_seen_at"), S.plus_seconds(now(), (k % 4 - 2) * 60).alias("next_judge_at"), F.col("o_totalprice").alias("score"),
    )


@query(f"""WITH {_JOBS} SELECT id FROM j WHERE closed_at IS NULL AND next_judge_at <= TIMESTAMP '{NOW}' AND (status IN ('new', 'unverified', 'pending_judge') OR (status = 'targeted' AND (NOT verified OR needs_rescore))) ORDER BY needs_rescore DESC, coalesce(posted_at, first_seen_at) DESC, id LIMIT 25""")
def judging_queue(spark, sf):
    """The 25 jobs to judge next."""
    return S.judge_queue(jobs(spark, sf), now()).select("id")


@query(f"""WITH {_JOBS} SELECT id, CASE WHEN id % 6 = 0 THEN 'pending_judge' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 'budget' END AS skip_reason, CASE WHEN id % 6 IN (0, 1) THEN {MICROS} + 60000000 * (id % 6 * 15 + 60) ELSE epoch_us(next_judge_at) END AS at_us FROM j""")
def parked_jobs(spark, sf):
    """Jobs that wait for their next judgement, with and without a reason."""
    k = F.col("o_orderkey") % 6
    wait = t(spark, sf, "orders").filter(k < 2).select(F.col("o_orderkey").alias("id"), F.when(k == 0, "pending_judge").alias("status"), F.when(k == 0, "budget").alias("reason"), (k * 15 + 60).alias("minutes"))
    return S.park(jobs(spark, sf), wait, now()).select("id", "status", "skip_reason", F.unix_micros("next_judge_at").alias("at_us"))


@query("""SELECT o_custkey AS job_id, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'like' ELSE 'dislike' END, o_orderkey) AS verdict, max(o_orderkey) AS at FROM orders GROUP BY 1""")
def latest_feedback(spark, sf):
    """The last verdict of each customer, the old and the new ones merged."""
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "like").otherwise("dislike").alias("verdict"), F.col("o_orderkey").alias("at"))
    old = rows.filter("at % 2 = 0").groupBy("job_id").agg(F.max_by(F.struct("verdict", "at"), "at").alias("v")).select("job_id", "v.*")
    return S.upsert_feedback(old, rows.filter("at % 2 = 1"))


@query("""WITH e AS (SELECT 'company:' || lower(c_name) AS email_or_domain, 'old' AS reason FROM customer WHERE c_custkey % 10 = 0), n AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 1 THEN 'c' || c_custkey || '.io' ELSE 'company:' || lower(c_name) END AS k FROM customer WHERE c_acctbal < 0)
SELECT * FROM e UNION ALL SELECT k, 'Blacklisted from dashboard' FROM n WHERE k NOT IN (SELECT email_or_domain FROM e)""")
def never_contacted(spark, sf):
    """Customers in debt join those that are never contacted."""
    c = t(spark, sf, "customer")
    entries = c.filter("c_custkey % 10 = 0").select(F.concat(F.lit("company:"), F.lower("c_name")).alias("email_or_domain"), F.lit("old").alias("reason"))
    ruled_out = c.filter("c_acctbal < 0").select(F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("c"), "c_custkey", F.lit(".io"))).alias("domain"))
    return S.do_not_contact(entries, ruled_out)


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'paused' WHEN 1 THEN NULL ELSE 'active' END AS status, CASE s_suppkey % 4 WHEN 1 THEN NULL WHEN 2 THEN 'new' ELSE s_name END AS error FROM supplier")
def patched_sources(spark, sf):
    """Patches that set a status, two nulls, an error, or nothing."""
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("active").alias("status"), F.col("s_name").alias("error"))
    k = F.col("id") % 4
    named = F.when(k == 0, F.array(F.lit("status"))).when(k == 1, F.array(F.lit("status"), F.lit("error"))).otherwise(F.array(F.lit("error")))
    patch = rows.filter(k < 3).select("id", named.alias("set"), F.when(k == 0, "paused").alias("status"), F.when(k == 2, "new").alias("error"))
    return S.patched(rows, patch, "id", ["status", "error"])


@query("""SELECT user_id AS id, CAST(sum(1 + event_id % 3) AS BIGINT) + CASE WHEN user_id % 2 = 0 THEN 100 ELSE 0 END AS items_seen, count(*) FILTER (WHERE event_type = 'purchase') AS relevant_jobs, count(*) FILTER (WHERE event_id % 4 = 0) AS duplicate_jobs, count(*) FILTER (WHERE event_id % 5 = 0) AS failures,
CASE WHEN user_id % 2 = 0 THEN 0 ELSE min(event_id) END AS first_yield_at, max(event_id) AS last_yield_at FROM events GROUP BY user_id""")
def user_yields(spark, sf):
    """Counters of users that events add to."""
    e = t(spark, sf, "events")
    zero = [F.lit(0).cast("long").alias(c) for c in ("relevant_jobs", "duplicate_jobs", "failures")]
    stats = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct().select("id", F.lit(100).cast("long").alias("items_seen"), *zero, F.lit(0).cast("long").alias("first_yield_at"), F.lit(0).cast("long").alias("last_yield_at"))
    k = F.col("event_id")
    more = e.select(F.col("user_id").alias("id"), (1 + k % 3).alias("items"), F.when(F.col("event_type") == "purchase", 1).alias("relevant"), (k % 4 == 0).alias("duplicate"), (k % 5 == 0).alias("failed"), k.alias("at"))
    return S.yield_stats(stats, more)


@query("SELECT 'k' || s_suppkey AS seed_key, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'paused' ELSE 'candidate' END AS status FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 > 0")
def seeded_sources(spark, sf):
    """A seed laid over known sources, twice."""
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("seed_key"), "s_name", "s_suppkey")
    seed = rows.filter("s_suppkey % 3 > 0").select("seed_key", F.col("s_name").alias("name"), F.lit("candidate").alias("status"))
    known = rows.filter("s_suppkey % 2 = 0").select("seed_key", F.lit("old").alias("name"), F.lit("paused").alias("status"))
    return S.seeded(S.seeded(known, seed), seed)


@query("""WITH s AS (SELECT user_id AS id, CAST(1 + user_id % 3 AS INTEGER) AS tier, max(CAST(ts AS TIMESTAMP)) AS a, max(CAST(ts AS TIMESTAMP)) + to_hours(CAST(user_id % 7 - 3 AS INTEGER)) AS b, user_id % 10 = 0 AS rests FROM events GROUP BY user_id),
d AS (SELECT * FROM s WHERE NOT rests AND (a <= TIMESTAMP '2024-01-30 12:00:00' OR b <= TIMESTAMP '2024-01-30 12:00:00') ORDER BY tier, least(a, b), id LIMIT 50), k AS (SELECT id, tier, 'crawl' AS kind, a AS due FROM d UNION ALL SELECT id, tier, 'closed_check', b FROM d)
SELECT kind || ':' || id || ':' || strftime(due, '%Y-%m-%dT%H:%M:%S') AS dedupe_key, kind, id AS source_id, CASE tier WHEN 1 THEN 100 WHEN 2 THEN 60 ELSE 20 END - CASE WHEN kind = 'closed_check' THEN 10 ELSE 0 END AS priority FROM k WHERE due <= TIMESTAMP '2024-01-30 12:00:00'""")
def scheduled_tasks(spark, sf):
    """Crawls and checks for closed postings that are due, of the fifty first users."""
    seen = t(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("a"))
    at = F.lit("2024-01-30 12:00:00").cast("timestamp")
    u = F.col("user_id")
    rows = seen.select(u.alias("id"), (1 + u % 3).cast("int").alias("tier"), F.col("a").alias("next_due_at"), S.plus_seconds(F.col("a"), (u % 7 - 3) * 3600).alias("closed_due_at"), F.when(u % 10 == 0, F.lit("2030-01-01").cast("timestamp")).alias("blocked_until"))
    return S.schedule(rows, at, 50).select("dedupe_key", "kind", "source_id", "priority")


@query("""WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'h' || user_id || '.io' ELSE 'api.lever.co/v0/postings/u' || user_id END AS key, CAST(ts AS TIMESTAMP) AS t, event_type = 'purchase' AS ok, event_id % 9 = 0 AS blocked FROM events),
o AS (SELECT key, max(t) FILTER (WHERE ok) AS last FROM e GROUP BY key), b AS (SELECT key, count(*) AS streak, max(t) AS t, arg_max(blocked, t) AS blocked FROM e JOIN o USING (key) WHERE NOT ok AND (last IS NULL OR t > last) GROUP BY key)
SELECT key, streak, epoch_us(t) + 1000000 * CAST(CASE WHEN blocked THEN greatest(900, least(86400.0, 30 * pow(2, streak))) ELSE least(86400.0, 30 * pow(2, streak)) END AS BIGINT) AS rests_us FROM b""")
def resting_hosts(spark, sf):
    """Events as requests: failures since the last success, and until when a host rests."""
    u = F.col("user_id").cast("string")
    url = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("https://h"), u, F.lit(".io/x"))).otherwise(F.concat(F.lit("https://api.lever.co/v0/postings/u"), u))
    ends = t(spark, sf, "events").select(url.alias("url"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 9 == 0).alias("blocked"))
    return S.circuits(ends).select("key", "streak", F.unix_micros("rests_until").alias("rests_us"))


_OUT = f"""o AS (SELECT o_orderkey AS id, o_custkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'followup' ELSE 'initial' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'scheduled' ELSE 'draft' END AS status, CAST(o_orderdate AS TIMESTAMP) AS sent_at FROM orders)"""


def outreach(spark, sf):
    k = F.col("o_orderstatus")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderkey") % 4 == 0, "followup").otherwise("initial").alias("kind"), F.when(k == "F", "sent").when(k == "O", "scheduled").otherwise("draft").alias("status"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))


@query(f"""WITH {_OUT} SELECT 'drafts' AS tab, id FROM o WHERE status = 'draft' UNION ALL SELECT 'queue', id FROM o WHERE status = 'scheduled' AND kind = 'followup' UNION ALL
SELECT 'due', id FROM o WHERE kind = 'initial' AND status = 'sent' AND sent_at <= TIMESTAMP '{NOW}' - INTERVAL 6 DAY AND job_id NOT IN (SELECT job_id FROM o WHERE kind = 'followup')""")
def outreach_tabs(spark, sf):
    """Orders as letters: drafts, follow-ups that wait, first letters without an answer."""
    rows = outreach(spark, sf)
    tab = lambda name, **more: R.tab(rows, {"queue": "scheduled", "due": "followup_due"}.get(name, name), now(), **more).select(F.lit(name).alias("tab"), "id")
    return tab("drafts").unionAll(tab("queue", kind="followup")).unionAll(tab("due"))


@query(f"""WITH {_OUT} SELECT (SELECT count(*) FROM o WHERE CAST(sent_at + INTERVAL 7 HOUR AS DATE) = DATE '1998-07-29') AS sent_today, (SELECT count(*) FROM o WHERE status = 'scheduled') AS depth, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS live, (SELECT count(*) FROM nation WHERE n_nationkey % 3 > 0) AS failing,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS posted, greatest((SELECT max(n) FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS n FROM orders GROUP BY o_orderdate)), 1) AS top""")
def board_counts(spark, sf):
    """The counters of the front page, one row."""
    rows = outreach(spark, sf)
    depth = R.queue_depth(rows.withColumn("status", F.when(F.col("status") == "scheduled", "queued").otherwise(F.col("status"))))
    live = views.live_and_failing(t(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 0, "active").otherwise("paused").alias("status")), t(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "ok").when(F.col("n_nationkey") % 3 == 1, "failing").alias("health")))
    daily = t(spark, sf, "orders").groupBy("o_orderdate").agg(F.count_if(F.col("o_orderstatus") == "P").alias("discovered"), F.lit(0).alias("targeted"))
    one = views.sent_today(rows, now(), "Etc/GMT-7")
    for more in (depth, live, views.week_totals(daily).select("posted", "top")):
        one = one.crossJoin(more)  # each is one row
    return one


@query(f"""WITH {_JOBS}, x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n, coalesce(posted_at, first_seen_at) AS t FROM j WHERE status NOT IN ('closed', 'skipped', 'blacklisted')), d AS (SELECT *, CASE WHEN t > TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 'Today' WHEN t > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'This week' ELSE 'Older' END AS g FROM x)
SELECT g AS "group", count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY n)) AS ids FROM d GROUP BY g""")
def targets_in_groups(spark, sf):
    """The list of targets by age, best first."""
    ranked = scan.running_sums(jobs(spark, sf).withColumns({"_one": F.lit(1), "_down": -F.col("score")}), ["_one"], ["_down", "id"], position=F.lit(1))
    out = views.by_age(ranked.filter(~F.col("status").isin(views.HIDDEN)), now())
    return out.select("group", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("""SELECT 'found' AS list, c_custkey AS id FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') AND c_nationkey % 3 = 0 UNION ALL SELECT 'fresh', c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'country', n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def searched_lists(spark, sf):
    """Customers found by words and health, those without an order, nations that have customers."""
    c = t(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") % 3 == 0, "ok").otherwise("failing").alias("health"))
    found = R.found_in(rows, ["name", "segment"], " BUILD ", "ok").select(F.lit("found").alias("list"), "id")
    fresh = R.without_overlap(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), t(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id").select(F.lit("fresh").alias("list"), "id")
    lands = views.country_list(c.select(F.col("c_nationkey").cast("string").alias("country"))).select(F.lit("country").alias("list"), F.col("country").cast("long").alias("id"))
    return found.unionAll(fresh).unionAll(lands)


@query("SELECT conv_id AS key, arg_min(role, turn) AS role, min(turn) AS position FROM conversations GROUP BY conv_id")
def first_turns(spark, sf):
    return R.distinct_pairs(t(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "role", F.col("turn").alias("position")), "key")


@query("""SELECT conv_id, k, v FROM (SELECT conv_id, unnest(['a', 'b', 'c']) AS k, unnest([CAST(min(turn) AS VARCHAR), 'patched', CAST(max(turn) AS VARCHAR)]) AS v FROM conversations GROUP BY conv_id)""")
def merged_settings(spark, sf):
    """Settings of each conversation, a patch over a base."""
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    base = F.create_map(F.lit("a"), F.col("lo").cast("string"), F.lit("b"), F.lit("base"))
    patch = F.create_map(F.lit("b"), F.lit("patched"), F.lit("c"), F.col("hi").cast("string"))
    return rows.select("conv_id", F.explode(S.merged_config(base, patch)).alias("k", "v"))


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS BIGINT) AS place, event_type <> 'purchase' OR round(28.5 + 0.02 * count(*) FILTER (WHERE event_type = 'purchase') OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING), 9) <= 30 AS judged FROM events""")
def budgeted_queue(spark, sf):
    """All events as one queue, newest first, in which purchases pay: those within the budget are judged."""
    rows = t(spark, sf, "events").select("event_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("late"))
    out = judging.within_budget(rows, F.col("event_type") == "purchase", ["late", "event_id"], 28.5, 30.0)
    out = scan.running_sums(out.withColumn("_one", F.lit(1)), ["_one"], ["late", "event_id"], place=F.lit(1))
    return out.select("event_id", "place", F.col("within_budget").alias("judged"))


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS spent, round(sum(value) OVER w, 9) <= 20000 AS fits FROM events WINDOW w AS (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def one_month_budget(spark, sf):
    """Running cost of whole months against a cap: a month has all rows."""
    rows = t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return R.budget_gate(rows, "ts", "value", 20_000.0, "event_id").select("event_id", F.round("spent", 6).alias("spent"), "fits")


@query("""WITH r AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (ORDER BY ts, event_id) AS k FROM events) SELECT event_id, CAST(max(t - k * 3600000000) OVER (ORDER BY k) + k * 3600000000 AS BIGINT) AS slot_us FROM r""")
def one_host_slots(spark, sf):
    """All events as requests of one host, one an hour."""
    rows = t(spark, sf, "events").select(F.lit("h").alias("host"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return S.reserve_slots(rows, 3600).select(F.col("id").alias("event_id"), F.unix_micros("slot").alias("slot_us"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, count(*) OVER () AS total FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, total FROM r WHERE n > total // 10 * 5 AND n <= total // 10 * 5 + 5""")
def deep_page(spark, sf):
    """A page from the middle of all lines, five of them: page 6,000 of 12,000 at sf0.01."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = scan.Ranked(lines, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    return ranked.page(ranked.total // 10 + 1, 5)


_PRE = POSTING_SQL["posting_prefilter"].split("SELECT id, language, CASE", 1)


@query(f"""{_PRE[0]}, g AS (SELECT id, CASE{_PRE[1].replace(" FROM r JOIN", ", e, body, name FROM r JOIN")}), x AS (SELECT id, e, name || E'\\n' || body AS whole, CASE WHEN id % 17 = 0 THEN 'Company is blacklisted.' WHEN id % 13 = 0 THEN 'Disliked by the owner.' ELSE reason END AS early FROM g),
b AS (SELECT *, early IS NULL AND round(29.5 + 0.02 * count(*) FILTER (WHERE early IS NULL) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), 9) > 30 AS parked FROM x),
v AS (SELECT id, coalesce(early, CASE WHEN parked THEN 'Monthly LLM budget cap reached; crawling continues.' WHEN NOT (len(list_filter(e, lambda y: y.source = 'title')) > 0 OR len(list_filter(e, lambda y: y.source = 'JD')) >= 2) THEN 'Local rules (Judge unreachable): not an AI software engineering role.' END) AS skip_reason, parked FROM b)
SELECT id, CASE WHEN skip_reason IS NULL THEN 'targeted' WHEN skip_reason = 'Company is blacklisted.' THEN 'blacklisted' WHEN parked THEN 'pending_judge' ELSE 'skipped' END AS status, skip_reason FROM v""")
def judged_postings(spark, sf):
    """The judgement of all postings by local rules, with 50 cents left."""
    k = F.col("id")
    none = lambda kind: F.lit(None).cast(kind)
    rows = postings(spark, sf).withColumnRenamed("body", "jd_text").withColumns({
        "jd_text_english": none("string"), "apply_url": F.col("link"), "company_blacklisted": k % 17 == 0, "feedback": F.when(k % 13 == 0, "dislike"), "posted_at": now(), "first_seen_at": now(), "preference": none("double"), "external": none(judging.EXTERNAL),
    })
    out = judging.judged(rows, now(), {"seniority": {"mid": 1.0}, "modeVisa": {}, "freshnessDays": [(2, 1.0)]}, {"other": 0.5}, [], spent=29.5)
    return out.select("id", "status", "skip_reason")


@query("""WITH s AS (SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS external_id, md5(text) AS h, CASE doc_id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'targeted' WHEN 2 THEN 'sent' ELSE 'new' END AS status FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS external_id, md5(text || '!') AS h FROM documents WHERE doc_id % 50 = 0)
SELECT coalesce(s.source_id, b.source_id) AS source_id, coalesce(s.external_id, b.external_id) AS external_id, coalesce(b.h, s.h) AS jd_hash, CASE WHEN s.source_id IS NULL THEN 'new' WHEN b.source_id IS NULL THEN s.status WHEN s.status = 'closed' THEN 'new' WHEN s.status IN ('targeted') THEN 'new' ELSE s.status END AS status
FROM s FULL OUTER JOIN b ON s.source_id = b.source_id AND s.external_id = b.external_id""")
def bucketed_upsert(spark, sf):
    """A stored state of documents in buckets, and a batch of one in fifty that rewrites only its own."""
    import uuid

    from tessera.operators.stored_state import BucketedState
    from tessera.shared import shared_dir

    d = t(spark, sf, "documents")
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "closed").when(k == 1, "targeted").when(k == 2, "sent").otherwise("new")
    key = [F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.lit("x").alias("title")]
    at = F.lit(None).cast("timestamp").alias("posted_at")
    first = d.filter("doc_id % 3 <> 0").select(*key, F.md5("text").alias("jd_hash"), at, status.alias("status"), now().alias("last_seen_at"))
    more = d.filter("doc_id % 50 = 0").select(*key, F.md5(F.concat("text", F.lit("!"))).alias("jd_hash"), at, F.col("doc_id").alias("position"))
    state = BucketedState(spark, f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}", first.schema, ["source_id", "external_id"])
    state.merge(first, 0, lambda old, new: new)
    state.merge(more, 1, lambda old, new: S.upsert_jobs(old, new, now()))
    return state.read().select("source_id", "external_id", "jd_hash", "status")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS period, event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, true AS close FROM events GROUP BY ALL")
def weekly_distinct(spark, sf):
    """Distinct users and events of a week from the sketches of its days, beside the exact counts: within 2 %."""
    from tessera.operators.sketches import daily_sketches, united
    from tessera.shared import stored

    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = lambda c: F.to_date(F.date_trunc("week", c))
    exact = e.groupBy(week("ts").alias("period"), "event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_id").alias("events"))
    for key, name in (("user_id", "u"), ("event_id", "v")):
        days = stored(daily_sketches(e, "ts", ["event_type"], key), "sketches")
        exact = exact.join(united(days, week("day"), ["event_type"], name), ["period", "event_type"])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(0.0), F.col(b) * 0.02)
    return exact.select("period", "event_type", "users", "events", (near("u", "users") & near("v", "events")).alias("close"))


WORDS = ["license", "Example.com", "the ", "und", "zz", "+1", "einen", "contact", "never said anywhere", "ción"]


@query(" UNION ALL ".join(f"SELECT '{w}' AS word, doc_id FROM documents WHERE contains(lower(text), '{w.lower()}')" for w in WORDS))
def substring_hits(spark, sf):
    """Ten words looked up in the texts by their rarest trigrams."""
    from tessera.operators.substring_search import TrigramIndex

    index = TrigramIndex(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    out = None
    for w in WORDS:
        found = index.search(w).select(F.lit(w).alias("word"), "doc_id")
        out = found if out is None else out.unionAll(found)
    return out
