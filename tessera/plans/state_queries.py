"""Queries of the state transitions and of windows over events, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import state as S
from tessera.plans.relational_queries import t
from tessera.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NOW = "2024-01-20 00:00:00"
#: Events as tasks: every seventh is leased until a day after its time, the rest are queued.
TASKS = "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, CAST(value AS INTEGER) % 5 AS priority, CASE WHEN event_id % 7 = 0 THEN 'leased' ELSE 'queued' END AS status, CASE WHEN event_id % 7 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY END AS lease_until, event_id % 3 AS attempts FROM events"


def tasks(spark, sf):
    e = t(spark, sf, "events")
    leased, at = F.col("event_id") % 7 == 0, F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"), at.alias("created_at"), (F.floor(F.rint("value")).cast("int") % 5).alias("priority"), F.when(leased, "leased").otherwise("queued").alias("status"), F.when(leased, "w0").alias("leased_by"),
        F.when(leased, at + F.expr("INTERVAL 1 DAY")).alias("lease_until"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


@query(f"""WITH t AS ({TASKS}), c AS (SELECT id FROM t WHERE lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}' ORDER BY priority DESC, created_at, id LIMIT 25)
SELECT id, CASE WHEN c.id IS NOT NULL THEN 'leased' ELSE status END AS status, epoch_us(CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 300 SECOND ELSE lease_until END) AS until_us FROM t LEFT JOIN c USING (id)""")
def queue_claim(spark, sf):
    out = S.claim(tasks(spark, sf), "w1", 25, now())
    return out.select("id", "status", F.unix_micros("lease_until").alias("until_us"))


@query(f"""WITH t AS ({TASKS}) SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, CAST(CASE WHEN id % 5 = 0 THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
epoch_us(CASE WHEN id % 5 = 0 THEN CASE WHEN attempts + 1 < 3 THEN TIMESTAMP '{NOW}' + to_seconds(least(86400, 60 * pow(2, attempts + 1))) END ELSE lease_until END) AS until_us FROM t""")
def queue_retry(spark, sf):
    failed = t(spark, sf, "events").filter("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit("timed out").alias("error"))
    return S.retry(tasks(spark, sf), failed, now()).select("id", "status", "attempts", F.unix_micros("lease_until").alias("until_us"))


@query("""WITH s AS (SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS external_id, md5(text) AS h, CASE doc_id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'targeted' WHEN 2 THEN 'sent' ELSE 'new' END AS status FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS external_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(s.source_id, b.source_id) AS source_id, coalesce(s.external_id, b.external_id) AS external_id, coalesce(b.h, s.h) AS jd_hash,
CASE WHEN s.source_id IS NULL THEN 'new' WHEN b.source_id IS NULL THEN s.status WHEN s.status = 'closed' THEN 'new' WHEN s.h <> b.h AND s.status IN ('judged', 'skipped', 'targeted', 'unverified') THEN 'new' ELSE s.status END AS status,
s.source_id IS NOT NULL AND b.source_id IS NOT NULL AND s.h <> b.h AS changed FROM s FULL OUTER JOIN b ON s.source_id = b.source_id AND s.external_id = b.external_id""")
def upsert_change_detect(spark, sf):
    """Two overlapping slices as state and batch."""
    d = t(spark, sf, "documents")
    key = [F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.lit("x").alias("title")]
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "closed").when(k == 1, "targeted").when(k == 2, "sent").otherwise("new")
    at = F.lit(None).cast("timestamp")
    old = d.filter("doc_id % 3 <> 0").select(*key, F.md5("text").alias("jd_hash"), at.alias("posted_at"), status.alias("status"), now().alias("last_seen_at"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 2 = 0").select(*key, F.md5(text).alias("jd_hash"), at.alias("posted_at"), F.col("doc_id").alias("position"))
    return S.upsert_jobs(old, new, now()).select("source_id", "external_id", "jd_hash", "status", "changed")


@query("""SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2', 'src3') AND doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN 'closed' WHEN doc_id % 5 = 0 THEN 'sent' ELSE 'targeted' END AS status FROM documents""")
def close_missing(spark, sf):
    d = t(spark, sf, "documents")
    jobs = d.select(F.col("source").alias("source_id"), F.col("doc_id").alias("external_id"), F.when(F.col("doc_id") % 5 == 0, "sent").otherwise("targeted").alias("status"))
    full = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source_id string")
    out = S.close_missing(jobs, full, jobs.filter("external_id % 2 = 0"))
    return out.select(F.col("external_id").alias("doc_id"), F.col("source_id").alias("source"), "status")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-07-15' AND o_orderstatus <> 'F' THEN 'closed' WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'targeted' END AS status FROM orders""")
def expire_stale(spark, sf):
    jobs = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("last_seen_at"), F.when(F.col("o_orderstatus") == "F", "sent").otherwise("targeted").alias("status"))
    return S.expire(jobs, F.lit("1998-07-29").cast("timestamp")).select("o_orderkey", "status")


@query(f"""WITH s AS (SELECT user_id AS id, CAST(1 + user_id % 3 AS INTEGER) AS tier, max(CAST(ts AS TIMESTAMP)) + to_hours(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 24 END) AS due FROM events GROUP BY 1, 2, user_id % 3)
SELECT 'crawl:' || id || ':' || strftime(due, '%Y-%m-%dT%H:%M:%S') AS dedupe_key, id AS source_id, CASE tier WHEN 1 THEN 100 WHEN 2 THEN 60 ELSE 20 END AS priority FROM s WHERE due <= TIMESTAMP '2024-01-30 12:00:00' ORDER BY tier, due, id LIMIT 1000""")
def schedule_due(spark, sf):
    seen = t(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    tier = (1 + F.col("user_id") % 3).cast("int")
    sources = seen.select(F.col("user_id").alias("id"), tier.alias("tier"), dates.next_due("last", tier).alias("next_due_at"), F.lit(None).cast("timestamp").alias("blocked_until"))
    return S.due_tasks(sources, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("dedupe_key", "source_id", "priority")


@query("""SELECT id, k AS dedupe_key FROM (SELECT event_id AS id, user_id || ':' || event_type AS k, row_number() OVER (PARTITION BY user_id || ':' || event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1) a
WHERE n = 1 AND k NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_id % 10 = 0) UNION ALL SELECT event_id, user_id || ':' || event_type FROM events WHERE event_id % 10 = 0""")
def dedupe_key_insert(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type").alias("dedupe_key"))
    return S.enqueue(e.filter("id % 10 = 0"), e.filter("id % 2 = 1"))


@query("""SELECT o_orderkey FROM orders o WHERE o_orderdate <= TIMESTAMP '1998-07-01' - INTERVAL 6 DAY AND o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def followup_due(spark, sf):
    replied = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    due = dates.follow_up_due(F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus") == "F", F.lit(False), F.lit("1998-07-01").cast("timestamp"))
    return t(spark, sf, "orders").filter(due).join(replied, "o_orderkey", "left_anti").select("o_orderkey")


@query("""WITH l AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS x, CAST(ts AS TIMESTAMP) AS ts FROM events), d AS (SELECT event_id, ts, x, date_trunc('day', x) + to_days(CAST(k AS INTEGER)) + INTERVAL 9 HOUR AS s FROM l, range(22) r(k))
SELECT l.event_id, epoch_us(CASE WHEN isodow(l.x) < 6 AND hour(l.x) BETWEEN 9 AND 16 THEN l.ts ELSE (SELECT min(s) FROM d WHERE d.event_id = l.event_id AND isodow(s) < 6 AND s > d.x) - INTERVAL 7 HOUR END) AS next_us FROM l""")
def work_window_next(spark, sf):
    return t(spark, sf, "events").select("event_id", F.unix_micros(dates.next_work_window(F.col("ts").cast("timestamp"), "Etc/GMT-7")).alias("next_us"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf):
    out = J.tumbling(t(spark, sf, "events"), "ts", "1 hour", ["event_type"])
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) - to_minutes(CAST(30 * k AS INTEGER))) AS start_us, count(*) AS n FROM events, range(2) r(k) GROUP BY 1""")
def sliding_window(spark, sf):
    return J.tumbling(t(spark, sf, "events"), "ts", "1 hour", [], slide="30 minutes").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query("""WITH g AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf):
    return J.sessions(t(spark, sf, "events"), "ts", "6 hours", ["user_id"]).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query("SELECT n_nationkey, unnest(['a', 'b', 'c']) AS k, unnest([n_name, '9', CAST(n_regionkey AS VARCHAR)]) AS v FROM nation")
def config_merge(spark, sf):
    """Settings of each nation, a patch over a base."""
    base = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("2"))
    patch = F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.col("n_regionkey").cast("string"))
    return t(spark, sf, "nation").select("n_nationkey", F.explode(S.merged_config(base, patch)).alias("k", "v"))


@query("SELECT i, ['engineer', 'developer', 'architect'][CAST(i % 3 + 1 AS INTEGER)] || ' ' || ['berlin', 'paris'][CAST(i // 3 % 2 + 1 AS INTEGER)] || CASE i % 4 WHEN 1 THEN ' posts' WHEN 2 THEN ' startup' WHEN 3 THEN ' seed' ELSE '' END AS q FROM (SELECT event_id AS i FROM events)")
def query_plan(spark, sf):
    """Mixed-radix numbers of a search plan, one for each event."""
    i = F.col("i")
    role, place = (F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int")) for xs, k in ((("engineer", "developer", "architect"), i % 3), (("berlin", "paris"), F.floor(i / 3) % 2)))
    tail = F.when(i % 4 == 1, " posts").when(i % 4 == 2, " startup").when(i % 4 == 3, " seed").otherwise("")
    return t(spark, sf, "events").select(F.col("event_id").alias("i")).select("i", F.concat(role, F.lit(" "), place, tail).alias("q"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'P' THEN 'sending' ELSE 'sent' END AS status, CAST(o_orderdate AS TIMESTAMP) AS due FROM orders),
c AS (SELECT id FROM o WHERE (status = 'scheduled' AND due <= TIMESTAMP '1998-07-01') OR (status = 'sending' AND due < TIMESTAMP '1998-06-30 23:50:00') ORDER BY due, id LIMIT 50)
SELECT id, CASE WHEN c.id IS NOT NULL THEN 'sending' ELSE status END AS status, c.id IS NOT NULL OR due = TIMESTAMP '1998-07-01' AS fresh FROM o LEFT JOIN c USING (id)""")
def due_sends(spark, sf):
    at, now = F.col("o_orderdate").cast("timestamp"), F.lit("1998-07-01").cast("timestamp")
    k = F.col("o_orderstatus")
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == "O", "scheduled").when(k == "P", "sending").otherwise("sent").alias("status"), at.alias("scheduled_for"), at.alias("updated_at"))
    return S.claim_sends(rows, now, 50).select("id", "status", (F.col("updated_at") == now).alias("fresh"))


@query("""WITH g AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'job_closed' WHEN 2 THEN 'daily_cap' WHEN 3 THEN 'not_approved' ELSE 'ok' END AS code, hour(CAST(ts AS TIMESTAMP)) BETWEEN 9 AND 16 AND isodow(CAST(ts AS TIMESTAMP)) < 6 AS inside, event_id % 4 <> 0 AS delivered, CAST(ts AS TIMESTAMP) AS ts FROM events)
SELECT event_id, CASE WHEN NOT inside THEN 'scheduled' WHEN code = 'job_closed' THEN 'closed' WHEN code <> 'ok' THEN 'scheduled' WHEN delivered THEN 'sent' ELSE 'failed' END AS status,
CASE WHEN inside AND code = 'daily_cap' THEN epoch_us(ts) + 86400000000 WHEN inside AND code = 'not_approved' THEN epoch_us(ts) + 3600000000 END AS put_off_us FROM g""")
def send_outcomes(spark, sf):
    """What becomes of claimed sends."""
    k, now = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    code = F.when(k == 1, "job_closed").when(k == 2, "daily_cap").when(k == 3, "not_approved").otherwise("ok")
    inside = dates.in_work_window(now, "UTC")
    out = S.send_outcome(code, inside, F.col("event_id") % 4 != 0, now, dates.next_work_window(now, "UTC"))
    return t(spark, sf, "events").select("event_id", out["status"].alias("status"), F.when(inside, F.unix_micros(out["scheduled_for"])).alias("put_off_us"))


@query("""WITH r AS (SELECT conv_id AS id, role, lower(text) AS x FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
c AS (SELECT id, role, CASE WHEN regexp_matches(x, 'delivery failed|undeliverable|mailbox unavailable|address not found|550 5\\.1\\.') THEN 'bounce' WHEN regexp_matches(x, 'out of office|automatic reply|auto-reply|vacation responder') THEN 'auto_reply'
WHEN regexp_matches(x, 'unfortunately|not moving forward|decided not to|other candidates|position has been filled|no longer considering') THEN 'negative' ELSE 'positive' END AS reply_class FROM r)
SELECT id, reply_class, CASE WHEN reply_class = 'negative' THEN role END AS blocked FROM c WHERE id % 3 <> 0""".replace("\\\\", "\\"))
def reply_tracking(spark, sf):
    """The last message of each thread as the reply to it; those of every third are too fresh."""
    rows = t(spark, sf, "conversations")
    sent = F.when(F.col("conv_id") % 3 == 0, now()).otherwise(F.timestamp_micros(F.unix_micros(now()) - 3_600_000_000))
    outreach = rows.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("contact_id"), sent.alias("sent_at")).distinct()
    return S.track_replies(outreach, rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("position"), F.col("role").alias("sender"), F.col("text").alias("body")), now()).select("id", "reply_class", "blocked")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN 'skipped' WHEN o_orderstatus = 'O' THEN 'targeted' ELSE 'sent' END AS status FROM orders""")
def email_only_mode(spark, sf):
    k = F.col("o_orderstatus") == "O"
    jobs = t(spark, sf, "orders").select("o_orderkey", F.when(k, "targeted").otherwise("sent").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "email").otherwise("form").alias("apply_method"), F.lit(None).cast("string").alias("skip_reason"))
    return S.email_only(jobs, True, now()).select("o_orderkey", "status")


@query("""SELECT lower(s_name) AS name, s_suppkey % 2 = 0 AS known FROM supplier""")
def company_get_or_create(spark, sf):
    """Names in any case against known companies."""
    s = t(spark, sf, "supplier")
    known = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    names = s.select(F.upper("s_name").alias("name")).unionAll(s.select(F.lower("s_name")))
    return S.with_companies(known, names).select(F.lower("name").alias("name"), (F.length("id") < 32).alias("known"))
