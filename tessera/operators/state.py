"""State transitions: (state, input, now) -> new state, table to table. They run as batches or inside foreachBatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import next_due
from tessera.functions.rules import reply_class
from tessera.functions.scoring import backoff_seconds
from tessera.operators.scan import running_slots


def plus_seconds(t, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(t) + (seconds.cast("double") * 1_000_000).cast("long"))


def claimable(now: Column) -> Column:
    """Queued tasks whose back-off is over, and leased ones whose lease is."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return F.col("status").isin("queued", "leased") & free


def claim(tasks: DataFrame, worker: str, n: int, now: Column, seconds: int = 300) -> DataFrame:
    """The first n claimable tasks by priority, age and id get a lease; the rest stay."""
    taken = tasks.filter(claimable(now)).orderBy(F.desc("priority"), "created_at", "id").limit(n).select("id", F.lit(True).alias("_taken"))
    out = tasks.join(taken, "id", "left")
    hit = F.coalesce("_taken", F.lit(False))
    return out.withColumns({"status": F.when(hit, "leased").otherwise(F.col("status")), "leased_by": F.when(hit, worker).otherwise(F.col("leased_by")), "lease_until": F.when(hit, plus_seconds(now, F.lit(seconds))).otherwise(F.col("lease_until"))}).select(tasks.columns)


def complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """(id) of finished tasks: done, without a lease."""
    out = tasks.join(done.select("id", F.lit(True).alias("_done")).dropDuplicates(["id"]), "id", "left")
    hit = F.coalesce("_done", F.lit(False))
    return out.withColumns({"status": F.when(hit, "done").otherwise(F.col("status")), "leased_by": F.when(hit, None).otherwise(F.col("leased_by")), "lease_until": F.when(hit, None).otherwise(F.col("lease_until"))}).select(tasks.columns)


def retry(tasks: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """(id, error) of failures: one more attempt; queued after a doubling delay, failed at max_attempts."""
    out = tasks.join(failed.groupBy("id").agg(F.max("error").alias("_error")), "id", "left")
    hit = F.col("_error").isNotNull()
    attempts = F.col("attempts") + 1
    over = attempts >= F.col("max_attempts")
    return out.withColumns({
        "status": F.when(hit, F.when(over, "failed").otherwise("queued")).otherwise(F.col("status")),
        "lease_until": F.when(hit, F.when(~over, plus_seconds(now, backoff_seconds(attempts)))).otherwise(F.col("lease_until")),
        "leased_by": F.when(hit, None).otherwise(F.col("leased_by")),
        "attempts": F.when(hit, attempts).otherwise(F.col("attempts")),
    }).select(tasks.columns)


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks whose dedupe_key is not there yet; of equal keys in the input the smallest id."""
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))).filter("_n = 1").drop("_n")
    return tasks.unionByName(one.join(tasks.select("dedupe_key"), "dedupe_key", "left_anti").select(tasks.columns))


def upsert_jobs(state: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Keyed merge on (source_id, external_id) with change detection.

    The batch's last row of a key (by position) counts. Known jobs keep posted_at unless it was null, reopen if they were
    closed, and are judged again if jd_hash changed in a status before outreach; new ones start as `new`.
    """
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "external_id").orderBy(F.desc("position")))).filter("_n = 1")
    s, b = state.alias("s"), last.alias("b")
    known, seen = F.col("s.source_id").isNotNull(), F.col("b.source_id").isNotNull()
    changed = known & seen & ~F.col("s.jd_hash").eqNullSafe(F.col("b.jd_hash"))
    status = (
        F.when(~known, "new")
        .when(~seen, F.col("s.status"))
        .when(F.col("s.status") == "closed", "new")
        .when(changed & F.col("s.status").isin("judged", "skipped", "targeted", "unverified"), "new")
        .otherwise(F.col("s.status"))
    )
    pick = lambda c: F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return s.join(b, (F.col("s.source_id") == F.col("b.source_id")) & (F.col("s.external_id") == F.col("b.external_id")), "full_outer").select(
        F.coalesce("s.source_id", "b.source_id").alias("source_id"), F.coalesce("s.external_id", "b.external_id").alias("external_id"), pick("title"), pick("jd_hash"),
        F.coalesce("s.posted_at", "b.posted_at").alias("posted_at"), status.alias("status"), F.when(seen, now).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"), changed.alias("changed"),
    )


def close_missing(state: DataFrame, listings: DataFrame, seen: DataFrame) -> DataFrame:
    """(source_id) of full listings, (source_id, external_id) seen: other open jobs of these sources close; sent and replied ones keep their status."""
    out = state.join(listings.select("source_id", F.lit(True).alias("_full")).dropDuplicates(["source_id"]), "source_id", "left").join(seen.select("source_id", "external_id", F.lit(True).alias("_seen")).dropDuplicates(["source_id", "external_id"]), ["source_id", "external_id"], "left")
    gone = F.col("_full").isNotNull() & F.col("_seen").isNull() & ~F.col("status").isin("closed", "sent", "replied")
    return out.withColumn("status", F.when(gone, "closed").otherwise(F.col("status"))).select(state.columns)


def expire(state: DataFrame, now: Column, days: int = 14) -> DataFrame:
    old = (F.unix_micros("last_seen_at") < F.unix_micros(now) - days * 86_400_000_000) & ~F.col("status").isin("closed", "sent", "replied", "blacklisted")
    return state.withColumn("status", F.when(old, "closed").otherwise(F.col("status")))


def schedule(sources: DataFrame, now: Column, most: int = 1000) -> DataFrame:
    """Sources with a crawl or a check for closed postings due, by tier and the earlier of both -> their tasks of either kind."""
    from tessera.functions.scoring import queue_priority

    free = F.col("blocked_until").isNull() | (F.col("blocked_until") <= now)
    due = sources.filter(free & ((F.col("next_due_at") <= now) | (F.col("closed_due_at") <= now)))
    first = due.orderBy("tier", F.least("next_due_at", "closed_due_at"), "id").limit(most)
    kinds = F.explode(F.array(F.struct(F.lit("crawl").alias("kind"), F.col("next_due_at").alias("at")), F.struct(F.lit("closed_check").alias("kind"), F.col("closed_due_at").alias("at")))).alias("t")
    each = first.select("id", "tier", kinds).filter(F.col("t.at") <= now)
    key = F.concat_ws(":", "t.kind", "id", F.date_format("t.at", "yyyy-MM-dd'T'HH:mm:ss"))
    return each.select(F.md5(key).alias("id"), key.alias("dedupe_key"), "t.kind", F.col("id").alias("source_id"), queue_priority("tier", F.col("t.kind")).alias("priority"))


def due_tasks(sources: DataFrame, now: Column, most: int = 1000) -> DataFrame:
    """Due sources by tier and due time -> their tasks (id, dedupe_key, kind, source_id, priority)."""
    from tessera.functions.scoring import queue_priority

    due = sources.filter((F.col("next_due_at") <= now) & (F.col("blocked_until").isNull() | (F.col("blocked_until") <= now)))
    first = due.orderBy("tier", "next_due_at", "id").limit(most)
    key = F.concat_ws(":", F.lit("crawl"), "id", F.date_format("next_due_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return first.select(F.md5(key).alias("id"), key.alias("dedupe_key"), F.lit("crawl").alias("kind"), F.col("id").alias("source_id"), queue_priority("tier", F.lit("crawl")).alias("priority"))


def advance(sources: DataFrame, now: Column) -> DataFrame:
    """Due sources get their tier's next due time."""
    return sources.withColumn("next_due_at", F.when(F.col("next_due_at") <= now, next_due(now, "tier")).otherwise(F.col("next_due_at")))


def mark_rescore(jobs: DataFrame, n: int = 300) -> DataFrame:
    """The n best targets are to be scored again."""
    top = jobs.filter("status = 'targeted'").orderBy(F.desc_nulls_last("score"), "id").limit(n).select("id", F.lit(True).alias("_top"))
    return jobs.join(top, "id", "left").withColumn("needs_rescore", F.coalesce("_top", F.col("needs_rescore"))).drop("_top")


def blacklist(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    out = jobs.join(companies.select("company_id", F.lit(True).alias("_black")).dropDuplicates(["company_id"]), "company_id", "left")
    return out.withColumn("status", F.when(F.col("_black").isNotNull(), "blacklisted").otherwise(F.col("status"))).select(jobs.columns)


def reserve_slots(requests: DataFrame, seconds: int) -> DataFrame:
    """(host, at, id) -> slot: one request a host each so many seconds, in order, never before it was asked for. A host may have all requests."""
    out = running_slots(requests, ["host"], ["at", "id"], F.unix_micros("at"), F.lit(seconds * 1_000_000), "slot")
    return out.withColumn("slot", F.timestamp_micros("slot"))


def open_circuit(streak: Column, blocked: Column) -> Column:
    """Seconds a host rests after so many failures in a row: 30 doubled, at most a day; at least a quarter of an hour when blocked."""
    rest = F.least(F.lit(86_400.0), 30 * F.pow(F.lit(2.0), F.greatest(streak, F.lit(0))))
    return F.when(blocked, F.greatest(F.lit(900.0), rest)).otherwise(rest)


def paused_until(paused: Column, due: Column, now: Column) -> Column:
    return F.when(paused, F.to_timestamp(F.lit("9999-12-31"))).otherwise(F.when(due >= F.to_timestamp(F.lit("9999-12-31")), now).otherwise(due))


def merged_config(base: Column, patch: Column) -> Column:
    """Two maps of settings, the patch wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.array_contains(F.map_keys(patch), e["key"])), F.map_entries(patch)))


#: Fixed value: the reason that the mode for applications by e-mail gives.
EMAIL_ONLY = "No application email (email-only mode is on)."


def email_only(jobs: DataFrame, on: bool, now: Column) -> DataFrame:
    """Switched on, targets without an apply address are skipped; switched off, those skipped for it are judged again unless closed."""
    if on:
        hit = (F.col("status") == "targeted") & (F.col("apply_method") != "email")
        new = {"status": F.lit("skipped"), "skip_reason": F.lit(EMAIL_ONLY)}
    else:
        hit = (F.col("status") == "skipped") & F.col("skip_reason").startswith("No application email") & F.col("closed_at").isNull()
        new = {"status": F.lit("new"), "next_judge_at": now}
    hit = F.coalesce(hit, F.lit(False))
    return jobs.withColumn("_hit", hit).withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).select(jobs.columns)


def claim_sends(outreach: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """The n sends that are due first, or stuck in sending for over ten minutes, are being sent; the rest stay."""
    stuck = (F.col("status") == "sending") & (F.unix_micros("updated_at") < F.unix_micros(now) - 600_000_000)
    due = (F.col("status") == "scheduled") & (F.col("scheduled_for") <= now)
    taken = outreach.filter(due | stuck).orderBy("scheduled_for", "id").limit(n).select("id", F.lit(True).alias("_taken"))
    hit = F.col("_taken").isNotNull()
    out = outreach.join(taken, "id", "left")
    return out.withColumns({"status": F.when(hit, "sending").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(outreach.columns)


#: Codes of the send gate that end an outreach.
FINAL_CODES = ["job_closed", "job_unverified", "missing_contact", "invalid_contact", "do_not_contact", "duplicate_outreach"]


def send_outcome(code: Column, in_window: Column, delivered: Column, now: Column, window_start: Column) -> Column:
    """struct(status, scheduled_for) of a claimed send: outside the work window it waits for the next one; then the gate's code decides.

    The daily cap puts it off a day, any other fault an hour; a delivery that failed is failed.
    """
    later = lambda hours: F.timestamp_micros(F.unix_micros(now) + hours * 3_600_000_000)
    status = F.when(~in_window, "scheduled").when(code.isin(FINAL_CODES), "closed").when(code != "ok", "scheduled").when(~delivered, "failed").otherwise("sent")
    at = F.when(~in_window, window_start).when(code == "daily_cap", later(24)).when((code != "ok") & ~code.isin(FINAL_CODES), later(1))
    return F.struct(status.alias("status"), at.alias("scheduled_for"))


def track_replies(outreach: DataFrame, replies: DataFrame, now: Column) -> DataFrame:
    """(id, contact_id, sent_at), (id, position, sender, body) -> the last reply of each thread sent an hour ago or more, with its class.

    blocked is the sender of a refusal; invalid_contact the contact whose mailbox bounced.
    """
    old = outreach.filter(F.coalesce(F.unix_micros("sent_at"), F.lit(0)) <= F.unix_micros(now) - 3_600_000_000)
    last = replies.groupBy("id").agg(F.max_by(F.struct("sender", "body"), "position").alias("r")).select("id", "r.*")
    kind = reply_class("body")
    return old.join(last, "id").select("id", kind.alias("reply_class"), F.substring("body", 1, 20_000).alias("body"), F.when(kind == "negative", F.col("sender")).alias("blocked"), F.when(kind == "bounce", F.col("contact_id")).alias("invalid_contact"))


def with_companies(companies: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, ...), (name) -> companies and one new row for each name that none has in any case; its id is a digest of the name."""
    fresh = names.filter(F.trim("name") != "").groupBy(F.lower("name").alias("_key")).agg(F.min("name").alias("name"))
    fresh = fresh.join(companies.select(F.lower("name").alias("_key")), "_key", "left_anti").select(F.md5("_key").alias("id"), "name")
    return companies.unionByName(fresh, allowMissingColumns=True)


def source_failures(sources: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """(id, blocked, error) of failed crawls -> sources with fail_count, blocked_until and last_error: three failures or a ban rest a source for a day."""
    each = failures.groupBy("id").agg(F.count("*").alias("_n"), F.max("blocked").alias("_blocked"), F.max("error").alias("_error"))
    out = sources.join(each, "id", "left")
    hit = F.col("_n").isNotNull()
    count = F.col("fail_count") + F.col("_n")
    return out.withColumns({
        "blocked_until": F.when(hit & ((count >= 3) | F.col("_blocked")), plus_seconds(now, F.lit(86_400))).otherwise(F.col("blocked_until")),
        "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        "fail_count": F.when(hit, count).otherwise(F.col("fail_count")),
    }).select(sources.columns)


def source_successes(sources: DataFrame, done: DataFrame) -> DataFrame:
    """(id) of sources that answered: failures are forgotten."""
    out = sources.join(done.select("id", F.lit(True).alias("_ok")).dropDuplicates(["id"]), "id", "left")
    new = {"fail_count": F.lit(0), "blocked_until": F.lit(None), "last_error": F.lit(None)}
    return out.withColumns({k: F.when(F.col("_ok"), v).otherwise(F.col(k)) for k, v in new.items()}).select(sources.columns)


def company_health(companies: DataFrame, sources: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, ok, blocked) of crawled sources -> companies with the health of their last word: blocked before failing before ok."""
    each = ends.join(sources.select("id", "company_id"), "id").groupBy("company_id").agg(F.max("blocked").alias("_blocked"), F.min("ok").alias("_ok"))
    out = companies.join(each, companies.id == each.company_id, "left")
    health = F.when(F.col("_ok"), "ok").when(F.col("_blocked"), "blocked").otherwise("failing")
    return out.withColumn("health", F.when(F.col("_ok").isNotNull(), health).otherwise(F.col("health"))).select(*[companies[c] if c != "health" else F.col("health") for c in companies.columns])


def upsert_sightings(sightings: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """(job_id, source_id, url) of a crawl, the last of each by position -> sightings with the new address and time."""
    last = batch.groupBy("job_id", "source_id").agg(F.max_by("url", "position").alias("_url"))
    out = sightings.join(last, ["job_id", "source_id"], "full_outer")
    return out.select("job_id", "source_id", F.coalesce("_url", "url").alias("url"), F.when(F.col("_url").isNotNull(), now).otherwise(F.col("seen_at")).alias("seen_at"))


def judge_queue(jobs: DataFrame, now: Column, n: int = 25) -> DataFrame:
    """The n jobs to judge next: new, parked ones that are due, targets not confirmed or to be scored again; the latter first, then by age."""
    waiting = F.col("status").isin("new", "unverified", "pending_judge") | ((F.col("status") == "targeted") & (~F.col("verified") | F.col("needs_rescore")))
    due = jobs.filter(F.col("closed_at").isNull() & (F.col("next_judge_at") <= now) & waiting)
    return due.orderBy(F.desc("needs_rescore"), F.desc(F.coalesce("posted_at", "first_seen_at")), "id").limit(n)


def park(jobs: DataFrame, parked: DataFrame, now: Column) -> DataFrame:
    """(id, status, reason, minutes) -> jobs that wait so long for the next judgement; without a status only the time changes."""
    p = parked.select("id", F.col("status").alias("_status"), F.col("reason").alias("_reason"), F.col("minutes").alias("_minutes")).dropDuplicates(["id"])
    out = jobs.join(p, "id", "left")
    named = F.col("_status").isNotNull()
    return out.withColumns({
        "status": F.coalesce("_status", "status"),
        "skip_reason": F.when(named, F.col("_reason")).otherwise(F.col("skip_reason")),
        "next_judge_at": F.when(F.col("_minutes").isNotNull(), plus_seconds(now, F.col("_minutes") * 60)).otherwise(F.col("next_judge_at")),
    }).select(jobs.columns)


def upsert_feedback(feedback: DataFrame, batch: DataFrame) -> DataFrame:
    """(job_id, verdict, at): the latest verdict of each job."""
    every = feedback.unionByName(batch.select(feedback.columns))
    return every.groupBy("job_id").agg(F.max_by(F.struct("verdict", "at"), "at").alias("v")).select("job_id", "v.*")


def do_not_contact(entries: DataFrame, companies: DataFrame) -> DataFrame:
    """(email_or_domain, reason), (name, domain) of companies ruled out -> entries with those that are not there yet."""
    key = F.coalesce("domain", F.concat(F.lit("company:"), F.lower("name")))
    new = companies.select(key.alias("email_or_domain"), F.lit("Blacklisted from dashboard").alias("reason")).dropDuplicates(["email_or_domain"])
    return entries.unionByName(new.join(entries, "email_or_domain", "left_anti"))


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, set: array of field names, fields) -> rows in which named fields have the patch's value, null too; the others stay."""
    p = patch.select(key, F.col("set").alias("_set"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(p, key, "left")
    named = lambda f: F.coalesce(F.array_contains("_set", f), F.lit(False))
    return out.withColumns({f: F.when(named(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(rows.columns)


def yield_stats(stats: DataFrame, events: DataFrame) -> DataFrame:
    """(id, items, relevant, duplicate, failed, at) events -> counters of each id with the first and last time of a yield. Deltas are summed before they meet the state."""
    items, relevant = F.sum(F.coalesce("items", F.lit(1))), F.sum(F.coalesce("relevant", F.lit(0)))
    delta = events.groupBy("id").agg(items.alias("_items"), relevant.alias("_relevant"), F.count_if("duplicate").alias("_duplicates"), F.count_if("failed").alias("_failures"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    out = stats.join(delta, "id", "full_outer")
    plus = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a)
    counts = [plus(a, b) for a, b in (("items_seen", "_items"), ("relevant_jobs", "_relevant"), ("duplicate_jobs", "_duplicates"), ("failures", "_failures"))]
    return out.select("id", *counts, F.coalesce("first_yield_at", "_first").alias("first_yield_at"), F.coalesce("_last", "last_yield_at").alias("last_yield_at"))


def seeded(sources: DataFrame, seed: DataFrame, key: str = "seed_key", kept: tuple = ("status",)) -> DataFrame:
    """Sources and a seed by key: new rows come in, known ones take the seed's values but for the kept columns. Twice is as once."""
    s, n = sources.alias("s"), seed.alias("n")
    known, given = F.col(f"s.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(given & ~(known & F.lit(c in kept)), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c) for c in sources.columns])


def search_turn(cursor, space: int, forms: int = 4) -> Column:
    """struct(query, next): the number of the search query that is due and the cursor after it."""
    at = F.pmod(F.coalesce(F.col(cursor) if isinstance(cursor, str) else cursor, F.lit(0)), F.lit(space * forms))
    return F.struct(at.alias("query"), (at + 1).alias("next"))


def breaker_key(url) -> Column:
    """What rests together after failures: a host, or a board's path on hosts that many boards share."""
    from tessera.functions import vocabulary as V
    from tessera.functions.urls import host

    x = F.col(url) if isinstance(url, str) else url
    parts = F.slice(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(x, F.lit("PATH")), F.lit("")), "^/", ""), "/"), 1, 5)
    return F.when(host(x).isin(V.SHARED_HOSTS), F.concat(host(x), F.lit("/"), F.array_join(parts, "/"))).otherwise(host(x))


def circuits(ends: DataFrame) -> DataFrame:
    """(url, at, ok, blocked) of requests -> key, streak, rests_until: failures since the key's last success and how long it rests from its last failure."""
    rows = ends.withColumn("key", breaker_key("url"))
    last = rows.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok"))
    bad = rows.filter("NOT ok").join(last, "key").filter("_ok IS NULL OR at > _ok")
    each = bad.groupBy("key").agg(F.count("*").alias("streak"), F.max("at").alias("_at"), F.max_by("blocked", "at").alias("_blocked"))
    return each.select("key", "streak", plus_seconds(F.col("_at"), open_circuit(F.col("streak"), F.col("_blocked"))).alias("rests_until"))


def after_action(targets: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Targets as a list shows them once actions (id, action, set, fields) are taken: a blacklisted one goes with all of its company, others get the named fields.

    A blacklisted target without a company goes alone. An id has one action at most.
    """
    hit = targets.join(changes.filter("action = 'blacklist'").select("id"), "id", "left_semi")
    left = targets.join(hit.select("company_id").distinct(), "company_id", "left_anti").join(hit.select("id"), "id", "left_anti")
    return patched(left.select(targets.columns), changes.filter("action <> 'blacklist'"), "id", fields)
