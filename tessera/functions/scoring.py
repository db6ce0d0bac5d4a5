"""Scores, models and decisions as columns. `now` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import col, js, text


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at so many digits, also for halves of negative numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def age_days(since: Column, now: Column) -> Column:
    """Fractional days, not under 0; 3 where there is no date."""
    days = (F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000
    return F.coalesce(F.greatest(F.lit(0.0), days), F.lit(3.0))


def freshness(since: Column, now: Column, steps: list[tuple[float, float]], stale: float = 0.3) -> Column:
    """The weight of the first step whose days reach the age."""
    out = F.lit(stale)
    for most, weight in reversed(steps):
        out = F.when(age_days(since, now) <= most, F.lit(weight)).otherwise(out)
    return out


def mode_key(scope: Column, sponsor: Column) -> Column:
    return F.when(scope.isin("remote_global", "remote_apac", "remote_restricted"), scope).when(sponsor == "yes", "onsite_sponsor_yes").when(sponsor == "no", "sponsor_no").otherwise("sponsor_unknown")


def job_score(role_fit, seniority, scope, sponsor, posted_at, overlap, country_weight, now, weights: dict) -> Column:
    """struct of the six factors, their product, and the score: 0 to 100 with one digit."""
    parts = {
        "role_fit": clamp(col(role_fit), 0.0, 1.0),
        "seniority_weight": lookup(weights["seniority"], col(seniority), 0.5),
        "mode_visa_weight": lookup(weights["modeVisa"], mode_key(col(scope), col(sponsor)), 0.5),
        "freshness_weight": freshness(col(posted_at), now, weights["freshnessDays"]),
        "skill_overlap": clamp(col(overlap), 0.0, 1.0),
        "country_weight": clamp(col(country_weight), 0.0, 1.2),
    }
    product = F.lit(1.0)
    for p in parts.values():
        product = product * p
    return F.struct(*[v.alias(k) for k, v in parts.items()], product.alias("raw_product"), round_half_up(clamp(product, 0.0, 1.0) * 100, 1).alias("score"))


def final_score(score: Column, focus: Column, preference: Column, by_email: Column, new_company: Column) -> Column:
    """The score times focus, preference (1 if unknown), a bonus for applications by e-mail and for new companies; at most 100."""
    liked = F.coalesce(0.6 + 0.4 * preference, F.lit(1.0))
    return F.least(F.lit(100.0), round_half_up(score * (0.7 + 0.3 * focus) * liked * F.when(by_email, 1.3).otherwise(1.0) * F.when(new_company, 1.2).otherwise(1.0), 1))


def skill_overlap(body, skills: list[str]) -> Column:
    """0.75 without skills, else from 0.5 to 1 with eight of the first thirty found."""
    if not skills:
        return F.lit(0.75)
    found = [F.lower(text(body)).rlike(r"(^|[^a-z0-9])" + F_escape(s.lower()) + r"($|[^a-z0-9])").cast("int") for s in skills[:30]]
    hits = found[0]
    for f in found[1:]:
        hits = hits + f
    return 0.5 + 0.5 * F.least(F.lit(1.0), hits / 8)


def F_escape(s: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)


def agentic_focus(title, body) -> Column:
    hits = F.regexp_count(text(body), F.lit(js(V.AGENTIC)))
    return F.when(text(title).rlike(js(V.AGENTIC)), 0.9).otherwise(F.least(F.lit(0.85), 0.35 + hits * 0.08))


def blend(external: Column, local: Column) -> Column:
    """Seven parts external and three local; either alone where the other is null."""
    return F.coalesce(0.7 * external + 0.3 * local, external, local)


def tokens(x) -> Column:
    """Distinct words for the preference model."""
    words = F.regexp_extract_all(F.lower(text(x)), F.lit(r"[a-z][a-z0-9+#.-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(V.PREFERENCE_STOP_WORDS)))


def token_weights(examples: DataFrame) -> DataFrame:
    """(liked boolean, text) -> (token, weight): smoothed log-odds of each token's documents among liked and disliked ones."""
    totals = examples.agg(F.count_if(F.col("liked")).alias("likes"), F.count_if(~F.col("liked")).alias("dislikes"))
    each = examples.select("liked", F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count_if(F.col("liked")).alias("l"), F.count_if(~F.col("liked")).alias("d"))
    one = each.crossJoin(F.broadcast(totals))  # totals is one row
    return one.select("token", (F.log((F.col("l") + 1) / (F.col("likes") + 2)) - F.log((F.col("d") + 1) / (F.col("dislikes") + 2))).alias("weight"))


def preferences(docs: DataFrame, examples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) -> (key, preference): the chance that a document is liked; null with under two examples."""
    weights = token_weights(examples)
    words = docs.select(key, F.explode(tokens("text")).alias("token"))
    sums = words.join(weights, "token").groupBy(key).agg(F.sum("weight").alias("w"))
    prior = examples.agg(F.log((F.count_if(F.col("liked")) + 1) / (F.count_if(~F.col("liked")) + 1)).alias("prior"), F.count("*").alias("n"))
    logit = F.col("prior") + F.coalesce("w", F.lit(0.0))
    return docs.select(key).join(sums, key, "left").crossJoin(F.broadcast(prior)).select(key, F.when(F.col("n") >= 2, 1 / (1 + F.exp(-logit))).alias("preference"))


def whole(x) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.rint(col(x)).cast("int")


def cost_usd(tokens_in, tokens_out, price_in: float = 2.0, price_out: float = 8.0) -> Column:
    return col(tokens_in) / 1e6 * price_in + col(tokens_out) / 1e6 * price_out


def send_gate(status, job_status, contact, invalid_at, blocked, sent_already, sent_today, cap) -> Column:
    """The code of the first check that fails, else ok."""
    return (
        F.when(~col(status).isin("approved", "scheduled", "sending"), "not_approved")
        .when(col(job_status).isin("closed", "skipped", "blacklisted"), "job_closed")
        .when(col(job_status).isin("unverified", "pending_judge"), "job_unverified")
        .when(col(contact).isNull(), "missing_contact")
        .when(col(invalid_at).isNotNull(), "invalid_contact")
        .when(col(blocked), "do_not_contact")
        .when(col(sent_already), "duplicate_outreach")
        .when(col(sent_today) >= col(cap), "daily_cap")
        .otherwise("ok")
    )


def source_action(items, relevant, duplicates, observed_days, least_per_100: float, most_duplicates: float, days: float) -> Column:
    """active or paused: only with 100 items or more and after the days of observation."""
    poor = (col(relevant) / F.greatest(col(items), F.lit(1)) * 100 < least_per_100) | (col(duplicates) / F.greatest(col(items), F.lit(1)) > most_duplicates)
    return F.when((col(items) >= 100) & (col(observed_days) >= days) & poor, "paused").otherwise("active")


def adjusted_tier(current, relevant, failures, success) -> Column:
    up = (col(relevant) > 0) & (col(success) >= 0.9) & (col(failures) == 0)
    down = (col(failures) >= 3) | (col(success) < 0.5)
    return F.when(up, F.when(col(current) == 3, 2).otherwise(1)).when(down, F.when(col(current) == 1, 2).otherwise(3)).otherwise(col(current))


def queue_priority(tier, kind) -> Column:
    base = lookup(V.TIER_PRIORITY, col(tier), 20)
    return F.when(col(kind) == "closed_check", F.greatest(F.lit(1), base - 10)).otherwise(base)


def backoff_seconds(attempts, base: int = 60, most: int = 86_400) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(1), col(attempts))))
