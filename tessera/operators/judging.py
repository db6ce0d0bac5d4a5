"""The judgement of postings: gates, verdicts and score in one select over all jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules, scoring
from tessera.functions.text import text
from tessera.operators.scan import running_sums
from tessera.operators.state import EMAIL_ONLY, plus_seconds
from tessera.shared import stored

#: Reasons, the cost of a paid judgement, minutes until the next try.
BLACKLISTED, DISLIKED = "Company is blacklisted.", "Disliked by {owner}."
OVER_BUDGET = "Monthly LLM budget cap reached; crawling continues."
COST_USD, PARK_MINUTES, RETRY_MINUTES = 0.02, 60, 15
#: What an outside judge tells of a job; null where it was not reached, and the local rules stand in.
EXTERNAL = "struct<role_relevance:double,language_fit:double,remote_scope:string,sponsorship:string,seniority:string,agentic_focus:double,preference_fit:double>"


def within_budget(jobs: DataFrame, pays: Column, order: list[str], spent: float, cap: float, cost: float = COST_USD) -> DataFrame:
    """Jobs with within_budget: whether what was spent, the jobs before it in `order` that pay and its own cost stay under the cap; true for those that do not pay. All jobs are one queue."""
    out = running_sums(jobs.withColumns({"_queue": F.lit(0), "_pays": pays}), ["_queue"], order, _paid=F.when(F.col("_pays"), 1).otherwise(0))
    return out.withColumn("within_budget", ~F.col("_pays") | (F.round(spent + F.col("_paid") * cost, 9) <= cap)).drop("_queue", "_pays", "_paid")


def judged(jobs: DataFrame, now: Column, weights: dict, country_weights: dict, skills: list[str], spent: float = 0.0, cap: float = 30.0, email_only: bool = False, owner: str = "the owner", outside: str = "Judge", order: list[str] | None = None) -> DataFrame:
    """Jobs -> their judgement, one row each: status, skip_reason, score and all that it is made of.

    Needs id, title, jd_text, jd_text_english, location, apply_url, company_blacklisted, feedback, posted_at,
    first_seen_at, preference (of the local model, null if unknown) and external (EXTERNAL). The first of these decides:
    a blacklisted company, a dislike, the prefilter, no address for applications where one is asked for, the month's
    budget; then the verdicts. Later values are null where an earlier gate ended the judgement.

    The budget is a running gate: in the queue's order (`order`, then id) each job that reaches the paid step adds its cost,
    and those that would go over the cap are parked. `owner` and `outside` are the names that reasons tell.
    """
    disliked = DISLIKED.format(owner=owner)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = jobs.withColumns({
        "countries": rules.countries("location"),
        "work_mode": rules.work_mode("location", "jd_text"),
        "_english": F.coalesce(F.nullif(text("jd_text_english"), F.lit("")), text("jd_text")),
        "_gate": rules.prefilter("title", "jd_text"),
    })
    apply = F.coalesce(rules.apply_email("_english", "apply_url"), rules.apply_email("jd_text"))
    signal, whole = rules.new_company_signal("_english"), F.concat(text("title"), F.lit("\n"), F.col("_english"))
    rows = rows.withColumns({"apply": apply, "new_company": signal, "_told": F.col("external").isNotNull(), "_x": F.col("external").cast(EXTERNAL)})
    local = lambda name, value: F.when(F.col("_told"), F.col(f"_x.{name}")).otherwise(value)
    rows = rows.withColumns({
        "role_relevance": local("role_relevance", F.when(rules.role_relevant("_gate.evidence"), 0.8).otherwise(0.0)),
        "language_fit": local("language_fit", F.when(rules.required_language(whole).isNull(), 0.8).otherwise(0.0)),
        "remote_scope": local("remote_scope", rules.remote_scope("title", "_english", "work_mode")),
        "sponsorship": local("sponsorship", rules.sponsorship("title", "_english")),
        "_level": local("seniority", rules.seniority("title", "_english")),
        "agentic_focus": local("agentic_focus", scoring.agentic_focus("title", "_english")),
        "preference_fit": F.when(F.col("_told"), F.when(F.col("_x.preference_fit").isNotNull(), scoring.blend(F.col("_x.preference_fit"), F.col("preference")))).otherwise(F.col("preference")),
    })
    judge = F.when(F.col("_told"), outside).otherwise(f"Local rules ({outside} unreachable)")
    rejected = (
        F.when(F.col("_level") == "graduate", "Graduate or internship level.")
        .when(F.col("role_relevance") < 0.5, F.concat(judge, F.lit(": not an AI software engineering role.")))
        .when(F.col("language_fit") < 0.5, F.concat(judge, F.lit(": needs a language other than English (or is nationality restricted).")))
    )
    unpaid = (
        F.when(flag("company_blacklisted"), BLACKLISTED)
        .when(F.coalesce(F.col("feedback") == "dislike", F.lit(False)), disliked)
        .when(~F.col("_gate.pass"), F.coalesce("_gate.reason", F.lit("Prefilter rejected")))
        .when(F.lit(email_only) & F.col("apply").isNull(), EMAIL_ONLY)
    )
    rows = stored(rows.withColumns({"_unpaid": unpaid, "_rejected": rejected}), "judged")  # once: dealing the queue in ranges samples its rows first
    rows = within_budget(rows, F.col("_unpaid").isNull(), [*(order or []), "id"], spent, cap)
    reason = F.when(F.col("_unpaid").isNotNull(), F.col("_unpaid")).when(~F.col("within_budget"), OVER_BUDGET).otherwise(F.col("_rejected"))
    rows = rows.withColumns({"seniority": F.when(F.col("_level") == "graduate", "unknown").otherwise(F.col("_level")), "skip_reason": reason})
    named = F.get(F.filter("countries", lambda c: c.isin(list(country_weights))), F.lit(0))
    weight = F.when(F.col("remote_scope").isin("remote_global", "remote_apac"), 1.0).otherwise(scoring.lookup(country_weights, F.coalesce(named, F.lit("other")), float(country_weights.get("other", 0.5))))
    since = F.coalesce("posted_at", "first_seen_at")
    rows = rows.withColumn("breakdown", scoring.job_score("role_relevance", "seniority", "remote_scope", "sponsorship", since, scoring.skill_overlap("_english", skills), weight, now, weights))
    final = scoring.final_score(F.col("breakdown.score"), F.col("agentic_focus"), F.col("preference_fit"), F.col("apply").isNotNull(), F.col("new_company").isNotNull())
    parked, early = F.col("skip_reason") == OVER_BUDGET, F.col("skip_reason").isin(BLACKLISTED, disliked, EMAIL_ONLY, OVER_BUDGET) | ~F.col("_gate.pass")
    early = F.coalesce(early, ~F.col("_gate.pass"))
    status = F.when(F.col("skip_reason").isNull(), "targeted").when(F.col("skip_reason") == BLACKLISTED, "blacklisted").when(parked, "pending_judge").otherwise("skipped")
    wait = F.when(parked, PARK_MINUTES).when(~early & ~F.col("_told"), RETRY_MINUTES)
    later = lambda c: F.when(~early, c)
    return rows.select(
        "id", status.alias("status"), "skip_reason", F.when(F.col("skip_reason").isNull(), final).otherwise(0.0).alias("score"), "countries", "work_mode", F.col("_gate.language").alias("language"),
        F.col("_gate.evidence").alias("ai_evidence"), F.col("_gate.language_evidence").alias("language_evidence"), later(F.col("apply")).alias("apply"), later(F.col("new_company")).alias("new_company"),
        *[later(F.col(c)).alias(c) for c in ("remote_scope", "sponsorship", "seniority", "agentic_focus", "preference_fit", "breakdown")],
        F.when(early & ~parked, True).when(~early, F.col("_told")).otherwise(False).alias("verified"), F.when(wait.isNotNull(), plus_seconds(now, wait * 60)).alias("next_judge_at"),
    )


def public_contacts(jobs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Of targets: (id, email, quote) of every public address in the description."""
    return jobs.join(judgements.filter("status = 'targeted'").select("id"), "id", "left_semi").select("id", F.explode(rules.public_emails("jd_text")).alias("c")).select("id", "c.*")
