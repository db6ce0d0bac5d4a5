"""Rules, readers and transitions over small fixture tables, each against the rows that the definitions give."""

from __future__ import annotations

import json
from collections.abc import Callable

import pytest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, rules, scoring, text, urls, views
from tessera.operators import evaluate, judging
from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.sources import feeds, sinks

EXPECTED: dict = {}
TYPES = {"s": "string", "b": "boolean", "i": "bigint", "d": "double"}


def expect(name: str, columns: str, rows: list[tuple], made: Callable) -> None:
    """Register a case that must give these rows; columns are like "id:i why:s"."""
    EXPECTED[name] = [c.split(":") for c in columns.split()], rows, made


def rule(name: str, fields: str, kind: str, cases: list[tuple], column: Callable[[], Column]) -> None:
    """Register a rule over string fields: each case is its fields and what must come out."""
    names = fields.split()
    schema = "id int, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, *c[:-1]) for i, c in enumerate(cases)]
    expect(name, f"id:i out:{kind}", [(i, c[-1]) for i, c in enumerate(cases)], lambda spark: spark.createDataFrame(rows, schema).select("id", column().alias("out")))


GERMAN = "Wir suchen einen Entwickler für unsere Plattform und bauen Produkte mit LLM Systemen für viele Kunden in Europa und Asien."
LLM = "You will build LLM features for our users. English is our working language."

# ---- rules over a title and a description
rule("rule_prefilter", "t b", "s", [
    ("AI Full-Stack Engineer", LLM, None), ("Graduate AI Intern", "LLM", "Excluded title: Graduate AI Intern"), ("Marketing Manager", "LLM", "Excluded title: Marketing Manager"), ("Head Cook", "LLM", "Not an engineering title."),
    ("AI Software Engineer", GERMAN + " Englisch ist Arbeitssprache.", None), ("AI Software Engineer", GERMAN, "Non-English JD does not mention English as a working language."),
    ("AI Engineer", "LLM work for Saudi nationals only", "Saudi-only role."), ("Software Engineer", "We sell shoes to people.", "No AI evidence in the title or description."), (None, None, "Not an engineering title."),
], lambda: rules.prefilter("t", "b")["reason"])
rule("rule_job_language", "t b", "s", [
    ("AI Engineer", LLM, "english"), ("Entwickler", GERMAN, "non_english"), ("", "", "english"), ("a", "こんにちは世界 これは日本語の説明です", "non_english"), (None, "short text", "english"),
    ("x", "The team and the product are in the city and we are on the way to be at your side for all of this", "english"),
], lambda: rules.job_language("t", "b"))
rule("rule_ai_evidence", "t b", "s", [
    ("AI Engineer", "We use LLMs. Other things. RAG too. And LLM agents.", "title:AI Engineer|JD:We use LLMs.|JD:RAG too."), ("Engineer", "We sell shoes.", ""), (None, "LLM", "JD:LLM"),
], lambda: F.array_join(F.transform(rules.ai_evidence("t", "b"), lambda e: F.concat(e["source"], F.lit(":"), e["quote"])), "|"))
rule("rule_role_relevant", "t b", "b", [("AI Engineer", "shoes", True), ("Engineer", "LLM one. Shoes.", False), ("Engineer", "LLM one. LLM two.", True), ("Engineer", "", False)], lambda: rules.role_relevant(rules.ai_evidence("t", "b")))
rule("rule_remote_scope", "t b m", "s", [
    ("AI Engineer", "Work from anywhere.", "remote", "remote_global"), ("x", "y", "hybrid", "onsite"), ("x", "Remote within APAC", "remote", "remote_apac"), ("x", "Remote, US only", "remote", "remote_restricted"), ("x", "y", "remote", "unknown"), (None, None, None, "unknown"),
], lambda: rules.remote_scope("t", "b", "m"))
rule("rule_sponsorship", "t b", "s", [("x", "Visa sponsorship is available.", "yes"), ("x", "We are unable to sponsor", "no"), ("x", "Nothing", "unknown"), (None, None, "unknown")], lambda: rules.sponsorship("t", "b"))
rule("rule_seniority", "t b", "s", [("Staff Engineer", "junior", "lead"), ("Engineer", "3+ years of work", "mid"), ("Senior Engineer", "", "senior"), ("Engineer", "x", "unknown"), ("Junior Engineer", "8+ years", "early"), (None, None, "unknown")], lambda: rules.seniority("t", "b"))
rule("rule_countries", "x", "s", [
    ("Berlin, Germany", "DE"), ("Austin, TX", "US"), ("Toronto, ON", "CA"), ("Remote (GB)", "UK"), ("Springfield, IL", "US"), ("Halifax, NS; Portland, OR", "CA"), ("Zürich or London", "UK,CH"), ("", ""), (None, ""),
], lambda: F.array_join(rules.countries("x"), ","))
rule("rule_work_mode", "l b", "s", [("Hybrid - Paris", "", "hybrid"), ("", "We are remote-first", "remote"), ("Paris", "", "onsite"), (" ", "", "unknown"), ("Remote, EU", "hybrid", "remote"), (None, None, "unknown")], lambda: rules.work_mode("l", "b"))
rule("rule_location_remote", "l", "b", [("Anywhere", True), ("Remote - EU", True), ("Paris", False), (None, False)], lambda: rules.location_remote("l"))
rule("rule_apply_email", "b u", "s", [
    ("Great team. Send your CV to Jobs@acme.dev. Privacy: privacy@acme.dev", "", "jobs@acme.dev"), ("Interested in this role?\nhello@acme.io", "", "hello@acme.io"), ("", "mailto:work%40acme.dev?subject=Hi", "work@acme.dev"), ("", "https://acme.dev/apply", None),
    ("For privacy write to privacy@acme.dev", "", None), ("For an accommodation email your resume to jobs@acme.dev", "", None), ("Send your CV to jobs@acme.invalidtld1", "", None), ("The office manager is ann@acme.dev", "", None), (None, None, None),
], lambda: rules.apply_email("b", "u")["email"])
rule("rule_public_emails", "b", "s", [
    ("Ask Ann@acme.dev. Or bob@acme.dev, or ann@acme.dev again.", "ann@acme.dev<Ask Ann@acme.dev.;bob@acme.dev<Or bob@acme.dev, or ann@acme.dev again."), ("privacy@acme.dev", ""), ("none", ""), (None, ""),
], lambda: F.array_join(F.transform(rules.public_emails("b"), lambda p: F.concat_ws("<", p["email"], p["quote"])), ";"))
rule("rule_plausible_email", "x", "b", [("a@b.io", True), ("@b.io", False), ("a@b.invalidtld1", False), ("a" * 65 + "@b.io", False), (None, False)], lambda: rules.plausible_email("x"))
rule("rule_required_language", "b", "s", [("German C1 is required for this job.", "German C1 is required"), ("German is a plus.", None), ("We speak English.", None), (None, None)], lambda: F.regexp_extract(rules.required_language("b"), "(?i)(German.*required|.*)", 1))
rule("rule_quote_around", "b", "s", [("First. We sponsor visas. Last.", "We sponsor visas."), ("None here.", None), (None, None)], lambda: rules.quote_around("b", "(?:sponsor)"))
rule("rule_reply_class", "x", "s", [("Delivery failed: 550 5.1.1", "bounce"), ("I am Out of Office", "auto_reply"), ("Unfortunately not", "negative"), ("Let us talk", "positive"), (None, "positive")], lambda: rules.reply_class("x"))
rule("rule_link_kind", "u l", "s", [("https://a.io/x", "Apply now", "apply"), ("https://a.io/jobs", "More", "job"), ("https://boards.greenhouse.io/a", "See", "ats"), ("https://a.io/about", "About", "career"), (None, None, "career")], lambda: rules.link_kind("u", "l"))
rule("rule_page_state", "b c", "s", [
    ("please solve the CAPTCHA", "text/html", "wall"), ("captcha", "application/json", "open"), ("We are No Longer Accepting Applications.", "text/html", "closed"), ("x" * 60_001 + "captcha", "text/html", "open"), (None, None, "open"),
], lambda: F.when(rules.bot_wall("b", "c"), "wall").when(rules.posting_closed("b"), "closed").otherwise("open"))
rule("rule_grounded", "q s", "b", [("a b", "x a b y", True), ("a c", "x a b y", False), ("a", None, False)], lambda: rules.grounded(F.array("q"), "s"))
rule("rule_new_company", "b", "s", [("We sell. We are an early-stage startup in Berlin. More.", "We are an early-stage startup in Berlin."), ("Founded in 2024, YC W24.", "Founded in 2024, YC W24."), ("An old bank.", None), (None, None)], lambda: rules.new_company_signal("b"))
rule("rule_title_company", "t c", "s", [("Samsara: Staff: Engineer", None, "Samsara>Staff: Engineer"), ("Acme: Dev", "Other", "Other>Acme: Dev"), ("Dev", None, ">Dev")], lambda: F.concat_ws(">", F.coalesce(rules.title_company("t", "c", ":")["company"], F.lit("")), rules.title_company("t", "c", ":")["title"]))
rule("rule_cv_variant", "t", "s", [("Full Stack AI Engineer", "ai_fullstack"), ("Back-End Dev", "ai_fullstack"), ("AI Engineer", "ai_engineer"), (None, "ai_engineer")], lambda: rules.cv_variant("t"))
rule("rule_role_bucket", "t", "s", [("Machine Learning Engineer", "ML engineer"), ("Gardener", "Software engineer"), (None, "Software engineer")], lambda: rules.role_bucket("t"))
rule("rule_error_class", "k s", "s", [
    ("network", None, "retryable"), ("http", "503", "retryable"), ("http", "429", "retryable"), ("http", "408", "retryable"), ("http", "404", "permanent"), ("body_too_large", None, "retryable"), ("blocked", None, "blocked"), ("robots_denied", None, "blocked"), ("parse", None, "permanent"), (None, "200", None),
], lambda: rules.error_class("k", F.col("s").cast("int")))
rule("rule_skills_found", "b", "s", [("Python, golang and K8s with RAG", "Python,Go,Kubernetes,RAG"), ("we go on", "Go"), ("nothing", ""), (None, "")], lambda: F.array_join(rules.skills_found("b"), ","))

# ---- texts
rule("text_html_blocks", "x", "s", [("&lt;h2&gt;About&lt;/h2&gt;&lt;p&gt;We  build&lt;/p&gt;<ul><li>One</li><li>Two</li></ul>", "## About\nWe build\n• One\n• Two"), ("", ""), (None, "")], lambda: text.html_blocks("x"))
rule("text_strip_html", "x", "s", [("<p>Hello <b>wor</b>ld &amp; &#x41;&#66;&#1114112; you</p><br>end", "Hello world & AB you end"), ("a  b", "a b"), (None, "")], lambda: text.strip_html("x"))
rule("text_page_text", "x", "s", [("<style>p{}</style><p>Hi <i>you</i></p><script>x</script>end", "Hi you\nend"), (None, "")], lambda: text.page_text("x"))
rule("text_readable", "x", "s", [("<ul><li>One</li><li>Two</li></ul><br/><br/><br/><br/>End &amp; more<script>no</script> <b", "- One\n\n- Two\n\nEnd & more"), ("a  \n b", "a\n b"), (None, "")], lambda: text.readable("x"))
rule("text_entities", "x", "s", [("&#x41;&#66;&lt;&nbsp;&apos;", "AB< '"), ("&#0;x&#xD800;y", "xy"), (None, "")], lambda: text.decode_entities("x"))
rule("text_addresses", "x", "s", [("jobs [at] acme [dot] com or ann (at) b.io", "jobs@acme.com or ann@b.io"), ("meet us at the office", "meet us at the office"), ("bob at acme dot io", "bob@acme.io"), (None, "")], lambda: text.plain_addresses("x"))
rule("text_mailto", "x", "s", [("MAILTO:A%40b%2eio?subject=x", "a@b.io"), ("https://a.io", None), (None, None)], lambda: text.mailto("x"))
rule("text_names", "x", "s", [("ada byron lovelace", "AB/ada-byron-lovelace/ada byron lovelace"), ("Acme & Co!", "A&/acme-co/acme co"), (None, "//")], lambda: F.concat_ws("/", text.initials("x"), text.slug("x"), text.component("x")))
rule("text_nfkc", "x", "s", [("ＡＩ Ｅｎｇｉｎｅｅｒ", "AI Engineer"), ("ﬁne ①", "fine 1"), ("plain", "plain"), (None, "")], lambda: text.nfkc("x"))
rule("text_clip", "x", "s", [("abcdefghijkl", "abcdefg..."), ("abcdefghij", "abcdefghij"), (None, None)], lambda: text.clip("x", 10))

# ---- addresses and dates
rule("url_identifier", "u", "s", [("https://x.io/jobs/123-engineer", "123-engineer"), ("https://x.io/a?gh_jid=77", "77"), ("https://x.io/about", None), (None, None)], lambda: urls.identifier("u"))
rule("url_joined", "b l", "s", [("https://a.io/x/y", "/z", "https://a.io/z"), ("https://a.io/x/y", "z", "https://a.io/x/z"), ("https://a.io/x/y", "//c.io/z", "https://c.io/z"), ("https://a.io/x/y", "http://d.io", "http://d.io")], lambda: urls.joined("b", "l"))
rule("url_is_public", "u", "b", [("https://a.io/x", True), ("http://localhost/x", False), ("ftp://a.io", False), (None, False)], lambda: urls.is_public("u"))
rule("url_source_identifier", "e u", "s", [("x1", "https://x.io/jobs/123", "x1"), (" ", "https://x.io/jobs/123", "123"), (None, "https://x.io/", "content:")], lambda: F.regexp_replace(urls.source_identifier("e", "u", F.lit("Acme, Inc"), F.lit("AI Eng."), F.lit("Berlin")), "(?<=content:).*", ""))
rule("url_links", "h", "s", [('<a href="/j">Job <b>one</b></a><a href="#t">no</a><a href="/j">again</a><a href="mailto:a@b.io">m</a>', "https://a.io/j=Job one"), (None, "")], lambda: F.array_join(F.transform(urls.links(F.lit("https://a.io/x"), "h"), lambda x: F.concat_ws("=", x["url"], x["label"])), ","))
rule("url_breaker_key", "u", "s", [("https://A.io/x/y", "a.io"), ("https://boards-api.greenhouse.io/v1/boards/acme/jobs?x=1", "boards-api.greenhouse.io/v1/boards/acme/jobs"), ("https://api.lever.co/v0/postings/acme", "api.lever.co/v0/postings/acme"), (None, None)], lambda: S.breaker_key("u"))
rule("date_parsed", "x", "i", [
    ("2026-10-02T12:30:00Z", 1790944200), ("2026-10-02 12:30:00", 1790944200), ("Fri, 02 Oct 2026 12:30:00 GMT", 1790944200), ("2026-10-02T14:30:00+02:00", 1790944200), ("1790944200", 1790944200), ("1790944200000", 1790944200), ("2026-10-02", 1790899200), ("soon", None), (None, None),
], lambda: F.unix_seconds(dates.parsed("x")))
rule("date_tolerant", "x", "i", [("2026-10-02 12:30:00.376539+07", 1790919000376), ("2026-10-02T12:30:00Z", 1790944200000), ("2026-10-02", 1790899200000), ("x", None), (None, None)], lambda: F.unix_millis(dates.tolerant("x")))
rule("date_zone_of", "x", "s", [("XX,de", "Europe/Berlin"), ("US", "America/New_York"), ("XX", "UTC"), ("", "UTC")], lambda: dates.zone_of(F.split("x", ",")))
rule("date_work_window", "t z", "s", [
    ("2026-10-02 20:00:00", "UTC", "2026-10-05 09:00"), ("2026-10-02 01:00:00", "Asia/Tokyo", "2026-10-02 01:00"), ("2026-03-27 18:00:00", "Europe/Berlin", "2026-03-30 07:00"), ("2026-03-20 18:00:00", "Europe/Berlin", "2026-03-23 08:00"), ("2026-11-01 06:00:00", "America/New_York", "2026-11-02 14:00"),
], lambda: F.date_format(dates.next_work_window(F.to_timestamp("t"), F.col("z")), "yyyy-MM-dd HH:mm"))
rule("date_age_group", "t", "s", [("2026-10-01 12:00:00", "Today"), ("2026-09-28 00:00:00", "This week"), ("2026-09-01 00:00:00", "Older")], lambda: dates.age_group(F.to_timestamp("t"), F.lit("2026-10-02 00:00:00").cast("timestamp")))

# ---- labels and checks of the front end
rule("view_labels", "x", "s", [("0.76", "76 Strong good high"), ("55", "55 Partial mid some"), ("0.1", "10 Weak low low")], lambda: F.concat_ws(" ", views.percent(F.col("x").cast("double")).cast("string"), views.fit_word(views.percent(F.col("x").cast("double"))), views.score_band(views.percent(F.col("x").cast("double"))), F.regexp_extract(views.agentic_label(F.col("x").cast("double")), r"(\w+)$", 1)))
rule("view_contact", "e u q", "s", [("a@b.io", "https://b.io", "write a@b.io", None), ("ab.io", "https://b.io", "ab.io", "invalid_email"), ("a@b.io", "https://b.io", "write", "email_not_evidenced"), ("a@b.io", "ftp://b.io", "a@b.io", "invalid_contact_source")], lambda: views.contact_fault("e", "u", "q"))
rule("view_contact_verdict", "i v", "s", [("x", "true", "invalid"), (None, "true", "valid"), (None, "false", "invalid"), (None, None, "unverified")], lambda: views.contact_verdict("i", F.col("v").cast("boolean")))
rule("view_own_domain", "e c", "b", [("a@acme.io", "Acme Inc", True), ("a@mail.acmecorp.com", "Acme", True), ("a@b.io", "Acme", False), ("a@x.io", "X", False)], lambda: views.own_domain("e", "c"))
rule("view_recruiters", "x", "s", [("ann@acme.io, privacy@acme.io first.last@acme.io bob@other.io ANN@acme.io.", "ann@acme.io"), (None, "")], lambda: F.array_join(views.recruiter_addresses("x", F.lit("Acme")), ","))
rule("view_reader_kind", "a m u", "s", [("Greenhouse", None, None, "greenhouse"), (None, "rss", None, "rss"), (None, None, "https://jobs.lever.co/x", "lever"), (None, "custom_adapter", "https://x.myworkdayjobs.com", "workday"), (None, "odd", None, None), (None, None, None, None)], lambda: views.reader_kind("a", "m", "u"))
rule("view_listing_url", "x", "b", [("https://a.io/jobs/", True), ("https://a.io/jobs/77-dev", False), ("https://a.io/search?q=1", True), (None, False)], lambda: views.listing_url("x"))
rule("view_without_pictographs", "x", "s", [("Go 🚀 now ❤️", "Go now"), ("5 * # 1", "5 * # 1"), (None, "")], lambda: views.without_pictographs("x"))

rule("view_place_label", "l c", "s", [
    ("London, England", "UK", "London, UK"), ("San Francisco, CA; New York, NY; Austin, TX", "US", "San Francisco, US +2"), ("Singapore", "SG", "Singapore"), ("Remote - France, Germany, Spain", None, "3 countries"), ("Remote (EMEA)", "DE", "Germany"), ("", "DE", "Germany"), (None, None, "Location not stated"),
    ("Europe, APAC", None, "2 regions"), ("Europe", None, "Europe"), ("Berlin or Munich", "DE", "Berlin, Germany +1"), ("UK and Ireland", None, "UK and Ireland"), ("Seattle US", None, "Seattle, US"), ("3 days in office", None, "Location varies"), ("Northern America", "Remote", "Northern America"), ("Toronto, CA", "CA", "Toronto, Canada"),
], lambda: views.place_label("l", "c"))
rule("view_page_record", "h", "s", [('<title> A  page</title><meta property="og:site_name" content="Acme"><style>x</style><p>Hi <i>you</i></p>', "A page|Acme|A page\nHi you"), ("plain", "||plain"), (None, "||")], lambda: F.concat_ws("|", views.page_record("h")["title"], F.coalesce(views.page_record("h")["site_name"], F.lit("")), views.page_record("h")["text"]))
rule("view_last_crawl", "a b c", "s", [("2026-10-01 20:00:00", None, "2026-10-01 10:00:00", "20 false"), (None, None, "2026-10-01 17:59:00", "17 true"), (None, None, None, "true")], lambda: F.concat_ws(" ", *[f(views.last_crawl([F.to_timestamp(k) for k in "abc"], F.lit("2026-10-02 00:00:00").cast("timestamp"))) for f in (lambda x: F.hour(x["latest"]).cast("string"), lambda x: x["idle"].cast("string"))]))
rule("view_fit_lines", "a b c", "s", [("0.5", "0.9", None, "seniority 90,role fit 50"), (None, None, None, ""), ("0.7", "0.7", "1", "freshness 100,role fit 70,seniority 70")], lambda: F.array_join(F.transform(views.fit_lines({k: F.col(c).cast("double") for k, c in (("roleFit", "a"), ("seniority", "b"), ("freshness", "c"))}), lambda x: F.concat_ws(" ", x["label"], x["percent"].cast("int").cast("string"))), ","))
rule("view_apply_first", "a b", "s", [("hr", "apply", "apply,hr"), (None, "apply", "apply,"), ("x", "y", "x,y")], lambda: F.array_join(F.transform(views.apply_first(F.array(F.struct(F.col("a").alias("role")), F.struct(F.col("b").alias("role")))), lambda c: F.coalesce(c["role"], F.lit(""))), ","))

# ---- numbers
rule("score_backoff", "n", "d", [("0", 60.0), ("1", 60.0), ("7", 3840.0), ("20", 86400.0)], lambda: scoring.backoff_seconds(F.col("n").cast("int"), 30))
rule("score_rest", "n b", "d", [("0", "false", 30.0), ("1", "false", 60.0), ("1", "true", 900.0), ("30", "false", 86400.0), ("30", "true", 86400.0)], lambda: S.open_circuit(F.col("n").cast("int"), F.col("b").cast("boolean")))
rule("score_agentic_focus", "t b", "d", [("Engineer", "LLM and RAG with agents", 0.59), ("Agentic Engineer", "", 0.9), ("x", "", 0.35), (None, None, 0.35)], lambda: F.round(scoring.agentic_focus("t", "b"), 6))
rule("score_skill_overlap", "b", "d", [("Python and C++!", 0.625), ("x", 0.5), (None, 0.5)], lambda: scoring.skill_overlap("b", ["python", "c++"]))
rule("score_final", "s f p e n", "d", [("80", "1", None, "true", "true", 100.0), ("50", "0", "0.5", "false", "false", 28.0), ("50", "1", None, "false", "true", 60.0)], lambda: scoring.final_score(*[F.col(c).cast("double") for c in "sfp"], F.col("e").cast("boolean"), F.col("n").cast("boolean")))
rule("score_cost_and_blend", "a b", "s", [("1000000", "500000", "6.0"), ("0", "0", "0.0")], lambda: scoring.cost_usd(F.col("a").cast("double"), F.col("b").cast("double")).cast("string"))
rule("score_source_action", "i r d o", "s", [("50", "0", "0", "30", "active"), ("200", "1", "0", "30", "paused"), ("200", "9", "0", "30", "active"), ("200", "9", "150", "30", "paused"), ("200", "1", "0", "3", "active")], lambda: scoring.source_action(*[F.col(c).cast("double") for c in "irdo"], 2.0, 0.5, 7.0))
rule("score_tier", "c r f s", "i", [("3", "5", "0", "0.95", 2), ("1", "0", "3", "0.9", 2), ("2", "0", "0", "0.6", 2), ("2", "1", "0", "1", 1), ("3", "0", "0", "0.4", 3)], lambda: scoring.adjusted_tier(*[F.col(c).cast("double") for c in "crfs"]))
rule("search_plan", "i", "s", [
    ("0", '"AI engineer" Singapore "send your CV"'), ("1", 'site:linkedin.com/posts "AI software engineer" Singapore hiring "send your CV"'), ("7", '"AI engineer" Dubai ("seed" OR "series A" OR "founding engineer") "send your CV"'),
    ("106", '"AI software engineer" Singapore startup hiring "send your resume"'), ("629", 'site:linkedin.com/posts "machine learning engineer" remote hiring "hiring@"'), ("2519", '"machine learning engineer" remote ("seed" OR "series A" OR "founding engineer") "hiring@"'),
], lambda: rules.search_query(F.col("i").cast("long")))
rule("search_turn", "c", "s", [(None, "0>1"), ("2519", "2519>2520"), ("2520", "0>1")], lambda: F.concat_ws(">", *[S.search_turn(F.col("c").cast("long"), 630)[k].cast("string") for k in ("query", "next")]))


# ---- evaluator
CASES = [
    ("a", "Senior AI Engineer", "You will build LLM agents in production with our team.", "DE", True, "TP"), ("b", "ML Engineer", "Own inference services in production for the platform.", "DE", True, "TP"), ("c", "AI Engineer", "We build LLM tools. German C1 required.", "DE", False, "TN"),
    ("d", "AI Trainer", "Label data for LLM engineers as an AI trainer.", "US", False, "TN"), ("e", "Sales Lead", "Sell the AI platform to engineers.", "US", False, "TN"), ("f", "AI Engineer", "We build LLM tools. German is a plus.", "US", False, "FP"),
    ("g", "AI-Entwickler Software", "Wir suchen erfahrung für LLM. Nous recherchons avec expérience. Englisch Software.", "US", True, "TP"), ("h", "Accountant", "Keep the books of the team.", "US", True, "FN"), ("i", "ＡＩ Ｅｎｇｉｎｅｅｒ", "You will build ＬＬＭ agents with our team.", "FR", True, "TP"),
]


def cases(spark) -> DataFrame:
    return evaluate.evaluated(spark.createDataFrame([(*c[:5], "r", None) for c in CASES], "id string, title string, description string, country string, label boolean, reason string, seniority string"))


expect("case_outcomes", "id:s outcome:s", [(c[0], c[5]) for c in CASES], cases)
expect("case_metrics", "country:s tp:i fp:i fn:i tn:i accuracy:d", [(None, 4, 1, 1, 3, 0.777778), ("DE", 2, 0, 0, 1, 1.0), ("US", 1, 1, 1, 2, 0.6), ("FR", 1, 0, 0, 0, 1.0)], lambda spark: evaluate.metrics(cases(spark), ["country"]).withColumn("accuracy", F.round("accuracy", 6)))


# ---- readers
def bodies(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame([(x, "https://w.io/x") for x in texts], "body string, base_url string")


POSTING = {"@type": "JobPosting", "title": "Dev", "url": "https://a.io/jobs/123", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Berlin", "addressCountry": "DE"}}, "datePosted": "2026-10-02"}
NESTED = {"@graph": [{"@graph": [POSTING]}, [POSTING | {"@type": ["Thing", "jobposting"], "title": "Two", "url": "https://a.io/jobs/124"}], {"@type": "Person"}, POSTING | {"title": "Three", "url": "https://a.io/jobs/125", "@graph": [POSTING | {"title": "Inner"}]}]}
PAGE = '<p>hr@a.io</p><script type="application/ld+json">' + json.dumps(NESTED) + '</script><script type="application/ld+json">' + json.dumps([[POSTING | {"title": "Four", "url": "https://a.io/jobs/126"}]]) + "</script>"
expect("reader_json_ld", "title:s url:s company:s location:s external_id:s", [(t, f"https://a.io/jobs/{n}", "Acme", "Berlin, DE", str(n)) for t, n in (("Dev", 123), ("Two", 124), ("Three", 125), ("Four", 126))], lambda spark: feeds.json_ld(bodies(spark, PAGE)))
GREENHOUSE = {"jobs": [{"id": 7, "title": "AI Engineer", "absolute_url": "https://b.io/jobs/7", "updated_at": "2026-10-02T00:00:00Z", "location": {"name": "Berlin"}, "content": "&lt;p&gt;Hi jobs@b.io&lt;/p&gt;"}, {"id": 8, "title": ""}]}
expect("reader_greenhouse", "title:s external_id:s location:s description:s emails:s", [("AI Engineer", "7", "Berlin", "Hi jobs@b.io", "jobs@b.io")], lambda spark: feeds.board(bodies(spark, json.dumps(GREENHOUSE)), "greenhouse").withColumn("emails", F.array_join("emails", ",")))
WORKDAY = {"jobPostings": [{"title": "Dev", "externalPath": "/job/a/b"}, {"title": "Ops", "externalPath": "/job/c", "jobPostingId": "P1"}]}
expect("reader_workday", "title:s url:s external_id:s", [("Dev", "https://w.io/job/a/b", "job:a:b"), ("Ops", "https://w.io/job/c", "P1")], lambda spark: feeds.board(bodies(spark, json.dumps(WORKDAY)), "workday"))
expect("reader_workday_offset", "id:i offset:i", [(1, 22)], lambda spark: feeds.next_offset(spark.createDataFrame([(1, json.dumps(WORKDAY), 20), (2, '{"jobPostings": []}', 40), (3, "x", 0)], "id int, body string, offset int"), 2))
GENERIC = {"next": "p2", "data": {"items": [{"t": {"value": "Dev"}, "u": ["https://a.io/1"]}, {"t": "no address"}, {"title": "other field", "u": "https://a.io/3"}]}}
expect("reader_json", "title:s url:s next_page:s", [("Dev", "https://a.io/1", "p2")], lambda spark: feeds.board(bodies(spark, json.dumps(GENERIC)), "json", {"items": feeds.path("data.items"), "title": ["$.t"], "url": ["$.u"], "next_page": "$.next"}))
RSS = "<rss><channel><item><title>Dev &amp; more</title><link>https://a.io/1</link><guid>g1</guid><description><![CDATA[<p>Hi</p>]]></description><pubDate>Fri, 02 Oct 2026 00:00:00 GMT</pubDate></item></channel></rss>"
ATOM = '<feed><entry><title>Two</title><link href="https://a.io/2"/><id>i2</id><updated>2026-10-02T00:00:00Z</updated></entry></feed>'
expect("reader_rss", "url:s external_id:s at:i", [("https://a.io/1", "g1", 1790899200), ("https://a.io/2", "i2", 1790899200)], lambda spark: feeds.rss(bodies(spark, RSS, ATOM)).withColumn("at", F.unix_seconds("posted_at")))
expect("reader_sitemap", "url:s", [("https://a.io/1",), ("https://a.io/2?a=1&b=2",)], lambda spark: feeds.sitemap(bodies(spark, "<urlset><url><loc>https://a.io/1</loc></url><url><loc> ftp://x </loc></url><url><loc>https://a.io/2?a=1&amp;b=2</loc></url></urlset>")))
THREAD = {"children": [{"id": 5, "created_at": "2026-10-02T00:00:00Z", "text": "Acme | AI Dev | Berlin | Remote<p>Mail jobs [at] acme [dot] dev"}, {"id": 6, "text": "no format"}]}
expect("reader_thread", "company:s title:s location:s external_id:s emails:s", [("Acme", "AI Dev", "Berlin | Remote", "hn-5", "jobs@acme.dev")], lambda spark: feeds.hiring_thread(bodies(spark, json.dumps(THREAD))).withColumn("emails", F.array_join("emails", ",")))
HITS = {"hits": [{"title": "Ask: Who is hiring? (October)", "objectID": "3"}, {"title": "Show", "objectID": "4"}, {"title": "WHO IS HIRING (Sept)", "objectID": "2"}, {"title": "who is hiring", "objectID": "1"}]}
expect("reader_thread_choice", "thread_id:s", [("3",), ("2",)], lambda spark: feeds.hiring_threads(bodies(spark, json.dumps(HITS))))
CSV = 'id,title,url,company\r\n,Dev,https://a.io/1,"Acme, ""Inc""\nBerlin"\r\n\r\n7,Ops,https://a.io/2,\r\n8,Long,https://a.io/3,"' + 'x""' * 40_000 + '"'
expect("reader_csv", "title:s url:s company:s n:i", [("Dev", "https://a.io/1", 'Acme, "Inc"\nBerlin', 18), ("Ops", "https://a.io/2", None, 0), ("Long", "https://a.io/3", 'x"x"x"x"x"x"x"x"x"x"', 80_000)], lambda spark: feeds.csv_rows(bodies(spark, CSV), {"title": "title", "url": 2, "company": "company"}).withColumn("n", F.coalesce(F.char_length("company"), F.lit(0))).withColumn("company", F.substring("company", 1, 20)))
ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nUser-agent: bot\nUser-agent: other\nDisallow: /*.pdf$\n"
PATHS = ["/private/x", "/private/open/y", "/f.pdf", "/z"]


def asked(spark) -> DataFrame:
    return spark.createDataFrame([("a.io", p) for p in PATHS] + [("b.io", "/private")], "host string, path string")


def robots(spark) -> DataFrame:
    return spark.createDataFrame([("a.io", ROBOTS)], "host string, body string")


for agent, denied in (("crawler", {"/private/x"}), ("mybot", {"/f.pdf"})):
    expect(f"robots_{agent}", "host:s path:s allowed:b", [("a.io", p, p not in denied) for p in PATHS] + [("b.io", "/private", True)], lambda spark, agent=agent: feeds.allowed(asked(spark), feeds.robots(robots(spark)), agent))
expect("robots_simple", "host:s path:s allowed:b", [("a.io", p, not p.startswith("/private")) for p in PATHS] + [("b.io", "/private", True)], lambda spark: feeds.simply_allowed(asked(spark), feeds.simple_robots(robots(spark))))
for board, tries in {
    "greenhouse": [("https://boards.greenhouse.io/acme/jobs/1", "{}", "https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true"), ("https://x.io", '{"board_token": " b "}', "https://boards-api.greenhouse.io/v1/boards/b/jobs?content=true"), ("https://x.io/v1/boards/c/jobs", None, "https://boards-api.greenhouse.io/v1/boards/c/jobs?content=true"), ("https://x.io/a", None, None)],
    "lever": [("https://jobs.lever.co/acme", None, "https://api.lever.co/v0/postings/acme?mode=json"), ("https://api.lever.co/v0/postings/z", None, "https://api.lever.co/v0/postings/z"), ("https://x.io", '{"org": "o"}', "https://api.lever.co/v0/postings/o?mode=json"), ("https://x.io/a", "{}", None)],
    "ashby": [("https://jobs.ashbyhq.com/acme", None, "https://api.ashbyhq.com/posting-api/job-board/acme?includeCompensation=true"), ("https://x.io", '{"board": "b"}', "https://api.ashbyhq.com/posting-api/job-board/b?includeCompensation=true")],
    "workday": [("https://a.wd1.myworkdayjobs.com/x", '{"tenant": "t", "site": "s"}', "https://a.wd1.myworkdayjobs.com/wday/cxs/t/s/jobs"), ("https://a.io/wday/cxs/t/s/jobs", None, "https://a.io/wday/cxs/t/s/jobs"), ("https://a.io/x", "{}", None)],
}.items():
    rule(f"endpoint_{board}", "u c", "s", tries, lambda board=board: feeds.endpoint(board, "u", "c"))
PROBES = [("acme-labs", "lever", '[{"id": 1}]'), ("acme-labs", "ashby", '{"jobs": []}'), ("big", "greenhouse", '{"jobs": [{"company_name": "Big Co"}, {}]}'), ("big", "ashby", '{"jobs": [{}]}'), ("none", "lever", "{}"), ("up_Case", "ashby", '{"jobs": [{}]}')]
expect("board_probe", "slug:s kind:s jobs:i company:s", [("acme-labs", "lever", 1, "Acme Labs"), ("big", "greenhouse", 2, "Big Co"), ("up_Case", "ashby", 1, "Up Case")], lambda spark: feeds.first_board(spark.createDataFrame(PROBES, "slug string, kind string, body string")))
BRAVE = {"web": {"results": [{"url": "https://a.io", "title": "A", "description": "one <b>two</b>", "extra_snippets": ["three", "four"]}, {"url": "https://b.io"}]}}
expect("search_hits_brave", "at:i url:s title:s snippet:s", [(0, "https://a.io", "A", "one two three four"), (1, "https://b.io", "", "")], lambda spark: feeds.search_hits(bodies(spark, json.dumps(BRAVE)), "brave"))
MARKDOWN = "[Yahoo home](https://www.yahoo.com/) [**AI** \\- jobs](https://r.search.x/RU=https%3a%2f%2fa.io%2f1/RK=2) Send *your* CV [more](https://b.io/2) now [again](https://a.io/1) end"
expect("search_hits_markdown", "at:i url:s title:s snippet:s", [(0, "https://a.io/1", "AI - jobs", "Send your CV now end"), (1, "https://b.io/2", "more", "now end")], lambda spark: feeds.markdown_hits(bodies(spark, MARKDOWN)))

# ---- transitions
NOW, MICRO = "2026-10-02 00:00:00", 1790899200


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def seconds(name: str) -> Column:
    return F.unix_seconds(name)


SOURCES = [("a", "c1", 0, None, None), ("b", "c1", 2, None, "old"), ("c", "c2", 1, None, None), ("d", "c3", 5, "2026-10-01 00:00:00", "x")]


def sources(spark) -> DataFrame:
    return spark.createDataFrame(SOURCES, "id string, company_id string, fail_count int, until string, last_error string").select("id", "company_id", "fail_count", F.to_timestamp("until").alias("blocked_until"), "last_error")


ENDS = [("a", False, "e1"), ("b", False, "e2"), ("c", True, "e3")]
expect("source_failures", "id:s fail_count:i until:i last_error:s", [("a", 1, None, "e1"), ("b", 3, MICRO + 86400, "e2"), ("c", 2, MICRO + 86400, "e3"), ("d", 5, MICRO - 86400, "x")], lambda spark: S.source_failures(sources(spark), spark.createDataFrame(ENDS, "id string, blocked boolean, error string"), now()).withColumn("until", seconds("blocked_until")))
expect("source_successes", "id:s fail_count:i until:i last_error:s", [("a", 0, None, None), ("b", 0, None, None), ("c", 1, None, None), ("d", 0, None, None)], lambda spark: S.source_successes(sources(spark), spark.createDataFrame([("b",), ("d",)], "id string")).withColumn("until", seconds("blocked_until")))
expect("company_health", "id:s health:s", [("c1", "failing"), ("c2", "blocked"), ("c3", "ok"), ("c4", "ok")], lambda spark: S.company_health(spark.createDataFrame([("c1", "ok"), ("c2", "ok"), ("c3", "blocked"), ("c4", "ok")], "id string, health string"), sources(spark), spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, True), ("d", True, False)], "id string, ok boolean, blocked boolean")))
expect("sightings", "job_id:i source_id:s url:s at:i", [(1, "a", "u2", MICRO), (1, "b", "v", MICRO - 86400), (2, "a", "w", MICRO)], lambda spark: S.upsert_sightings(spark.createDataFrame([(1, "a", "u"), (1, "b", "v")], "job_id int, source_id string, url string").withColumn("seen_at", F.lit("2026-10-01").cast("timestamp")), spark.createDataFrame([(1, "a", "u1", 0), (1, "a", "u2", 1), (2, "a", "w", 0)], "job_id int, source_id string, url string, position int"), now()).withColumn("at", seconds("seen_at")))
JOBS = [(1, "new", True, False, None, "2026-10-01", 0), (2, "targeted", True, True, None, "2026-09-01", 0), (3, "targeted", True, False, None, "2026-10-01", 0), (4, "targeted", False, False, None, None, 0), (5, "new", True, False, "2026-10-01", "2026-10-01", 0), (6, "pending_judge", True, False, None, "2026-10-01", 60)]


def jobs(spark) -> DataFrame:
    rows = spark.createDataFrame(JOBS, "id int, status string, verified boolean, needs_rescore boolean, closed string, posted string, wait int")
    return rows.select("id", "status", F.lit(None).cast("string").alias("skip_reason"), "verified", "needs_rescore", F.to_timestamp("closed").alias("closed_at"), F.to_timestamp("posted").alias("posted_at"), F.lit("2026-09-15").cast("timestamp").alias("first_seen_at"), S.plus_seconds(now(), F.col("wait")).alias("next_judge_at"))


expect("judge_queue", "id:i", [(2,), (1,), (4,)], lambda spark: S.judge_queue(jobs(spark), now()))
expect("judge_queue_first", "id:i", [(2,)], lambda spark: S.judge_queue(jobs(spark), now(), 1))
expect("judge_park", "id:i status:s skip_reason:s at:i", [(1, "pending_judge", "budget", MICRO + 3600), (2, "targeted", None, MICRO + 900), (3, "targeted", None, MICRO), (4, "targeted", None, MICRO), (5, "new", None, MICRO), (6, "pending_judge", None, MICRO + 60)], lambda spark: S.park(jobs(spark), spark.createDataFrame([(1, "pending_judge", "budget", 60), (2, None, None, 15)], "id int, status string, reason string, minutes int"), now()).withColumn("at", seconds("next_judge_at")))
expect("feedback_latest", "job_id:i verdict:s at:i", [(1, "like", 3), (2, "dislike", 1), (3, "like", 2)], lambda spark: S.upsert_feedback(spark.createDataFrame([(1, "dislike", 1), (2, "dislike", 1)], "job_id int, verdict string, at int"), spark.createDataFrame([(1, "like", 3), (3, "like", 2)], "job_id int, verdict string, at int")))
expect("do_not_contact", "email_or_domain:s reason:s", [("a.io", "old"), ("b.io", "Blacklisted from dashboard"), ("company:c co", "Blacklisted from dashboard")], lambda spark: S.do_not_contact(spark.createDataFrame([("a.io", "old")], "email_or_domain string, reason string"), spark.createDataFrame([("A", "a.io"), ("B", "b.io"), ("C Co", None)], "name string, domain string")))
expect("patched_rows", "id:i status:s error:s", [(1, "paused", "e"), (2, "active", None), (3, "active", "e")], lambda spark: S.patched(spark.createDataFrame([(i, "active", "e") for i in (1, 2, 3)], "id int, status string, error string"), spark.createDataFrame([(1, ["status"], "paused", None), (2, ["error"], None, None)], "id int, set array<string>, status string, error string"), "id", ["status", "error"]))
YIELDS = [("a", None, None, False, False, 5), ("a", 10, 2, True, True, 7), ("b", None, 1, False, False, 1)]
expect("yield_stats", "id:s items_seen:i relevant_jobs:i duplicate_jobs:i failures:i first_yield_at:i last_yield_at:i", [("a", 111, 5, 1, 1, 1, 7), ("b", 1, 1, 0, 0, 1, 1), ("c", 4, 0, 0, 0, None, None)], lambda spark: S.yield_stats(spark.createDataFrame([("a", 100, 3, 0, 0, 1, 2), ("c", 4, 0, 0, 0, None, None)], "id string, items_seen long, relevant_jobs long, duplicate_jobs long, failures long, first_yield_at int, last_yield_at int"), spark.createDataFrame(YIELDS, "id string, items int, relevant int, duplicate boolean, failed boolean, at int")))
SEED = [("k1", "One", "candidate"), ("k2", "Two", "active")]


def seeded_twice(spark) -> DataFrame:
    seed = spark.createDataFrame(SEED, "seed_key string, name string, status string")
    return S.seeded(S.seeded(spark.createDataFrame([("k1", "Old", "paused"), ("k9", "Nine", "active")], seed.schema), seed), seed)


expect("seed_twice", "seed_key:s name:s status:s", [("k1", "One", "paused"), ("k2", "Two", "active"), ("k9", "Nine", "active")], seeded_twice)
DUE = [("a", 1, -10, 10, None), ("b", 1, 10, -20, None), ("c", 2, -30, -40, None), ("d", 1, -10, -10, 99), ("e", 3, 5, 5, None)]


def due(spark) -> DataFrame:
    at = lambda c: S.plus_seconds(now(), F.col(c))
    return spark.createDataFrame(DUE, "id string, tier int, n int, k int, b int").select("id", "tier", at("n").alias("next_due_at"), at("k").alias("closed_due_at"), F.when(F.col("b").isNotNull(), at("b")).alias("blocked_until"))


expect("schedule_both_kinds", "dedupe_key:s kind:s source_id:s", [("closed_check:b:2026-10-01T23:59:40", "closed_check", "b"), ("crawl:a:2026-10-01T23:59:50", "crawl", "a"), ("crawl:c:2026-10-01T23:59:30", "crawl", "c"), ("closed_check:c:2026-10-01T23:59:20", "closed_check", "c")], lambda spark: S.schedule(due(spark), now()))
expect("schedule_first_two", "source_id:s", [("b",), ("a",)], lambda spark: S.schedule(due(spark), now(), 2))
REQUESTS = [("https://a.io/1", 1, False, False), ("https://a.io/2", 2, True, False), ("https://a.io/3", 3, False, False), ("https://a.io/4", 4, False, False), ("https://api.lever.co/v0/postings/x", 1, False, True), ("https://api.lever.co/v0/postings/y", 1, True, False)]
expect("breaker_rests", "key:s streak:i at:i", [("a.io", 2, MICRO + 4 + 120), ("api.lever.co/v0/postings/x", 1, MICRO + 1 + 900)], lambda spark: S.circuits(spark.createDataFrame(REQUESTS, "url string, s int, ok boolean, blocked boolean").withColumn("at", S.plus_seconds(now(), F.col("s")))).withColumn("at", seconds("rests_until")))
COSTS = [(1, "2026-10-01 10:00:00", 29.99), (2, "2026-10-05 09:00:00", 0.01), (3, "2026-10-05 09:30:00", 0.02), (4, "2026-11-01 00:00:00", 30.0), (5, "2026-11-01 00:00:00", 0.5)]
expect("budget_of_months", "id:i spent:d fits:b", [(1, 29.99, True), (2, 30.0, True), (3, 30.02, False), (4, 30.0, True), (5, 30.5, False)], lambda spark: R.budget_gate(spark.createDataFrame(COSTS, "id int, at string, cost double").withColumn("at", F.to_timestamp("at")), "at", "cost", 30.0, "id").withColumn("spent", F.round("spent", 6)))
OUTREACH = [(1, 1, "initial", "draft", None), (2, 2, "initial", "approved", None), (3, 3, "initial", "sent", -700_000), (4, 4, "initial", "sent", -700_000), (5, 4, "followup", "scheduled", None), (6, 5, "initial", "sent", -100), (7, 6, "initial", "replied", -900_000)]


def outreach(spark) -> DataFrame:
    return spark.createDataFrame(OUTREACH, "id int, job_id int, kind string, status string, s int").withColumn("sent_at", F.when(F.col("s").isNotNull(), S.plus_seconds(now(), F.col("s"))))


for name, ids in (("drafts", [1]), ("scheduled", [2, 5]), ("sent", [3, 4, 6]), ("replied", [7]), ("followup_due", [3])):
    expect(f"tab_{name}", "id:i", [(i,) for i in ids], lambda spark, name=name: R.tab(outreach(spark), name, now()))
expect("tab_by_kind", "id:i", [(5,)], lambda spark: R.tab(outreach(spark), "scheduled", now(), kind="followup"))
expect("found_in_companies", "id:i", [(1,), (3,)], lambda spark: R.found_in(spark.createDataFrame([(1, "Acme", "Berlin", "ok"), (2, "Other", None, "ok"), (3, "Big", "acme.io", "failing")], "id int, name string, city string, health string"), ["name", "city"], " ACME "))
expect("found_in_healthy", "id:i", [(1,)], lambda spark: R.found_in(spark.createDataFrame([(1, "Acme", "ok"), (3, "acme", "failing")], "id int, name string, health string"), ["name"], "acme", "ok"))
expect("targets_by_age", "group:s ids:s", [("Today", "3,1"), ("Older", "2")], lambda spark: views.by_age(spark.createDataFrame([(1, 2, "2026-10-01 12:00:00"), (2, 3, "2026-08-01 00:00:00"), (3, 1, "2026-10-01 13:00:00")], "id int, position int, at string").select("id", "position", F.to_timestamp("at").alias("posted_at"), F.lit(None).cast("timestamp").alias("first_seen_at")), now()).withColumn("ids", F.array_join("ids", ",")))
expect("target_countries", "country:s", [("DE",), ("US",)], lambda spark: views.country_list(spark.createDataFrame([("US",), ("DE",), ("US",), (None,), ("",)], "country string")))
expect("live_and_failing", "live:i failing:i", [(1, 2)], lambda spark: views.live_and_failing(spark.createDataFrame([("active",), ("paused",)], "status string"), spark.createDataFrame([("ok",), ("failing",), (None,)], "health string")))
expect("sent_today", "sent_today:i", [(1,)], lambda spark: views.sent_today(spark.createDataFrame([("2026-10-01 23:30:00",), ("2026-10-01 20:00:00",), (None,)], "at string").select(F.to_timestamp("at").alias("sent_at")), now(), "Europe/Berlin"))
expect("week_totals", "posted:i targeted:i top:i", [(5, 1, 4)], lambda spark: views.week_totals(spark.createDataFrame([(4, 1), (1, 0)], "discovered long, targeted long")))
expect("new_since_refresh", "id:i", [(3,)], lambda spark: R.without_overlap(spark.createDataFrame([(1,), (3,)], "id int"), spark.createDataFrame([(1,), (2,)], "id int"), "id"))
expect("queue_depth", "depth:i", [(3,)], lambda spark: R.queue_depth(spark.createDataFrame([("queued",), ("leased",), ("done",), ("queued",)], "status string")))
BODIES = [("Python and Rust",), ("python only",), ("Kubernetes, k8s",), ("nothing",), (None,)]
expect("skill_demand_table", "skill:s n:i in_cv:b", [("Python", 2, True), ("Rust", 1, False), ("Kubernetes", 1, False)], lambda spark: rules.skill_demand(spark.createDataFrame(BODIES, "b string"), "b", ["Python 3"]))
expect("config_merged", "id:i out:s", [(1, "a=1,b=9,c=3"), (2, "a=1")], lambda spark: spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"b": "9", "c": "3"}), (2, {"a": "1"}, {})], "id int, base map<string,string>, patch map<string,string>").select("id", F.array_join(F.array_sort(F.transform(F.map_entries(S.merged_config(F.col("base"), F.col("patch"))), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("out")))
expect("paused_sources", "id:i until:s", [(1, "9999-12-31"), (2, "2026-10-02"), (3, "2026-10-09")], lambda spark: spark.createDataFrame([(1, True, "2026-10-09"), (2, False, "9999-12-31"), (3, False, "2026-10-09")], "id int, paused boolean, due string").select("id", F.date_format(S.paused_until(F.col("paused"), F.to_timestamp("due"), now()), "yyyy-MM-dd").alias("until")))
expect("distinct_firsts", "key:s position:i", [("a", 1), ("b", 2)], lambda spark: R.distinct_pairs(spark.createDataFrame([("a", 3), ("b", 2), ("a", 1)], "key string, position int"), "key"))
expect("error_envelopes", "j:s", [('{"ok":false,"error":{"code":"not_found","message":"no x"}}',)], lambda spark: spark.createDataFrame([("no x",)], "m string").select(sinks.error_envelope("not_found", F.col("m")).alias("j")))

# ---- the judgement
WEIGHTS = {"seniority": {"mid": 1.0, "senior": 0.8}, "modeVisa": {"remote_global": 1.0, "remote_restricted": 0.2, "sponsor_unknown": 0.6}, "freshnessDays": [(2, 1.0), (7, 0.8)]}
GOOD = "You will build LLM features. We ship RAG agents. 3+ years of work. Work from anywhere. English is our working language."
POSTINGS = [
    ("targeted", "AI Engineer", GOOD, "Berlin, Germany", None, False, None, None), ("mail", "AI Engineer", GOOD + " Send your CV to jobs@acme.dev.", "Berlin, Germany", None, False, None, None), ("young", "AI Engineer", GOOD + " We are a seed-stage startup.", "", None, False, "like", None),
    ("black", "AI Engineer", GOOD, "", None, True, "dislike", None), ("disliked", "AI Engineer", GOOD, "", None, False, "dislike", None), ("sales", "Sales Manager", GOOD, "", None, False, None, None), ("thin", "Software Engineer", "We use an LLM. Other work. English is our working language.", "", None, False, None, None),
    ("told", "AI Engineer", GOOD, "", None, False, None, (0.9, 0.9, "remote_global", "unknown", "mid", 1.0, None)), ("graduate", "AI Engineer", GOOD, "", None, False, None, (0.9, 0.9, "onsite", "no", "graduate", 0.5, None)), ("unfit", "AI Engineer", GOOD, "", None, False, None, (0.9, 0.2, "onsite", "no", "mid", 0.5, 0.5)),
]


def judgements(spark, **more) -> DataFrame:
    rows = spark.createDataFrame(POSTINGS, "id string, title string, jd_text string, location string, apply_url string, company_blacklisted boolean, feedback string, external " + judging.EXTERNAL)
    day = F.lit("2026-10-01").cast("timestamp")
    rows = rows.withColumns({"jd_text_english": F.lit(None).cast("string"), "posted_at": day, "first_seen_at": day, "preference": F.lit(None).cast("double")})
    out = judging.judged(rows, now(), WEIGHTS, {"DE": 0.9, "other": 0.5}, [], **more)
    return out.withColumns({"at": seconds("next_judge_at"), "apply": F.col("apply.email")})


expect("judgement_status", "id:s status:s skip_reason:s verified:b at:i", [
    ("targeted", "targeted", None, False, MICRO + 900), ("mail", "targeted", None, False, MICRO + 900), ("young", "targeted", None, False, MICRO + 900), ("black", "blacklisted", "Company is blacklisted.", True, None), ("disliked", "skipped", "Disliked by the owner.", True, None),
    ("sales", "skipped", "Excluded title: Sales Manager", True, None), ("thin", "skipped", "Local rules (Judge unreachable): not an AI software engineering role.", False, MICRO + 900), ("told", "targeted", None, True, None), ("graduate", "skipped", "Graduate or internship level.", True, None),
    ("unfit", "skipped", "Judge: needs a language other than English (or is nationality restricted).", True, None),
], judgements)
# 0.8 role, 1 mid, 1 global, 1 fresh, 0.75 skills, 1 country = 60; focus of three hits 0.59 -> 0.877; mail 1.3; young 1.2
expect("judgement_score", "id:s score:d remote_scope:s seniority:s apply:s", [
    ("targeted", 52.6, "remote_global", "mid", None), ("mail", 68.4, "remote_global", "mid", "jobs@acme.dev"), ("young", 63.1, "remote_global", "mid", None), ("black", 0.0, None, None, None), ("disliked", 0.0, None, None, None), ("sales", 0.0, None, None, None), ("thin", 0.0, "unknown", "unknown", None),
    ("told", 67.5, "remote_global", "mid", None), ("graduate", 0.0, "onsite", "unknown", None), ("unfit", 0.0, "onsite", "mid", None),
], judgements)
expect("judgement_by_mail_only", "id:s status:s", [("targeted", "skipped"), ("mail", "targeted"), ("young", "skipped"), ("black", "blacklisted"), ("disliked", "skipped"), ("sales", "skipped"), ("thin", "skipped"), ("told", "skipped"), ("graduate", "skipped"), ("unfit", "skipped")], lambda spark: judgements(spark, email_only=True))
expect("judgement_over_budget", "id:s status:s at:i", [("targeted", "pending_judge", MICRO + 3600), ("mail", "pending_judge", MICRO + 3600), ("young", "pending_judge", MICRO + 3600), ("black", "blacklisted", None), ("disliked", "skipped", None), ("sales", "skipped", None), ("thin", "pending_judge", MICRO + 3600), ("told", "pending_judge", MICRO + 3600), ("graduate", "pending_judge", MICRO + 3600), ("unfit", "pending_judge", MICRO + 3600)], lambda spark: judgements(spark, spent=29.99))


def plain(rows) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_case(spark, name):
    columns, rows, made = EXPECTED[name]
    got = made(spark).select(*[F.col(n).cast(TYPES[k]).alias(n) for n, k in columns]).collect()
    floats = {i for i, (_, k) in enumerate(columns) if k == "d"}
    assert plain(got) == plain(tuple(float(v) if i in floats and v is not None else v for i, v in enumerate(r)) for r in rows)


def test_the_budget_is_a_running_gate(spark):
    """With 1 USD left and a hundred jobs that pay, fifty are judged and fifty wait, in the order of the queue."""
    rows = [(i, "AI Engineer", GOOD, i % 5 == 4) for i in range(125)]
    jobs = spark.createDataFrame(rows, "id int, title string, jd_text string, company_blacklisted boolean")
    day = F.lit("2026-10-01").cast("timestamp")
    empty = {c: F.lit(None).cast("string") for c in ("jd_text_english", "apply_url", "feedback")}
    jobs = jobs.withColumns(empty | {"location": F.lit(""), "posted_at": day, "first_seen_at": day, "preference": F.lit(None).cast("double"), "external": F.lit(None).cast(judging.EXTERNAL), "late": -F.col("id")})
    got = {r.id: r.status for r in judging.judged(jobs, now(), WEIGHTS, {"other": 0.5}, [], spent=29.0, order=["late"]).collect()}
    pays = [i for i in sorted(got, reverse=True) if i % 5 != 4]
    assert [got[i] for i in pays] == ["targeted"] * 50 + ["pending_judge"] * 50
    assert all(got[i] == "blacklisted" for i in got if i % 5 == 4)


def test_postings_are_found_however_deep(spark):
    deep = POSTING
    for i in range(14):
        deep = {"@graph": [deep]} if i % 2 else [[deep], {"@type": "Person"}]
    page = '<script type="application/ld+json">' + json.dumps(deep) + "</script>"
    assert [r.title for r in feeds.json_ld(bodies(spark, page, "<p>none</p>")).collect()] == ["Dev"]
