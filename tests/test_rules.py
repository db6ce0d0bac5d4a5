"""The rules against the truth table of their definition."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, rules, scoring, text, urls
from tessera.operators import evaluate


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **fields):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]) if fields else spark.range(1)
        return row.select(column.alias("v")).first()["v"]

    return value


def test_apply_email(one):
    get = lambda body, url=None: one(rules.apply_email("b") if url is None else rules.apply_email("b", "u"), b=body, u=url or "")
    assert get("Great team. Send your CV to Jobs@acme.dev. Privacy: privacy@acme.dev")["email"] == "jobs@acme.dev"
    assert get("Interested in this role?\nhello@acme.io")["email"] == "hello@acme.io"
    assert get("", "mailto:work%40acme.dev?subject=Hi")["email"] == "work@acme.dev"
    assert get("", "https://acme.dev/apply") is None
    for body in ("For privacy write to privacy@acme.dev", "For an accommodation email your resume to jobs@acme.dev", "Send your CV to jobs@acme.invalidtld1", "The office manager is ann@acme.dev", None):
        assert get(body) is None, body


def test_prefilter(one):
    get = lambda title, body: one(rules.prefilter("t", "b"), t=title, b=body)
    good = get("AI Full-Stack Engineer", "You will build LLM features for our users. English is our working language.")
    assert good["pass"] and [e["source"] for e in good["evidence"]] == ["title", "JD"] and len(good["language_evidence"]) == 1
    assert get("Graduate AI Intern", "LLM")["reason"].startswith("Excluded title") and not get("Marketing Manager", "LLM")["pass"]
    german = "Wir suchen einen Entwickler für unsere Plattform und bauen Produkte mit LLM Systemen für viele Kunden in Europa und Asien. Englisch ist Arbeitssprache."
    assert get("AI Software Engineer", german)["pass"] and get("AI Software Engineer", german)["language"] == "non_english"
    assert "Requires" in get("AI Engineer", "We use LLMs. German C1 is required for this job.")["reason"]
    assert get("AI Engineer", "LLM work for Saudi nationals only")["reason"] == "Saudi-only role."
    assert get("Software Engineer", "We sell shoes to people.")["reason"] == "No AI evidence in the title or description."
    assert get(None, None)["reason"] == "Not an engineering title."


def test_scope_sponsorship_seniority(one):
    body = "Work from anywhere. Visa sponsorship is available. 3+ years of work."
    assert one(rules.remote_scope("t", "b", "m"), t="AI Engineer", b=body, m="remote") == "remote_global"
    assert one(rules.sponsorship("t", "b"), t="AI Engineer", b=body) == "yes"
    assert one(rules.seniority("t", "b"), t="AI Engineer", b=body) == "mid"
    assert one(rules.seniority("t", "b"), t="Staff Engineer", b="junior") == "lead" and one(rules.seniority("t", "b"), t="Engineer", b="x") == "unknown"
    assert one(rules.remote_scope("t", "b", "m"), t="x", b="y", m="hybrid") == "onsite" and one(rules.sponsorship("t", "b"), t="x", b="We are unable to sponsor") == "no"
    assert one(rules.quote_around("b", "(?:sponsor)"), b="First. We sponsor visas. Last.") == "We sponsor visas."


def test_places(one):
    get = lambda x: one(rules.countries("x"), x=x)
    assert get("Berlin, Germany") == ["DE"] and get("Austin, TX") == ["US"] and get("Toronto, ON") == ["CA"] and get("Remote (GB)") == ["UK"]
    assert get("Springfield, IL") == ["US"] and get("Halifax, NS; Portland, OR") == ["CA"] and get("Zürich or London") == ["UK", "CH"] and get("") == []
    assert one(rules.work_mode("l", "b"), l="Hybrid - Paris", b="") == "hybrid" and one(rules.work_mode("l", "b"), l="", b="We are remote-first") == "remote"
    assert one(rules.work_mode("l", "b"), l="Paris", b="") == "onsite" and one(rules.work_mode("l", "b"), l=" ", b="") == "unknown"


def test_replies_links_pages(one):
    for x, want in (("Delivery failed: 550 5.1.1", "bounce"), ("I am Out of Office", "auto_reply"), ("Unfortunately not", "negative"), ("Let us talk", "positive")):
        assert one(rules.reply_class("x"), x=x) == want
    for u, label, want in (("https://a.io/x", "Apply now", "apply"), ("https://a.io/jobs", "More", "job"), ("https://boards.greenhouse.io/a", "See", "ats"), ("https://a.io/about", "About", "career")):
        assert one(rules.link_kind("u", "l"), u=u, l=label) == want
    assert one(rules.bot_wall("b", "c"), b="please solve the CAPTCHA", c="text/html") and not one(rules.bot_wall("b", "c"), b="captcha", c="application/json")
    assert one(rules.ats_markers("b"), b="x lever.co y GREENHOUSE.io") == ["greenhouse.io", "lever.co"]
    assert one(rules.posting_closed("b"), b="We are No Longer Accepting Applications.")
    assert one(rules.grounded(F.array(F.lit("a b")), "s"), s="x a b y") and not one(rules.grounded(F.array().cast("array<string>"), "s"), s="x")


def test_text(one):
    assert one(text.html_blocks("x"), x="&lt;h2&gt;About&lt;/h2&gt;&lt;p&gt;We  build&lt;/p&gt;<ul><li>One</li><li>Two</li></ul>") == "## About\nWe build\n• One\n• Two"
    assert one(text.strip_html("x"), x="<p>Hello <b>wor</b>ld &amp; &#x41;&#66;&#1114112; you</p><br>end") == "Hello world & AB you end"
    assert one(text.emails("x"), x="Write JOBS@Acme.dev., jobs@acme.dev and a@b.io;") == ["a@b.io", "jobs@acme.dev"]
    assert one(text.mailto("x"), x="MAILTO:A%40b%2eio?subject=x") == "a@b.io" and one(text.mailto("x"), x="https://a.io") is None
    assert one(text.sentences("x"), x="One. Two!  Three\n\nFour?") == ["One.", "Two!", "Three", "Four?"]
    assert one(text.clip("x", 10), x="abcdefghijkl") == "abcdefg..." and one(text.clip("x", 12), x="abcdefghijkl") == "abcdefghijkl"
    assert one(text.plain_addresses("x"), x="jobs [at] acme [dot] com or ann (at) b.io") == "jobs@acme.com or ann@b.io" and one(text.plain_addresses("x"), x="meet us at the office") == "meet us at the office"
    assert one(text.csv_cell("x"), x='=1+"2"') == '"\'=1+""2"""' and one(text.component("x"), x="  Acme, Inc. ") == "acme inc"
    assert one(text.initials("x"), x="ada byron lovelace") == "AB" and 0 <= one(text.tint("x"), x="Acme") < 8 and one(text.slug("x"), x="Acme & Co!") == "acme-co"
    assert one(text.page_text("x"), x="<style>p{}</style><p>Hi <i>you</i></p><script>x</script>end") == "Hi you\nend"


def test_urls(one):
    assert one(urls.identifier("u"), u="https://x.io/jobs/123-engineer") == "123-engineer" and one(urls.identifier("u"), u="https://x.io/a?gh_jid=77") == "77" and one(urls.identifier("u"), u="https://x.io/about") is None
    key = lambda e, u, c="Acme, Inc": one(urls.source_identifier("e", "u", "c", "t", "l"), e=e, u=u, c=c, t="AI Eng.", l="Berlin")
    assert key("x1", "https://x.io/jobs/123") == "x1" and key(" ", "https://x.io/jobs/123") == "123" and key(None, "https://x.io/", "acme inc") == key(None, "https://x.io/") and key(None, "https://x.io/").startswith("content:")
    assert [one(urls.joined("b", "l"), b="https://a.io/x/y", l=x) for x in ("/z", "z", "//c.io/z", "http://d.io")] == ["https://a.io/z", "https://a.io/x/z", "https://c.io/z", "http://d.io"]
    found = one(urls.links("b", "h"), b="https://a.io/x", h='<a href="/j">Job <b>one</b></a><a href="#t">no</a><a href="/j">again</a><a href="mailto:a@b.io">m</a>')
    assert [(x["url"], x["label"]) for x in found] == [("https://a.io/j", "Job one")]
    assert one(urls.is_public("u"), u="https://a.io/x") and not one(urls.is_public("u"), u="http://localhost/x") and one(urls.domain("u"), u="https://www.A.io/x") == "a.io"


def test_dates(one):
    at = lambda x: one(F.unix_seconds(dates.parsed("x")), x=x)
    assert {at(x) for x in ("2026-10-02T12:30:00Z", "2026-10-02 12:30:00", "Fri, 02 Oct 2026 12:30:00 GMT", "2026-10-02T14:30:00+02:00", "1790944200", "1790944200000")} == {1790944200}
    assert at("2026-10-02") == 1790899200 and at("soon") is None and at(None) is None
    friday = dt.datetime(2026, 10, 2, 20, 0)
    assert one(F.date_format(dates.next_work_window("x", "UTC"), "yyyy-MM-dd HH"), x=friday) == "2026-10-05 09"
    assert one(dates.in_work_window("x", "Asia/Tokyo"), x=dt.datetime(2026, 10, 2, 1, 0)) and one(dates.age_group("x", F.lit(friday)), x=dt.datetime(2026, 9, 28)) == "This week"


WEIGHTS = {"seniority": {"mid": 1.0}, "modeVisa": {"remote_global": 1.0, "remote_restricted": 0.2}, "freshnessDays": [(2, 1.0), (7, 0.8)]}


def test_scores(one):
    now = F.lit(dt.datetime(2026, 10, 2))
    score = lambda scope, posted: one(scoring.job_score(F.lit(1.0), F.lit("mid"), "s", F.lit("unknown"), "p", F.lit(1.0), F.lit(1.0), now, WEIGHTS), s=scope, p=posted)
    best = score("remote_global", dt.datetime(2026, 10, 1))
    assert best["score"] == 100 and best["mode_visa_weight"] == 1 and score("remote_restricted", dt.datetime(2026, 10, 1))["score"] == 20 and score("remote_global", dt.datetime(2026, 1, 1))["score"] == 30
    gate = lambda **k: one(scoring.send_gate(*[F.lit(v) for v in ({"status": "approved", "job": "targeted", "contact": "c", "invalid": None, "blocked": False, "sent": False, "today": 0, "cap": 20} | k).values()]))
    assert [gate(), gate(status="draft"), gate(job="closed"), gate(job="unverified"), gate(contact=None), gate(invalid="x"), gate(blocked=True), gate(sent=True), gate(today=20)] == ["ok", "not_approved", "job_closed", "job_unverified", "missing_contact", "invalid_contact", "do_not_contact", "duplicate_outreach", "daily_cap"]
    assert one(scoring.final_score(F.lit(80.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(True), F.lit(True))) == 100 and one(scoring.final_score(F.lit(50.0), F.lit(0.0), F.lit(0.5), F.lit(False), F.lit(False))) == 28
    assert [one(scoring.backoff_seconds(F.lit(n), 30)) for n in (0, 1, 7, 20)] == [60, 60, 3840, 86400]
    assert [one(scoring.adjusted_tier(*map(F.lit, x))) for x in ((3, 5, 0, 0.95), (1, 0, 3, 0.9), (2, 0, 0, 0.6))] == [2, 2, 2] and one(scoring.queue_priority(F.lit(1), F.lit("closed_check"))) == 90
    assert one(scoring.agentic_focus("t", "b"), t="Engineer", b="LLM and RAG with agents") == pytest.approx(0.59) and one(scoring.agentic_focus("t", "b"), t="Agentic Engineer", b="") == 0.9
    assert one(scoring.skill_overlap("b", ["python", "c++"]), b="Python and C++!") == 0.625 and one(scoring.skill_overlap("b", []), b="x") == 0.75
    assert one(scoring.cost_usd(F.lit(1_000_000), F.lit(500_000))) == 6.0 and one(scoring.blend(F.lit(1.0), F.lit(0.0))) == 0.7
    assert [one(scoring.source_action(*map(F.lit, x), 2.0, 0.5, 7.0)) for x in ((50, 0, 0, 30.0), (200, 1, 0, 30.0), (200, 9, 0, 30.0), (200, 9, 150, 30.0), (200, 1, 0, 3.0))] == ["active", "paused", "active", "paused", "active"]


def test_preferences(spark):
    rows = [(True, "rust compilers"), (True, "rust databases"), (False, "php shop"), (False, "php sites")]
    docs = spark.createDataFrame([(1, "rust work"), (2, "php work"), (3, "other")], "doc_id int, text string")
    out = {r.doc_id: r.preference for r in scoring.preferences(docs, spark.createDataFrame(rows, "liked boolean, text string")).collect()}
    assert out[1] > 0.7 and out[2] < 0.3 and out[3] == pytest.approx(0.5)
    assert {r.preference for r in scoring.preferences(docs, spark.createDataFrame(rows[:1], "liked boolean, text string")).collect()} == {None}


def test_evaluator(spark):
    cases = [
        ("a", "Senior AI Engineer", "You will build LLM agents in production with our team.", "DE", True, "TP"),
        ("b", "ML Engineer", "Own inference services in production for the platform.", "DE", True, "TP"),
        ("c", "AI Engineer", "We build LLM tools. German C1 required.", "DE", False, "TN"),
        ("d", "AI Trainer", "Label data for LLM engineers as an AI trainer.", "US", False, "TN"),
        ("e", "Sales Lead", "Sell the AI platform to engineers.", "US", False, "TN"),
        ("f", "AI Engineer", "We build LLM tools. German is a plus.", "US", False, "FP"),
        ("g", "AI-Entwickler Software", "Wir suchen erfahrung für LLM. Nous recherchons avec expérience. Englisch Software.", "US", True, "TP"),
        ("h", "Accountant", "Keep the books of the team.", "US", True, "FN"),
    ]
    df = spark.createDataFrame([(*c[:5], "r", None) for c in cases], "id string, title string, description string, country string, label boolean, reason string, seniority string")
    out = {r.id: r for r in evaluate.evaluated(df).collect()}
    assert {k: r.outcome for k, r in out.items()} == {c[0]: c[5] for c in cases}
    assert out["a"].bucket == "senior" and out["c"].why == "German is required as a non-English working language." and out["d"].why.startswith("Excluded by pre-filter: AI training")
    m = {r.country: r for r in evaluate.metrics(evaluate.evaluated(df), ["country"]).collect()}
    assert (m[None].tp, m[None].fp, m[None].fn, m[None].tn) == (3, 1, 1, 3) and m["DE"].precision == 1.0 and m["US"].recall == 0.5


def test_literals_of_patterns():
    import random
    import re

    from tessera.functions import rules
    from tessera.functions import vocabulary as V

    assert rules.literals(r"(?i)node\.?js|vector (db|store)|fine[- ]tun|c\+\+") == ["c++", "nodejs", "node.js", "fine tun", "fine-tun", "vector db", "vector store"]
    rng, words = random.Random(1), " ".join(x for _, p in V.SKILLS for x in rules.literals(p)).split() + ["LLMs", "agents", "ai", "go,", "restful", "k8s", "x"]
    for name, pattern in V.SKILLS:  # whatever matches holds one of the strings
        for _ in range(300):
            text = rng.choice([" ", "-", ""]).join(rng.choice(words) for _ in range(6))
            assert not re.search(pattern, text) or any(x in text.lower() for x in rules.literals(pattern)), (name, text)


def test_what_a_pattern_finds_is_found_once(spark):
    """Patterns of long texts run once, whatever uses their matches."""
    from pyspark.sql import functions as F

    from tessera.functions import rules, text
    from tessera.operators import evaluate
    from tessera.operators.substring_search import trigrams

    assert str(text.decode_entities(F.col("x"))).count("regexp_extract(") == 1
    assert "lambda" not in str(trigrams(F.col("x")))
    row = spark.createDataFrame([("&#101;&#xe9;&#128512;&#0;&#xD800;&#99999999;&#x1F600; a&#;&amp;#101;", "aé😀\nb")], "x string, y string")
    got = row.select(text.decode_entities("x").alias("a"), F.array_sort(trigrams(F.col("y"))).alias("b"), F.array_sort(trigrams(F.lit("ab"))).alias("c")).first()
    assert got.a == "eé😀😀 a&#;&#101;" and got.b == sorted(["aé😀", "é😀\n", "😀\nb"]) and got.c == []
    jobs = spark.createDataFrame([("Gardener", "We use an LLM."), ("AI Engineer", "English. German C1 is required"), ("AI Engineer", "We build an LLM.")], "title string, body string")
    found = [(r.g["pass"], r.g.reason, len(r.g.evidence)) for r in jobs.select(rules.prefilter("title", "body").alias("g")).collect()]
    assert found == [(False, "Not an engineering title.", 0), (False, 'Requires a language other than English: "German C1 is required"', 0), (True, None, 2)]
    assert [r.reason for r in jobs.select(evaluate.language("title", "body")["reason"].alias("reason")).collect()][1] == "German is required as a non-English working language."


def test_a_sum_of_exactly_the_cap_fits(spark, tmp_path):
    import random
    from datetime import datetime

    from tessera.plans.relational_queries import month_budget

    def plain_sum(cents):  # one by one: sum() compensates
        total = 0.0
        for x in cents:
            total += x / 100
        return total

    random.seed(3)
    while True:
        cents = [random.randrange(1, 20000) for _ in range(20)]
        cents.append(150_000 - sum(cents))
        if cents[-1] > 0 and plain_sum(cents) > 1500:
            break
    total = plain_sum(cents)
    spark.createDataFrame([(i, datetime(2024, 1, 2, 0, i), 1, x / 100) for i, x in enumerate([*cents, 1])], "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.spent, r.fits) for r in month_budget(spark, str(tmp_path)).collect()}
    assert total > 1500 and got[20] == (1500.0, True) and got[21] == (1500.01, False)
