import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import views as W

NOW = dt.datetime(2026, 10, 2, 12)


def one(spark, column, **fields):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()], F.lit(0).alias("_")).select(column.alias("v")).first()["v"]


def test_labels(spark):
    assert one(spark, W.percent("x"), x=0.455) == 46 and one(spark, W.percent("x"), x=45.5) == 46 and one(spark, W.percent_of("n", "t"), n=1, t=0) == 0
    assert one(spark, W.mode_label("x"), x="odd_mode") == "Odd mode" and one(spark, W.level_label("x"), x="lead") == "Lead" and one(spark, W.agentic_label("x"), x=0.5) == "Agentic focus some"
    parts = {"roleFit": F.lit(0.9), "seniority": F.lit(0.8), "freshness": F.lit(0.3), "modeVisa": F.lit(None).cast("double")}
    assert one(spark, W.fit_summary(parts)) == "Strong on role fit and seniority. Weak on freshness." and one(spark, W.fit_summary({"roleFit": F.lit(0.6)})) == "A middling fit on every part."
    assert one(spark, W.own_domain("e", "c"), e="ann@acmelabs.io", c="Acme Labs Inc") and not one(spark, W.own_domain("e", "c"), e="ann@gmail.com", c="Acme")
    assert one(spark, W.recruiter_addresses("t", "c"), t="Ann@acme.dev info@acme.dev first.last@acme.dev ann@acme.dev bob@other.io", c="Acme") == ["ann@acme.dev"]
    assert one(spark, W.reader_kind("a", "m", "u"), a=None, m="custom_adapter", u="https://boards.greenhouse.io/x") == "greenhouse" and one(spark, W.reader_kind("a", "m", "u"), a="Workday_CXS", m="rss", u="") == "workday" and one(spark, W.reader_kind("a", "m", "u"), a="odd", m="rss", u="") is None
    assert one(spark, W.contact_fault("e", "u", "q"), e="a@b.io", u="https://b.io", q="mail a@b.io") is None and one(spark, W.contact_fault("e", "u", "q"), e="a@b.io", u="http://b.io", q="mail a@b.io") == "invalid_contact_source"
    assert one(spark, W.draft_valid("s", "b", "u"), s="AI engineer role", b="https://b.io/1 I have 9 years, can we chat? Remote from Indonesia, available now", u="https://b.io/1") and not one(spark, W.draft_valid("s", "b", "u"), s="Hi", b="", u="x")
    assert one(spark, W.draft_grounded(F.array(F.lit("We  build")), "w", "b", "s", "u"), w="your mission", b="I like your  Mission: u1", s="here we build tools", u="u1")
    assert one(spark, W.listing_url("u"), u="https://a.io/jobs/") and not one(spark, W.listing_url("u"), u="https://a.io/jobs/1")


def test_targets_and_spacing(spark):
    rows = [(1, "targeted", "A", "Dev", "Berlin", None, None, 50.0, 0.1, NOW, NOW), (2, "closed", "A", "Dev", "Berlin", None, None, 99.0, 0.1, NOW, NOW), (3, "targeted", "B", "AI Dev", "Paris", "x@b.io", "email", 10.0, 0.9, None, NOW - dt.timedelta(2)), (4, "targeted", "C", "Dev", "Rome", None, "form", 70.0, 0.2, NOW - dt.timedelta(9), NOW)]
    jobs = spark.createDataFrame(rows, "id int, status string, company string, title string, location string, apply_email string, apply_method string, score double, agentic_focus double, posted_at timestamp, first_seen_at timestamp")
    ids = lambda **k: [r.id for r in W.targets(jobs, F.lit(NOW), **k).collect()]
    assert ids() == [3, 4, 1] and ids(age="24h") == [1] and ids(age="72h") == [3, 1] and ids(search="rome") == [4] and ids(company="B") == [3] and ids(order="newest") == [3, 1, 4]
    sends = spark.createDataFrame([("z", i, NOW + dt.timedelta(minutes=m)) for i, m in enumerate((0, 0, 1, 600))], "zone string, id int, base timestamp")
    out = [r.scheduled for r in W.spaced(sends).orderBy("id").collect()]
    gaps = [(b - a).total_seconds() for a, b in zip([NOW, *out[:2]], out[:3])]
    assert all(240 <= g <= 720 for g in gaps) and 240 <= (out[3] - NOW).total_seconds() - 36_000 <= 720


def test_description_blocks(spark):
    long = " ".join(f"Sentence number {i} says a little more than nothing at all." for i in range(10))
    x = "## About\n\u2022 one\n- two\n\nWe pay:\n* three\nplain text\n" + long
    got = [(b["kind"], list(b["items"])) for b in one(spark, W.description_blocks("x"), x=x)]
    assert got[:5] == [("heading", ["About"]), ("list", ["one", "two"]), ("heading", ["We pay"]), ("list", ["three"]), ("para", ["plain text"])]
    assert [k for k, _ in got[5:]] == ["para"] * 4 and " ".join(i for _, items in got[5:] for i in items) == long
    assert one(spark, W.description_blocks("x"), x="") == []


def test_pictographs_and_admission(spark):
    assert one(spark, W.without_pictographs("x"), x="Go \U0001f680\ufe0f team \u2728, 5 # \u00e9\u4e2d") == "Go team , 5 # \u00e9\u4e2d"
    now = F.lit(NOW)
    assert one(spark, W.admission("c", "v", "m", ["rss"], now), c=0.75, v=True, m="rss").status == "active"
    for c, v, m in ((0.74, True, "rss"), (0.9, False, "rss"), (0.9, True, "other")):
        row = one(spark, W.admission("c", "v", "m", ["rss"], now), c=c, v=v, m=m)
        assert row.status == "candidate" and row.trial_until is None


def test_email_only_off(spark):
    from tessera.operators import state as S

    shape = "id int, status string, skip_reason string, closed_at timestamp, next_judge_at timestamp, apply_method string"
    rows = [(1, "skipped", S.EMAIL_ONLY, None, None, "form"), (2, "skipped", "other", None, None, "form"), (3, "skipped", S.EMAIL_ONLY, NOW, None, "form"), (4, "skipped", None, None, None, None)]
    got = {r.id: r.status for r in S.email_only(spark.createDataFrame(rows, shape), False, F.lit(NOW)).collect()}
    assert got == {1: "new", 2: "skipped", 3: "skipped", 4: "skipped"}


def test_recruiters_with_their_links(spark):
    page = '<a href="https://a.io/1">x</a> Write Ann@acme.dev now. <a href="https://search.brave.com/x">s</a> <b>bob@acme.dev</b> and ann@acme.dev. <a href="https://rocketreach.co/p">g</a> carl@acme.dev <a href="https://b.io/">z</a> privacy@acme.dev dora@other.io eve@acme.dev fred@acme.dev'
    got = one(spark, W.recruiter_contacts("h", F.lit("Acme Inc")), h=page)
    assert [(c.email, c.url) for c in got] == [("ann@acme.dev", "https://a.io/1"), ("bob@acme.dev", "https://a.io/1"), ("eve@acme.dev", "https://b.io/")]
    assert got[0].quote.startswith("x Write Ann@acme.dev now. s bob@acme.dev") and all(len(c.quote) <= 260 for c in got)
    assert one(spark, W.recruiter_contacts("h", F.lit("Acme")), h="ann@acme.dev <a href=\"https://a.io\">late</a>") == [] and one(spark, W.recruiter_contacts("h", F.lit("Acme")), h=None) == []
    long = '<a href="https://a.io/1">x</a> ' + " ".join(f"user{i}@acme.dev" for i in range(2000))
    assert len(one(spark, W.mails_with_links("h"), h=long)) == 2000
