import datetime as dt
import os

from pyspark.sql import functions as F

from tessera.functions import dates, scoring
from tessera.functions import views as W
from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.sources import sinks, texts
from tests.test_views import one


def test_roles_and_companies(spark):
    title = lambda b, f: one(spark, W.role_title("b", "f"), b=b, f=f)
    assert title("Acme is looking for a Senior Go Developer now", "x") == "Senior Go Developer" and title("we need our founding Platform Engineer", "") == "founding Platform Engineer"
    assert title(None, "Go Dev \u2013 Glassdoor 2024") == "Go Dev" and title("", "Ann on LinkedIn: we grow") == "we grow" and title("", None) == "" and len(title("", "y" * 300)) == 140
    firm = lambda s, e, u: one(spark, W.hiring_company("s", "e", "u"), s=s, e=e, u=u)
    assert tuple(firm(None, "a@Acme.co", "https://www.other.org/1")) == ("Acme", "acme.co") and tuple(firm("Big Co", "a@gmail.com", "https://www.other.org/1")) == ("Big Co", "other.org")
    assert tuple(firm("LinkedIn", "a@gmail.com", "https://www.linkedin.com/1")) == ("Linkedin", None) and firm("Big Co", "a@b.io", "none") is None and len(firm("z" * 99, "a@b.io", "https://c.io")["name"]) == 80


def test_reader(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    assert [one(spark, dates.greeting("t", "UTC"), t=at(h)) for h in (4, 5, 12, 18)] == ["Working late", "Good morning", "Good afternoon", "Good evening"] and one(spark, dates.greeting(F.lit(None).cast("timestamp"), "UTC")) is None
    group = lambda t, zone: one(spark, dates.age_group("t", F.lit(at(10)), zone), t=t)
    assert group(dt.datetime(2024, 1, 1, 23, 59), "UTC") == "This week" and group(dt.datetime(2024, 1, 1, 23, 59), None) == "Today" and group(at(0), "UTC") == "Today" and group(dt.datetime(2023, 12, 26), "UTC") == "Older"
    said = lambda *n: one(spark, W.motivation(*map(F.lit, n)))
    assert said(1, 2, 9, 9).startswith("1 reply in, and 2") and said(1, 0, 1, 9).startswith("1 fresh role ") and said(0, 1, 0, 9).startswith("1 application out") and said(0, 0, 0, 3).startswith("3 targets") and said(0, 0, 0, 0).startswith("The scout")


def test_rows_of_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, v string")
    got = lambda keys, **more: sorted(r.v for r in R.listed(df, "k", keys, **more).collect())
    assert got([2, None]) == ["b", "d"] == got([2, 2, None], most=1) and got([]) == [] and got(df.select("k")) == ["a", "b", "d"]
    assert [one(spark, scoring.whole("x"), x=x) for x in (0.5, 1.5, 2.5, -0.5, 2.51)] == [0, 2, 2, 0, 3]
    rows = spark.createDataFrame([(1, ["b", "a"]), (1, ["a"]), (2, []), (3, None)], "artifact int, found array<string>")
    assert sorted(map(tuple, R.artifact_emails(rows, "artifact", "found").collect())) == [(1, ["a", "b"]), (2, []), (3, [])]


def test_actions(spark):
    rows = spark.createDataFrame([(1, 7, "new"), (2, 7, "new"), (3, 8, "new"), (4, None, "new"), (5, None, "new")], "id int, company_id int, status string")
    acts = spark.createDataFrame([(1, "blacklist", ["status"], "x"), (4, "blacklist", [], None), (3, "applied", ["status"], "applied")], "id int, action string, set array<string>, status string")
    assert sorted(map(tuple, S.after_action(rows, acts, ["status"]).select("id", "status").collect())) == [(3, "applied"), (5, "new")]
    assert S.after_action(rows, acts.limit(0), ["status"]).count() == 5


def test_log_and_files(spark, tmp_path):
    calls = spark.createDataFrame([("m", "judge", "r1", 1_000_000, 500_000), ("m", None, "r2", 0, 0)], "model string, purpose string, request_id string, tokens_in long, tokens_out long")
    log = str(tmp_path / "log")
    for batch in (1, 2, 1):
        sinks.append_batch(sinks.usage_rows(calls.filter(F.col("request_id") == f"r{batch}")), log, batch)
    rows = sinks.logged(spark, log).orderBy("batch").collect()
    assert [(r.batch, r.request_id, r.cost_usd) for r in rows] == [(1, "r1", 6.0), (2, "r2", 0.0)] and rows[0].id != rows[1].id
    folder = tmp_path / "cvs" / "a"
    os.makedirs(folder)
    (folder / "one.txt").write_text("line\nmore")
    (folder / "two.txt").write_text("")
    (folder / "four.TXT").write_text("x")
    (folder / "three.docx").write_bytes(b"\x00\xff")
    got = {os.path.basename(r.path): (r.text, r.error) for r in texts.whole_texts(spark, str(tmp_path / "cvs")).collect()}
    assert got["one.txt"] == ("line\nmore", None) and got["three.docx"] == (None, "cv_unreadable") and got["four.TXT"] == ("x", None) and len(got) == 3
