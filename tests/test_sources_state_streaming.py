"""Readers, sinks, transitions and streams."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.sources import feeds, sinks
from tessera.streaming import jobs as J


def body(spark, text, base=None):
    return spark.createDataFrame([(text, base)], "body string, base_url string")


def test_boards(spark):
    gh = {"jobs": [{"id": 7, "title": "AI Engineer", "absolute_url": "https://b.io/jobs/7", "updated_at": "2026-10-02T00:00:00Z", "location": {"name": "Berlin"}, "content": "&lt;p&gt;Hi jobs@b.io&lt;/p&gt;"}, {"id": 8, "title": ""}]}
    (r,) = feeds.board(body(spark, json.dumps(gh)), "greenhouse").collect()
    assert (r.title, r.external_id, r.location, r.description, r.emails, r.posted_at) == ("AI Engineer", "7", "Berlin", "Hi jobs@b.io", ["jobs@b.io"], dt.datetime(2026, 10, 2))
    with pytest.raises(Exception, match="no title"):
        feeds.board(body(spark, json.dumps(gh)), "greenhouse", strict=True).collect()
    (r,) = feeds.board(body(spark, json.dumps([{"id": "x", "text": "Dev", "applyUrl": "https://l.co/a", "createdAt": 1790899200000, "categories": {"location": "Paris"}}])), "lever").collect()
    assert (r.url, r.location, r.posted_at) == ("https://l.co/a", "Paris", dt.datetime(2026, 10, 2))
    (r,) = feeds.board(body(spark, json.dumps({"jobPostings": [{"title": "Dev", "externalPath": "/job/a/b"}]}), "https://w.io/x"), "workday").collect()
    assert (r.url, r.external_id) == ("https://w.io/job/a/b", "job:a:b")
    (r,) = feeds.board(body(spark, json.dumps({"data": {"items": [{"t": {"value": "Dev"}, "u": ["https://a.io/1"]}]}})), "json", {"items": feeds.path("data.items"), "title": ["$.t"], "url": ["$.u"]}).collect()
    assert (r.title, r.url) == ("Dev", "https://a.io/1")
    assert feeds.board(body(spark, "not json"), "ashby").count() == 0


def test_markup_feeds(spark):
    rss = "<rss><channel><item><title>Dev &amp; more</title><link>https://a.io/1</link><guid>g1</guid><description><![CDATA[<p>Hi</p>]]></description><pubDate>Fri, 02 Oct 2026 00:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>Two</title><link href="https://a.io/2"/><id>i2</id><updated>2026-10-02T00:00:00Z</updated></entry></feed>'
    a, b = feeds.rss(spark.createDataFrame([(rss,), (atom,)], "body string")).orderBy("url").collect()
    assert (a.url, a.external_id, a.description, b.url, b.external_id, b.posted_at) == ("https://a.io/1", "g1", "Hi", "https://a.io/2", "i2", a.posted_at)
    assert [r.url for r in feeds.sitemap(spark.createDataFrame([("<urlset><url><loc>https://a.io/1</loc></url><url><loc> ftp://x </loc></url><url><loc>https://a.io/2?a=1&amp;b=2</loc></url></urlset>",)], "body string")).collect()] == ["https://a.io/1", "https://a.io/2?a=1&b=2"]
    ld = {"@graph": [{"@type": ["JobPosting"], "title": "Dev", "url": "https://a.io/jobs/123", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Berlin", "addressCountry": "DE"}}, "datePosted": "2026-10-02"}, {"@type": "Person", "name": "x"}]}
    (r,) = feeds.json_ld(body(spark, f'<p>hr@a.io</p><script type="application/ld+json">{json.dumps(ld)}</script>')).collect()
    assert (r.title, r.company, r.location, r.external_id, r.emails) == ("Dev", "Acme", "Berlin, DE", "123", ["hr@a.io"])
    thread = {"children": [{"id": 5, "created_at": "2026-10-02T00:00:00Z", "text": "Acme | AI Dev | Berlin | Remote<p>Mail jobs [at] acme [dot] dev"}, {"id": 6, "text": "no format"}]}
    (r,) = feeds.hiring_thread(body(spark, json.dumps(thread)).drop("base_url")).collect()
    assert (r.company, r.title, r.location, r.external_id, r.emails) == ("Acme", "AI Dev", "Berlin | Remote", "hn-5", ["jobs@acme.dev"])


def test_csv_and_cases(spark):
    rows = feeds.csv_rows(spark.createDataFrame([('title,url,company\nDev,https://a.io/1,"Acme, ""Inc"""\n',)], "body string"), {"title": "title", "url": 1, "company": "company"}).collect()
    assert [(r.title, r.url, r.company) for r in rows] == [("Dev", "https://a.io/1", 'Acme, "Inc"')]
    with pytest.raises(Exception, match="no url"):
        feeds.csv_rows(spark.createDataFrame([("title,url\nDev,",)], "body string"), {"title": "title", "url": "url"}).collect()
    good = {"id": "1", "title": "t", "description": "d", "country": " de ", "label": True, "reason": "r"}
    lines = [json.dumps(good), "", json.dumps(good | {"id": "2", "label": None}), "{", json.dumps(good | {"id": "3"}), json.dumps(good | {"id": "3"})]
    out = sorted((r.id or "", r.country or "", r.fault or "") for r in feeds.labelled_cases(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert out == [("", "", "not JSON"), ("1", "DE", ""), ("2", "DE", "no label"), ("3", "DE", "repeated id"), ("3", "DE", "repeated id")]


def test_robots(spark):
    rules = feeds.robots(spark.createDataFrame([("a.io", "User-agent: *\nDisallow: /private\nAllow: /private/open\nUser-agent: bot\nUser-agent: other\nDisallow: /*.pdf$\n")], "host string, body string"))
    asked = spark.createDataFrame([("a.io", p) for p in ("/private/x", "/private/open/y", "/f.pdf", "/z")] + [("b.io", "/private")], "host string, path string")
    get = lambda agent: {(r.host, r.path): r.allowed for r in feeds.allowed(asked, rules, agent).collect()}
    assert get("crawler") == {("a.io", "/private/x"): False, ("a.io", "/private/open/y"): True, ("a.io", "/f.pdf"): True, ("a.io", "/z"): True, ("b.io", "/private"): True}
    assert get("mybot") == {("a.io", "/private/x"): True, ("a.io", "/private/open/y"): True, ("a.io", "/f.pdf"): False, ("a.io", "/z"): True, ("b.io", "/private"): True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), ('a"b', None)], "a string, b int")
    assert [r.line for r in sinks.csv_lines(df).collect()] == ['"\'=x","1"', '"a""b",""']
    sinks.write_csv(df, str(tmp_path / "out"))
    parts = [p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part*")) if p.stat().st_size]
    assert all(p.startswith('"a","b"\r\n') and p.endswith("\r\n") for p in parts) and sorted(x for p in parts for x in p.split("\r\n")[1:-1]) == ['"\'=x","1"', '"a""b",""']
    assert sinks.write_workbook(df, str(tmp_path / "x.xlsx")) == 2 and b"<v>1</v>" in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml")
    assert json.loads(df.select(sinks.envelope(F.struct("a")).alias("j")).first().j) == {"ok": True, "data": {"a": "=x"}}
    assert len(sinks.with_digest(df, ["a", "b"]).first().input_digest) == 64


NOW = dt.datetime(2026, 10, 2)
TASK = "id int, dedupe_key string, status string, priority int, created_at timestamp, lease_until timestamp, leased_by string, attempts int, max_attempts int"


def test_queue(spark):
    rows = [(1, "a", "queued", 1, NOW, None, None, 0, 3), (2, "b", "queued", 9, NOW, NOW + dt.timedelta(1), None, 1, 3), (3, "c", "leased", 5, NOW, NOW - dt.timedelta(1), "w", 2, 3), (4, "d", "done", 9, NOW, None, None, 0, 3)]
    tasks, now = spark.createDataFrame(rows, TASK), F.lit(NOW)
    state = lambda df: {r.id: (r.status, r.attempts) for r in df.collect()}
    assert state(S.claim(tasks, "me", 1, now))[3] == ("leased", 2) and {r.id for r in S.claim(tasks, "me", 9, now).filter("leased_by = 'me'").collect()} == {1, 3}
    failed = spark.createDataFrame([(1, "x"), (3, "y")], "id int, error string")
    assert state(S.retry(tasks, failed, now)) == {1: ("queued", 1), 2: ("queued", 1), 3: ("failed", 3), 4: ("done", 0)}
    assert state(S.complete(tasks, failed))[1] == ("done", 0)
    more = spark.createDataFrame([(7, "a", "queued", 1, NOW, None, None, 0, 3), (8, "z", "queued", 1, NOW, None, None, 0, 3), (9, "z", "queued", 1, NOW, None, None, 0, 3)], TASK)
    assert {r.id for r in S.enqueue(tasks, more).collect()} == {1, 2, 3, 4, 8}


def test_rows_of_groups_and_slots(spark):
    asked = spark.createDataFrame([("h", 1, NOW), ("h", 2, NOW), ("h", 3, NOW + dt.timedelta(seconds=60)), ("g", 4, NOW)], "host string, id int, at timestamp")
    got = {r.id: (r.slot - NOW).total_seconds() for r in S.reserve_slots(asked, 5).collect()}
    assert got == {1: 0, 2: 5, 3: 60, 4: 0}
    jobs = spark.createDataFrame([(1, "targeted", 5.0, False, 1), (2, "targeted", 9.0, False, 1), (3, "sent", 99.0, False, 2)], "id int, status string, score double, needs_rescore boolean, company_id int")
    assert [r.id for r in S.mark_rescore(jobs, 1).filter("needs_rescore").collect()] == [2]
    assert {r.id for r in S.blacklist(jobs, spark.createDataFrame([(2,)], "company_id int")).filter("status = 'blacklisted'").collect()} == {3}
    assert [r.id for r in R.page(jobs, [F.col("id")], 2, 2).collect()] == [3] and R.filtered(jobs, status=None).count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, NOW + dt.timedelta(minutes=7 * i), f"u{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user string, value double").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = J.tumbling(stream(), "ts", "1 hour", ["user"], late="10 days").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("hours")) == key(J.tumbling(df, "ts", "1 hour", ["user"]))
    q = J.sessions(stream(), "ts", "30 minutes", ["user"], late="10 days").writeStream.format("memory").queryName("visits").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("visits")) == key(J.sessions(df, "ts", "30 minutes", ["user"]))
    path = str(tmp_path / "state")
    spark.createDataFrame([], "id int, dedupe_key string").write.parquet(path + "/0")
    done = [0]

    def write(out, number):
        out.write.mode("overwrite").parquet(f"{path}/{number + 1}")
        done.append(number + 1)

    def step(state, batch):
        return S.enqueue(state, batch.select(F.col("event_id").alias("id"), F.col("user").alias("dedupe_key")))

    J.transitions(stream(), lambda: spark.read.parquet(f"{path}/{done[-1]}"), write, step, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.dedupe_key for r in spark.read.parquet(f"{path}/{done[-1]}").collect()) == ["u0", "u1", "u2"]
