import pytest
from pyspark.sql import functions as F

from tessera.sources import elements as E

PAGE = """<!DOCTYPE html><body class="x y"><!-- <li>no</li> --><ul id="jobs">
<li class="job hot"><a href="/1?a=1&amp;b=2">AI &amp; <b>ML</b> Engineer</a><span class=co>Acme</span><p>One<p>Two</li>
<li class=job data-k='a > b'><a href='/2'>Dev</a><img src=x><span class="co">Other</span>
<li class="job"><div><ul><li class="job in"><a href="/4">Inner</a></ul></div><a href="/3">Late</a></ul><br/>
<script>var a = "<li class='job'>";</script><table><tr><td>1<td>2<tr><td>3</table></section><p>end <i>open"""


@pytest.fixture(scope="module")
def page(spark):
    return E.with_elements(spark.createDataFrame([(1, PAGE, "https://a.io/x/")], "id int, html string, url string")).cache()


def texts(page, selector):
    e = E.select(F.col("_tokens"), F.col("_elements"), selector)
    return [E_ for E_ in page.select(F.transform(e, lambda x: E.text_of(F.col("_tokens"), x)).alias("t")).first().t]


@pytest.mark.parametrize(
    "selector, want",
    [
        ("a", ["AI & ML Engineer", "Dev", "Inner", "Late"]),
        ("li.hot a", ["AI & ML Engineer"]),
        ("#jobs > li > a", ["AI & ML Engineer", "Dev", "Late"]),
        (".x .co", ["Acme", "Other"]),
        ("li li", ["Inner"]),
        ("p", ["One", "Two", "end open"]),
        ("td", ["1", "2", "3"]),
        ("tr", ["1 2", "3"]),
        ("li[data-k]", ["Dev Other"]),
        ("[data-k='a > b'] a".replace(" > ", "*"), []),
        ("a[href^='/1'], a[href$='3']", ["AI & ML Engineer", "Late"]),
        ("body.y.x i", ["open"]),
        ("*#jobs .in", ["Inner"]),
        ("br", [""]),
        ("section", []),
    ],
)
def test_selectors(page, selector, want):
    assert texts(page, selector) == want


def test_items_and_fields(spark):
    pages = spark.createDataFrame([(1, PAGE, "https://a.io/x/"), (2, None, "https://b.io"), (3, "", "https://c.io")], "id int, html string, url string")
    rows = E.items(pages, "#jobs > li", {"title": ("a",), "link": ("a", "href"), "by": (".co", None, False), "none": ("video", None, False)}).orderBy("id", "item_no").collect()
    assert [(r.id, r.item_no, r.title, r.link, r.by, r.none, list(r.missing)) for r in rows] == [(1, 1, "AI & ML Engineer", "/1?a=1&b=2", "Acme", None, []), (1, 2, "Dev", "/2", "Other", None, []), (1, 3, "Inner", "/4", None, None, [])]


def test_records(spark):
    good = "<div class=j><h2>Dev</h2><a href='b'>x</a><p class=d>Go &lt;b&gt;now&lt;/b&gt; to Jobs@A.io</p><i>2026-10-02</i></div>"
    pages = spark.createDataFrame([(1, good * 2, "https://a.io/x/y"), (2, good + "<div class=j><h2>No link</h2></div>", "https://b.io/")], "id int, body string, base_url string")
    fields = {"title": ("h2",), "url": ("a", "href"), "description": (".d", None, False), "email": (".d", None, False), "posted_at": ("i", None, False)}
    one = E.selector_pages(pages.filter("id = 1"), "div.j", fields).collect()
    assert [(r.id, r.title, r.url, r.description, list(r.emails), str(r.posted_at), r.company, r.source_kind) for r in one] == [(1, "Dev", "https://a.io/x/b", "Go now to Jobs@A.io", ["jobs@a.io"], "2026-10-02 00:00:00", None, "html")] * 2
    with pytest.raises(Exception, match="required HTML field url was missing"):
        E.selector_pages(pages, "div.j", fields).collect()
    loose = E.selector_pages(pages, "div.j", fields, strict=False).collect()
    assert sorted((r.id, r.title, r.error) for r in loose) == [(1, "Dev", None)] * 2 + [(2, None, "required HTML field url was missing")]
    with pytest.raises(ValueError):
        E.selector_pages(pages, "div:first-child", fields)
    with pytest.raises(ValueError):
        E.selector_pages(pages, "div", {"title": ("h2",)})


def test_element_rows_equal_a_plain_stack(spark):
    """Start, last and depth against a stack in Python over well-formed random trees of many tags."""
    import random

    rng, out, want = random.Random(2), [], []

    def grow(depth):
        at = len(out)
        tag = rng.choice(["b", "span", "i"])
        out.append(f"<{tag}>")
        for _ in range(rng.randrange(0, 4) if depth < 7 else 0):
            grow(depth + 1)
        out.append(f"</{tag}>")
        want.append((at, len(out) - 1, depth, tag))

    while len(out) < 1500:
        grow(0)
    rows = E.element_rows(spark.createDataFrame([("".join(out),)], "html string")).collect()
    assert sorted((r.start, r.last, r.depth, r.tag) for r in rows) == sorted(want)
