"""Pages as tables of elements, and a reader of items and fields by selectors: columns only, a page is a row until its items leave it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, urls
from tessera.functions.text import decode_entities, emails, normal_space, strip_html, text
from tessera.sources.feeds import RECORD

#: Comments, raw elements whole, tags with quoted attributes, declarations, text.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\z)|</?[a-z]{_ATTRIBUTES}>|<[!?][^>]*>|[^<]+|<"

#: Elements without content, raw ones, and which open elements a start tag closes unless one of the others is nearer.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style"]
_P_SCOPE = ["td", "th", "caption", "button", "object", "template"]
CLOSES = {
    "li": (["li", "p"], ["ul", "ol", "menu"]),
    "dt": (["dt", "dd", "p"], ["dl"]),
    "dd": (["dt", "dd", "p"], ["dl"]),
    "tr": (["tr", "td", "th"], ["table"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tbody": (["thead", "tbody", "tfoot", "tr"], ["table"]),
    "tfoot": (["thead", "tbody", "tfoot", "tr"], ["table"]),
    "option": (["option"], ["select"]),
    **{tag: (["p"], _P_SCOPE) for tag in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
}

#: The fold runs over so many tags at a time, since an array grows by being copied.
CHUNK = 256
SPANS = "array<struct<start:int,last:int,parent:int>>"


def tokens(html) -> Column:
    return F.regexp_extract_all(text(html), F.lit(TOKEN), F.lit(0))


def _tag(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def spans(found: Column) -> Column:
    """Token array -> (start, last, parent) of each element in order of its start: token numbers of its tags and its parent's start, -1 for none.

    One fold with a stack of open elements. An end tag closes the nearest open element of its name and all within; without one
    it counts for nothing. What is open at the end lasts to the end.
    """
    tags = F.filter(F.transform(found, lambda x, i: F.struct(i.alias("i"), _tag(x).alias("tag"), x.startswith("</").alias("close"))), lambda t: (t["tag"] != "") & ~(t["close"] & t["tag"].isin(VOID)))
    table = F.create_map(*[x for tag, (closed, kept) in CLOSES.items() for x in (F.lit(tag), F.struct(F.array(*map(F.lit, closed)).alias("closed"), F.array(*map(F.lit, kept)).alias("kept")))])
    none = F.array().cast("array<string>")

    def step(state: Column, t: Column) -> Column:
        stack = state["stack"]
        rule = F.try_element_at(table, t["tag"])
        closed = F.when(t["close"], F.array(t["tag"])).otherwise(F.coalesce(rule["closed"], none))
        kept = F.when(t["close"], none).otherwise(F.coalesce(rule["kept"], none))
        places = lambda names: F.transform(stack, lambda s, i: F.when(F.array_contains(names, s["tag"]), i + 1))
        wall = F.coalesce(F.array_max(places(kept)), F.lit(0))
        # an end tag closes the nearest element of its name, a start tag all that it may not stand in
        hit = F.when(t["close"], F.array_max(places(closed))).otherwise(F.array_min(F.filter(places(closed), lambda i: i > wall)))
        keep = F.coalesce(hit - 1, F.size(stack))
        left = F.slice(stack, 1, keep)
        ended = F.transform(F.slice(stack, keep + 1, F.size(stack)), lambda s: F.struct(s["i"].alias("start"), F.when(t["close"], t["i"]).otherwise(t["i"] - 1).alias("last"), s["parent"].alias("parent")))
        parent = F.coalesce(F.get(left, keep - 1)["i"], F.lit(-1))
        alone = t["tag"].isin([*VOID, *RAW])
        opened = F.array(F.struct(t["i"].alias("i"), t["tag"].alias("tag"), parent.alias("parent")))
        whole = F.array(F.struct(t["i"].alias("start"), t["i"].alias("last"), parent.alias("parent")))
        return F.struct(
            F.when(t["close"] | alone, left).otherwise(F.concat(left, opened)).alias("stack"),
            F.concat(state["out"], F.when(~t["close"] & alone, F.concat(ended, whole)).otherwise(ended)).alias("out"),
        )

    open_type, empty = "array<struct<i:int,tag:string,parent:int>>", F.array().cast(SPANS)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tags) - 1, F.lit(0)), F.lit(CHUNK)), lambda a: F.slice(tags, a + 1, CHUNK))

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["stack"].alias("stack"), empty.alias("out")), step)
        return F.struct(inner["stack"].alias("stack"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.array().cast(open_type).alias("stack"), F.array().cast(f"array<{SPANS}>").alias("out"))
    end = F.size(found) - 1
    return F.aggregate(chunks, start, chunk, lambda s: F.array_sort(F.concat(F.flatten(s["out"]), F.transform(s["stack"], lambda o: F.struct(o["i"].alias("start"), end.alias("last"), o["parent"].alias("parent"))))))


def attribute(token: Column, name: str) -> Column:
    """Value of a start tag's attribute, entities decoded; empty without a value, null without the attribute. Of repeated ones the first."""
    pattern = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
    inside = F.regexp_replace(token, r"(?s)^<[a-zA-Z][^\s/>]*|>.*$", "") if name not in RAW else token
    pairs = F.arrays_zip(F.regexp_extract_all(inside, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(inside, F.lit(pattern), F.lit(2)).alias("value"))
    value = F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == name.lower()), F.lit(0))["value"]
    return F.when(value.isNotNull(), decode_entities(F.regexp_replace(value, r"""^["']|["']$""", "")))


def _inside(found: Column, e: Column) -> Column:
    """Texts of an element, joined by blanks, as they stand."""
    part = F.slice(found, e["start"] + 1, e["last"] - e["start"] + 1)
    said = F.transform(part, lambda x: F.when(~x.startswith("<") | (x == "<"), x).when(x.rlike(r"(?i)^<(?:script|style)\b"), F.regexp_replace(x, r"(?is)^<[^>]*>|</\w+\s*>$", "")))
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), " ")


def text_of(found: Column, e: Column) -> Column:
    """Texts of an element, entities decoded, white space normal."""
    return normal_space(decode_entities(_inside(found, e)))


def compound(part: str):
    """tag, .class, #id, [name] and [name=value] (also ~= ^= $= *=), any of them together -> a test of a start tag. Other selectors raise."""
    shape = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)", part)
    if not part or not shape:
        raise ValueError(f"not a selector that is read here: {part!r}")
    tests = [] if shape[1] in (None, "*") else [lambda x, tag=shape[1].lower(): _tag(x) == tag]
    for mark, name in re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^\]]*\]", "", shape[2])):
        tests.append((lambda x, n=name: F.array_contains(F.split(F.coalesce(attribute(x, "class"), F.lit("")), r"\s+"), n)) if mark == "." else (lambda x, n=name: attribute(x, "id") == n))
    for inner in re.findall(r"\[([^\]]+)\]", shape[2]):
        name, sign, value = re.fullmatch(r"\s*([\w-]+)\s*(?:([~^$*]?)=\s*[\"']?(.*?)[\"']?\s*)?", inner).groups()
        if value is None:
            tests.append(lambda x, n=name: attribute(x, n).isNotNull())
        else:
            how = {"": lambda a, v: a == v, "~": lambda a, v: F.array_contains(F.split(a, r"\s+"), v), "^": lambda a, v: a.startswith(v), "$": lambda a, v: a.endswith(v), "*": lambda a, v: a.contains(v)}[sign or ""]
            tests.append(lambda x, n=name, v=value, h=how: h(attribute(x, n), v))

    def test(token: Column) -> Column:
        out = F.lit(True)
        for one in tests:
            out = out & F.coalesce(one(token), F.lit(False))
        return out

    return test


def select(found: Column, elements: Column, selector: str) -> Column:
    """Elements that a selector names, in order: compounds joined by blanks (within) or > (child), alternatives by commas."""
    chosen = []
    for one in selector.split(","):
        parts = re.findall(r">|[^\s>]+", one)
        if not parts or parts[0] == ">" or parts[-1] == ">":
            raise ValueError(f"not a selector that is read here: {selector!r}")
        at = None
        for i, part in enumerate(parts):
            if part == ">":
                continue
            test = compound(part)
            fits = F.filter(elements, lambda e: test(F.element_at(found, e["start"] + 1)))
            if at is None:
                at = fits
            elif parts[i - 1] == ">":
                at = F.filter(fits, lambda e: F.exists(at, lambda u: u["start"] == e["parent"]))
            else:
                at = F.filter(fits, lambda e: F.exists(at, lambda u: (u["start"] < e["start"]) & (e["last"] <= u["last"])))
        chosen.append(at)
    return chosen[0] if len(chosen) == 1 else F.array_sort(F.array_distinct(F.concat(*chosen)))


def with_elements(pages: DataFrame, body: str = "html") -> DataFrame:
    """Pages with _tokens and _elements."""
    return pages.withColumn("_tokens", tokens(body)).withColumn("_elements", spans(F.col("_tokens")))


def element_rows(pages: DataFrame, body: str = "html") -> DataFrame:
    """A row an element: the page's other columns, start, last, parent, depth, tag and its own start tag."""
    rows = with_elements(pages, body)
    depth = lambda e: F.size(F.filter("_elements", lambda u: (u["start"] < e["start"]) & (e["last"] <= u["last"])))
    each = F.transform("_elements", lambda e: F.struct(e["start"].alias("start"), e["last"].alias("last"), e["parent"].alias("parent"), depth(e).alias("depth"), F.element_at("_tokens", e["start"] + 1).alias("token")))
    out = rows.select(*[c for c in pages.columns if c != body], F.explode(each).alias("_e")).select("*", "_e.*").drop("_e")
    return out.withColumn("tag", _tag(F.col("token"))).withColumn("token", F.when(F.col("tag").isin(RAW), F.regexp_extract("token", r"(?s)^<[^>]*>", 0)).otherwise(F.col("token")))


def items(pages: DataFrame, item: str, fields: dict[str, tuple], body: str = "html") -> DataFrame:
    """Pages -> a row an item: the page's other columns, item_no (from 1), a column a field, and `missing`: required fields without an element.

    A field is (selector,), (selector, attribute) or (selector, attribute, required). Its value is the first element inside the
    item: its text, or its attribute; white space is normal. Required is the default. A selector may match from outside the item on.
    """
    rows = with_elements(pages, body)
    chosen = {name: select(F.col("_tokens"), F.col("_elements"), f[0]) for name, f in fields.items()}
    # one struct, used by every field: its selections are computed once a page
    rows = rows.withColumn("_s", F.struct(F.col("_tokens").alias("tokens"), select(F.col("_tokens"), F.col("_elements"), item).alias("items"), *[c.alias(f"f_{name}") for name, c in chosen.items()]))

    def of(e: Column) -> Column:
        values, missing = [], []
        for name, f in fields.items():
            first = F.get(F.filter(F.col("_s")[f"f_{name}"], lambda x: (x["start"] > e["start"]) & (x["start"] <= e["last"])), F.lit(0))
            attr = f[1] if len(f) > 1 else None
            value = normal_space(attribute(F.element_at(F.col("_s.tokens"), first["start"] + 1), attr)) if attr else text_of(F.col("_s.tokens"), first)
            there = attribute(F.element_at(F.col("_s.tokens"), first["start"] + 1), attr).isNotNull() if attr else first.isNotNull()
            values.append(F.when(there, value).alias(name))
            if len(f) < 3 or f[2]:
                missing.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(name)))
        return F.struct(*values, F.array_compact(F.array(*missing, F.lit(None).cast("string"))).alias("missing"))

    out = rows.select(*[c for c in pages.columns if c != body], F.posexplode(F.transform("_s.items", of)).alias("item_no", "_i"))
    return out.select(*[c for c in pages.columns if c != body], (F.col("item_no") + 1).alias("item_no"), "_i.*")


def selector_pages(pages: DataFrame, item: str, fields: dict[str, tuple], body: str = "body", base: str = "base_url", strict: bool = True) -> DataFrame:
    """(body, base_url, ...) -> RECORD rows of a page's items. Fields named like RECORD's columns, `email` for emails; title and url always required.

    A page of which an item lacks a required field fails: strict raises with the field's name, else the page's items are
    left out and come as one row with `error`, all fields null.
    """
    named = {k: ((*v, None, True)[:3] if len(v) < 3 else v) for k, v in fields.items()}
    for k in ("title", "url"):
        if k not in named:
            raise ValueError(f"a selector of {k} is needed")
        named[k] = (named[k][0], named[k][1], True)
    others = [c for c in pages.columns if c not in (body, base)]
    rows = items(pages.withColumn("_page", F.monotonically_increasing_id()), item, named, body)
    lacking = F.get("missing", F.lit(0))
    if strict:
        rows = rows.withColumn("title", F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("required HTML field "), lacking, F.lit(" was missing")))).otherwise(F.col("title")))
    get = lambda k: F.col(k) if k in named else F.lit(None).cast("string")
    joined = lambda k: F.when(get(k).isNotNull(), urls.joined(F.col(base), get(k)))
    made = {"title": get("title"), "url": joined("url"), "apply_url": joined("apply_url"), "external_id": get("external_id"), "company": get("company"), "location": get("location"), "description": strip_html(get("description")), "posted_at": dates.parsed(get("posted_at")), "emails": emails(get("email")), "source_kind": F.lit("html")}
    if strict:
        return rows.select(*others, *[made[f.name].alias(f.name) for f in RECORD.fields])
    error = F.when(F.size("missing") > 0, F.concat(F.lit("required HTML field "), lacking, F.lit(" was missing")))
    bad = rows.withColumn("_error", error).filter("_error is not null").groupBy("_page", *others).agg(F.min_by("_error", "item_no").alias("error"))
    good = rows.join(bad.select("_page"), "_page", "left_anti").select(*others, *[made[f.name].alias(f.name) for f in RECORD.fields], F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad.drop("_page"), allowMissingColumns=True)
