"""Rules over titles and descriptions as columns; evidence stays verbatim in arrays of structs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import any_of, apply_addresses, clip, col, first_case, js, let, sentences, text

EVIDENCE = "array<struct<quote:string,source:string,reason:string>>"


def _evidence(quote: Column, source: str, reason: str) -> Column:
    return F.struct(quote.alias("quote"), F.lit(source).alias("source"), F.lit(reason).alias("reason"))


def none() -> Column:
    return F.array().cast(EVIDENCE)


def job_language(title, body) -> Column:
    """english or non_english, from the first 6000 characters: script, then the share of English stop words."""
    head = F.when(F.trim(text(body)) != "", F.substring(text(body), 1, 6000)).otherwise(text(title))
    size = lambda x, other: F.char_length(F.regexp_replace(x, other, ""))
    counts = let(F.regexp_replace(head, r"\P{L}++", ""), lambda x: F.struct(F.char_length(x).alias("letters"), size(x, "[^A-Za-z]++").alias("latin")))
    words = let(F.regexp_extract_all(F.lower(head), F.lit("[a-z']++"), F.lit(0)), lambda x: F.struct(F.size(x).alias("words"), F.size(F.filter(x, lambda w: w.isin(V.ENGLISH_STOP_WORDS))).alias("stop")))

    def verdict(x: Column) -> Column:
        c, w = x["c"], x["w"]
        return (
            F.when(c["letters"] == 0, "english")
            .when(c["latin"] / F.greatest(c["letters"], F.lit(1)) < 0.6, "non_english")
            .when(w["words"] < 15, "english")
            .when(w["stop"] / F.greatest(w["words"], F.lit(1)) >= 0.08, "english")
            .otherwise("non_english")
        )

    return let(F.struct(counts.alias("c"), words.alias("w")), verdict)


def _is_ai(x: Column) -> Column:
    return x.rlike(js(V.AI_ACRONYM)) | x.rlike(js(V.AI_PHRASE))


def ai_evidence(title, body) -> Column:
    """At most three: the title, then sentences."""
    in_title = text(title).rlike(js(V.AI_TITLE)) | _is_ai(text(title))
    head = F.when(in_title, F.array(_evidence(text(title), "title", "AI in the job title"))).otherwise(none())
    said = F.transform(F.filter(sentences(body), _is_ai), lambda s: _evidence(clip(s), "JD", "AI in the job description"))
    return F.slice(F.concat(head, said), 1, 3)


def language_evidence(body) -> Column:
    hit = F.filter(sentences(body), lambda s: s.rlike(js(V.OTHER_LANGUAGE)) | s.rlike(js(V.NATIONALS_ONLY)) | s.rlike(js(V.ENGLISH_MARKER)))
    return F.transform(F.slice(hit, 1, 4), lambda s: _evidence(clip(s), "JD", "Language or nationality mention"))


def language_gate(title, body) -> Column:
    """Whether the language alone lets a posting pass."""
    return (job_language(title, body) == "english") | text(body).rlike(js(V.ENGLISH_MARKER))


def required_language(body) -> Column:
    """The phrase that asks for another language and is no mere plus, else null."""
    return let(F.regexp_extract(text(body), js(V.REQUIRED_LANGUAGE), 0), lambda found: F.when((found != "") & ~found.rlike(js(V.MERELY_A_PLUS)), found))


def prefilter(title, body) -> Column:
    """struct(pass, reason, language, evidence, language_evidence): the first gate that fails gives the reason."""
    name = F.trim(text(title))

    def early(language: Column) -> Column:
        asked = let(required_language(body), lambda x: F.when(x.isNotNull(), F.concat(F.lit('Requires a language other than English: "'), x, F.lit('"'))))
        return (
            F.when(name.rlike(js(V.EXCLUDED_TITLE)), F.concat(F.lit("Excluded title: "), name))
            .when(~name.rlike(js(V.ENGINEERING_TITLE)), F.lit("Not an engineering title."))
            .when(name.rlike(js(V.NON_SOFTWARE_TITLE)) & ~name.rlike(js(V.AI_TITLE)), F.concat(F.lit("Outside AI software engineering: "), name))
            .when((language != "english") & ~text(body).rlike(js(V.ENGLISH_MARKER)), F.lit("Non-English JD does not mention English as a working language."))
            .when(text(body).rlike(js(V.NATIONALS_ONLY)), F.lit("Saudi-only role."))
            .otherwise(asked)
        )

    def searched(x: Column) -> Column:  # evidence is looked for only where no earlier gate fails
        found = F.when(x["early"].isNull(), ai_evidence(name, body)).otherwise(none())
        return let(F.struct(x["language"].alias("language"), x["early"].alias("early"), found.alias("evidence")), whole)

    def whole(x: Column) -> Column:
        reason = F.coalesce(x["early"], F.when(F.size(x["evidence"]) == 0, F.lit("No AI evidence in the title or description.")))
        return F.struct(reason.isNull().alias("pass"), reason.alias("reason"), x["language"].alias("language"), x["evidence"].alias("evidence"), F.when(reason.isNull(), language_evidence(body)).otherwise(none()).alias("language_evidence"))

    return let(job_language(title, body), lambda language: let(F.struct(language.alias("language"), early(language).alias("early")), searched))


def quote_around(x, pattern: str) -> Column:
    """The text between full stops around the first match, null without one. The text is searched once, whatever its length."""
    said = text(x)

    def around(found: Column) -> Column:
        before = F.substring_index(F.substring(said, F.lit(1), found["at"] - 1), ".", -1)
        after = F.regexp_extract(F.substring(said, found["at"] + F.char_length(found["match"]), F.char_length(said)), r"(?s)^[^.]*\.?", 0)
        return F.when(found["at"] > 0, F.trim(F.concat(before, found["match"], after)))

    one = js(f"(?:{pattern})")
    return let(F.struct(F.regexp_instr(said, F.lit(one)).alias("at"), F.regexp_extract(said, one, 0).alias("match")), around)


def role_relevant(evidence) -> Column:
    return F.exists(col(evidence), lambda e: e["source"] == "title") | (F.size(F.filter(col(evidence), lambda e: e["source"] == "JD")) >= 2)


def remote_scope(title, body, work_mode) -> Column:
    whole = F.concat(text(title), F.lit("\n"), text(body))
    return first_case(whole, V.SCOPES, F.when(col(work_mode).isin("onsite", "hybrid"), "onsite").otherwise("unknown"))


def sponsorship(title, body) -> Column:
    return first_case(F.concat(text(title), F.lit("\n"), text(body)), V.SPONSORSHIP, "unknown")


def seniority(title, body) -> Column:
    """The title's level first, then the description's."""
    return first_case(title, V.TITLE_LEVELS, first_case(F.concat(text(title), F.lit("\n"), text(body)), V.TEXT_LEVELS, "unknown"))


def confidence(value, known: float, unknown: float) -> Column:
    return F.when(col(value) == "unknown", F.lit(unknown)).otherwise(F.lit(known))


def countries(location) -> Column:
    """Country keys: by names in the table's order, codes in parentheses, then states and provinces after a comma."""
    where = text(location)
    named = F.array_compact(F.array(*[F.when(where.rlike(r"(?iu)(^|[^\p{L}])(" + "|".join(map(re.escape, names)) + r")($|[^\p{L}])"), F.lit(k)) for k, names in V.PLACES.items()]))
    codes = F.transform(F.regexp_extract_all(where, F.lit(r"\(([A-Z]{2})\)"), F.lit(1)), lambda c: F.when(c == "GB", F.lit("UK")).otherwise(c))
    found = F.array_distinct(F.concat(named, F.filter(codes, lambda c: c.isin(list(V.PLACES)))))
    after = F.regexp_extract_all(where, F.lit(r",\s*([A-Z]{2})\b"), F.lit(1))

    def step(seen: Column, code: Column) -> Column:
        canada = code.isin(V.CANADIAN_PROVINCES)
        state = code.isin(V.US_STATES) & ~F.array_contains(seen, "CA")
        return F.when(canada, F.array_union(seen, F.array(F.lit("CA")))).when(state, F.array_union(seen, F.array(F.lit("US")))).otherwise(seen)

    return F.aggregate(after, found, step)


def location_remote(location) -> Column:
    return text(location).rlike(js(r"(?i)\b(remote|anywhere|worldwide|distributed)\b"))


def work_mode(location, body) -> Column:
    place, head = F.lower(text(location)), F.lower(F.substring(text(body), 1, 1500))
    return (
        F.when(place.rlike(js(r"\bhybrid\b")), "hybrid")
        .when(place.rlike(js(r"\b(remote|anywhere|worldwide)\b")), "remote")
        .when(head.rlike(js(r"\bfully remote\b|\b100% remote\b|\bremote[- ]first\b")), "remote")
        .when(head.rlike(js(r"\bhybrid\b")), "hybrid")
        .when(F.trim(place) != "", "onsite")
        .otherwise("unknown")
    )


def plausible_email(x) -> Column:
    local, tld = F.split_part(text(x), F.lit("@"), F.lit(1)), F.lower(F.regexp_extract(text(x), r"@.*\.([^.]+)$", 1))
    return (local != "") & (F.char_length(local) <= 64) & (tld.rlike("^[a-z]{2,6}$") | tld.isin(V.LONG_TLDS))


def apply_email(body, apply_url=None) -> Column:
    """struct(email, quote) of the address that takes applications, null without one: a mailto link first, then the first sentence that invites them."""
    local = lambda e: F.split_part(e, F.lit("@"), F.lit(1))
    clean = lambda e: F.lower(F.regexp_replace(e, r"[.,;:)\]]+$", ""))
    context = let(sentences(body), lambda parts: F.filter(F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.concat_ws(" ", F.when(i > 0, F.get(parts, i - 1)), s).alias("c"))), lambda x: F.contains(x["s"], F.lit("@"))))

    def offers(x: Column) -> Column:
        hiring = x["c"].rlike(js(V.HIRING_CONTEXT))
        fits = lambda e: plausible_email(e) & ~local(e).rlike(js(V.NEVER_MAILBOX)) & (x["c"].rlike(js(V.APPLY_STRONG)) | (hiring & (x["c"].rlike(js(V.APPLY_SOFT)) | local(e).rlike(js(V.HIRING_MAILBOX)))))
        fine = F.filter(F.transform(apply_addresses(x["s"]), clean), fits)
        return F.transform(F.when(x["s"].rlike(js(V.NEVER_CONTEXT)), F.array().cast("array<string>")).otherwise(fine), lambda e: F.struct(e.alias("email"), clip(x["s"], 300).alias("quote")))

    said = F.get(F.flatten(F.transform(context, offers)), F.lit(0))
    if apply_url is None:
        return said
    link = clean(F.trim(F.try_url_decode(F.regexp_extract(text(apply_url), r"(?i)^mailto:([^?]*)", 1))))
    good = (F.instr(link, "@") > 0) & plausible_email(link) & ~local(link).rlike(js(V.NEVER_MAILBOX))
    return F.when(good, F.struct(link.alias("email"), F.concat(F.lit("Apply link: mailto:"), link).alias("quote"))).otherwise(said)


def public_emails(body) -> Column:
    """array of (email, quote): every address but excluded ones, with the first sentence that has it."""
    pairs = F.flatten(F.transform(F.filter(sentences(body), lambda s: F.contains(s, F.lit("@"))), lambda s: F.transform(apply_addresses(s), lambda e: F.struct(F.lower(e).alias("email"), clip(s, 400).alias("quote")))))
    fine = F.filter(pairs, lambda p: plausible_email(p["email"]) & ~F.split_part(p["email"], F.lit("@"), F.lit(1)).rlike(js(V.NEVER_MAILBOX)))
    return let(fine, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["email"])), lambda e: F.get(F.filter(ps, lambda p: p["email"] == e), F.lit(0))))


def reply_class(x) -> Column:
    return first_case(x, V.REPLIES, "positive")


def new_company_signal(body) -> Column:
    """The first sentence that tells of a young company, clipped; null without one."""
    said = F.get(F.filter(sentences(body), lambda s: s.rlike(js(V.NEW_COMPANY))), F.lit(0))
    return F.substring(said, 1, 300)


def literals(pattern: str) -> list[str]:
    """Strings of which each match of a pattern holds one, in lower case: its alternatives, options and sets written out. For patterns of plain words only."""
    out = []
    plain = pattern.replace("(?i)", "").replace(r"\b", "").replace(r"(?= |,|\))", "")
    for one in re.split(r"\|(?![^()]*\))", plain):
        made = [""]
        for piece, again in re.findall(r"(\([^()]*\)|\[[^\]]*\]|\\.|[^?])(\??)", one):
            choices = piece[1:-1].split("|") if piece[0] == "(" else list(piece[1:-1]) if piece[0] == "[" else [piece[-1]]
            made = [m + c for m in made for c in (choices + [""] if again else choices)]
        out += made
    kept = sorted({x.lower() for x in out}, key=lambda x: (len(x), x))
    return [x for i, x in enumerate(kept) if not any(k in x for k in kept[:i])]


def _skill(body: Column, low: Column, pattern: str) -> Column:
    """A search for a few strings comes first, so the pattern runs over the texts only that hold one of them."""
    there = F.lit(False)
    for x in literals(pattern):
        there = there | F.contains(low, F.lit(x))
    return there & body.rlike(js(pattern))


def skills_found(body) -> Column:
    """Names of the skills that a text mentions, in the table's order."""
    return let(F.lower(text(body)), lambda low: F.array_compact(F.array(*[F.when(_skill(text(body), low, pattern), F.lit(name)) for name, pattern in V.SKILLS])))


def skill_demand(bodies: DataFrame, body: str, own: list[str], most: int = 12) -> DataFrame:
    """(skill, n, in_cv): how many texts mention each skill, counted in one pass; the `most` first ones, and whether ours has them."""
    rows = bodies.select(text(body).alias("_body"), F.lower(text(body)).alias("_low"))
    one = rows.agg(*[F.count_if(_skill(F.col("_body"), F.col("_low"), pattern)).alias(f"s{i}") for i, (_, pattern) in enumerate(V.SKILLS)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("skill"), F.col(f"s{i}").alias("n"), F.lit(i).alias("place")) for i, (name, _) in enumerate(V.SKILLS)])).alias("s")).select("s.*").filter("n > 0")
    low = F.lower("skill")
    mine = F.lit(False)
    for word in own:
        mine = mine | F.lit(word.lower()).contains(F.regexp_replace(low, "s$", "")) | low.contains(word.lower())
    return rows.withColumn("in_cv", mine).orderBy(F.desc("n"), "place").limit(most).select("skill", "n", "in_cv")


def title_company(title, company, separator: str) -> Column:
    """struct(title, company): where the company is unknown, what stands before the title's first separator is it."""
    at = F.locate(separator, text(title))
    split = (at > 0) & col(company).isNull()
    rest = F.trim(F.substr(text(title), at + F.lit(len(separator))))
    return F.struct(F.when(split, rest).otherwise(col(title)).alias("title"), F.when(split, F.trim(F.substr(text(title), F.lit(1), at - 1))).otherwise(col(company)).alias("company"))


def cv_variant(title) -> Column:
    return F.when(text(title).rlike(r"(?i)full\s?stack|backend|back-end|platform"), "ai_fullstack").otherwise("ai_engineer")


def error_class(kind, status) -> Column:
    """retryable, blocked or permanent, by the kind of a fault (network, http, body_too_large, ...) and its HTTP status; null without a fault."""
    k, code = col(kind), col(status)
    again = k.isin("network", "body_too_large", "render", "database") | ((k == "http") & (code.between(500, 599) | code.isin(408, 425, 429)))
    return F.when(k.isNull(), None).when(again, "retryable").when(k.isin("blocked", "robots_denied"), "blocked").otherwise("permanent")


def search_query(i) -> Column:
    """The i-th query of the search plan: role, place and phrase count up like digits, one of four forms by turns."""
    n = col(i)
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))
    digit = lambda size: F.floor(n / size)
    roles, places = len(V.SEARCH_ROLES), len(V.SEARCH_PLACES)
    parts = {"{role}": pick(V.SEARCH_ROLES, n), "{place}": pick(V.SEARCH_PLACES, digit(roles)), "{phrase}": pick(V.SEARCH_PHRASES, digit(roles * places))}
    out = pick(V.SEARCH_FORMS, n)
    for name, value in parts.items():
        out = F.replace(out, F.lit(name), value)
    return out


def role_bucket(title) -> Column:
    return first_case(title, V.ROLE_BUCKETS, "Software engineer")


def grounded(quotes, source) -> Column:
    """Whether there are quotes and each stands in the source word for word."""
    return (F.size(col(quotes)) > 0) & F.forall(col(quotes), lambda q: F.contains(text(source), q))


def bot_wall(body, content_type) -> Column:
    """A small page that is a challenge; feeds and long pages that only mention one are none."""
    feed = F.lower(text(content_type)).rlike("json|xml") | (F.octet_length(text(body)) > 60_000)
    return ~feed & any_of(body, V.BOT_WALL)


def posting_closed(body) -> Column:
    return any_of(body, V.CLOSED)


def link_kind(url, label) -> Column:
    """apply, job, ats or career: by the label and the address, in this order."""
    u, t = F.lower(text(url)), F.lower(text(label))
    return (
        F.when(t.rlike("apply now|apply for") | (t == "apply") | u.rlike("application|/apply"), "apply")
        .when(t.rlike("job|position|opening") | u.rlike("/job|/career|gh_jid="), "job")
        .when(any_of(url, V.ATS_HOSTS[:4]), "ats")
        .otherwise("career")
    )


def ats_markers(body) -> Column:
    """Which known hosts the page names, sorted."""
    low = F.lower(text(body))
    return F.array_sort(F.filter(F.array(*[F.lit(m) for m in V.ATS_HOSTS]), lambda m: F.contains(low, m)))
