"""What a front end shows or filters, as columns: labels, summaries, target lists, checks of drafts and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.dates import age_group, local_day
from tessera.functions.scoring import lookup
from tessera.functions.text import col, js, let, normal_space, page_text, text


def percent(x) -> Column:
    """Fractions and percentages alike as a whole percent, halves up."""
    return F.floor(F.when(col(x) <= 1, col(x) * 100).otherwise(col(x)) + 0.5)


def percent_of(n, total) -> Column:
    return F.when(col(total) > 0, F.floor(col(n) / col(total) * 100 + 0.5)).otherwise(0)


def humanized(x) -> Column:
    words = F.trim(F.translate(text(x), "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000))


def level_label(x) -> Column:
    return lookup({"early": "Junior", "mid": "Mid-level", "senior": "Senior", "lead": "Lead"}, text(x), "Level unknown")


def mode_label(x) -> Column:
    known = {"remote_global": "Remote global", "global": "Remote global", "remote_apac": "Remote APAC", "apac": "Remote APAC", "remote_restricted": "Remote restricted", "restricted": "Remote restricted", "onsite": "On-site", "unknown": "Not stated"}
    pairs = F.create_map(*[F.lit(v) for item in known.items() for v in item])
    return F.coalesce(F.try_element_at(pairs, text(x)), humanized(x))


def agentic_label(x) -> Column:
    p = percent(x)
    return F.when(col(x).isNull(), None).when(p >= 70, "Agentic focus high").when(p >= 40, "Agentic focus some").otherwise("Agentic focus low")


def fit_word(p) -> Column:
    return F.when(col(p) >= 75, "Strong").when(col(p) >= 50, "Partial").otherwise("Weak")


def score_band(x) -> Column:
    return F.when(col(x) >= 70, "good").when(col(x) >= 40, "mid").otherwise("low")


#: What score parts are called.
FIT_LABELS = {"roleFit": "role fit", "seniority": "seniority", "modeVisa": "work mode and visa", "freshness": "freshness", "skillOverlapCv": "skill overlap with your CV", "agenticFocus": "agentic focus", "preferenceFit": "fit with your likes"}


def fit_summary(parts: dict[str, Column]) -> Column:
    """A sentence of the strongest (75 and over) and weakest (under 50) parts; nulls don't count."""
    each = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(FIT_LABELS.get(k, k)).alias("label"), percent(v).alias("p"))) for k, v in parts.items()]))

    def words(kept: Column) -> Column:
        labels = F.transform(kept, lambda x: x["label"])
        head = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), ", ")
        return F.when(F.size(labels) <= 1, F.array_join(labels, "")).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(labels, F.lit(-1))))

    strong, weak = F.filter(each, lambda x: x["p"] >= 75), F.filter(each, lambda x: x["p"] < 50)
    said = F.concat_ws(" ", F.when(F.size(strong) > 0, F.concat(F.lit("Strong on "), words(strong), F.lit("."))), F.when(F.size(weak) > 0, F.concat(F.lit("Weak on "), words(weak), F.lit("."))))
    return F.when(F.size(each) == 0, "No score breakdown yet.").when(said == "", "A middling fit on every part.").otherwise(said)


def usable_contacts(contacts) -> Column:
    return F.filter(col(contacts), lambda c: (F.coalesce(c["email"], F.lit("")) != "") & ~F.coalesce(c["verdict"] == "invalid", F.lit(False)))


#: Statuses that a target list hides; hours of its ages.
HIDDEN = ["closed", "skipped", "blacklisted"]
AGES = {"24h": 24, "72h": 72, "7d": 168}


def targets(jobs: DataFrame, now: Column, age: str | None = None, search: str | None = None, has_email: bool = False, order: str = "score", **equal) -> DataFrame:
    """Open targets by age, equality filters, usable contact and free text; those by e-mail first, then the order, then id."""
    out = jobs.filter(~F.col("status").isin(HIDDEN))
    since = F.coalesce("posted_at", "first_seen_at")
    if age:
        out = out.filter(F.unix_micros(since) >= F.unix_micros(now) - AGES[age] * 3_600_000_000)
    for k, v in equal.items():
        if v is not None:
            out = out.filter(F.col(k) == v)
    if has_email:
        out = out.filter(F.size(usable_contacts("contacts")) > 0)
    if search:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "company", "title", "location", "apply_email")), F.lit(search.lower())))
    by = {"score": [F.desc_nulls_last("score")], "newest": [F.desc_nulls_last(since)], "agentic": [F.desc_nulls_last("agentic_focus"), F.desc_nulls_last("score")]}[order]
    return out.orderBy(F.desc(F.coalesce(F.col("apply_method") == "email", F.lit(False))), *by, "id")


def draft_valid(subject, body, job_url) -> Column:
    """All of: a subject of fair length, the posting's address, a number, a call, a place or visa, and a start."""
    size = F.char_length(F.trim(text(subject)))
    tests = [r"\d", "(?i)(call|chat|meet|conversation|discussion)", r"(?i)(remote(ly)? from indonesia|relocat|visa sponsorship|work authorization)", "(?i)(available|availability|notice period|start date)"]
    out = size.between(8, 180) & F.contains(text(body), text(job_url))
    for t in tests:
        out = out & text(body).rlike(t)
    return out


def draft_grounded(quotes, why, body, source, job_url) -> Column:
    """Every quote stands in the source after normalisation, the reason in the body, and the address too."""
    same = lambda x: F.lower(normal_space(x))
    fine = F.forall(col(quotes), lambda q: (F.trim(q) != "") & F.contains(same(source), same(q)))
    return (F.size(col(quotes)) > 0) & fine & F.contains(same(body), same(why)) & F.contains(text(body), text(job_url))


def contact_fault(email, source_url, quote) -> Column:
    """invalid_email, email_not_evidenced, invalid_contact_source, or null."""
    address = F.trim(text(email))
    return (
        F.when(~address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "invalid_email")
        .when(~F.contains(text(quote), address), "email_not_evidenced")
        .when(~text(source_url).rlike(r"(?i)^(https://|http://(localhost|127\.0\.0\.1)([:/]|$))"), "invalid_contact_source")
    )


def contact_verdict(invalid_at, verdict) -> Column:
    return F.when(col(invalid_at).isNotNull(), "invalid").when(col(verdict), "valid").when(~col(verdict), "invalid").otherwise("unverified")


#: Words of company names and local parts that say nothing.
COMPANY_WORDS = r"(?i)\b(inc|ltd|llc|gmbh|ag|labs?|ai|technologies|technology|group|corp)\b"
PLACEHOLDERS = r"(?i)^(first|last|firstname|lastname|first\.last|firstlast|flast|f\.last|first_last|first\.l|name|email|example|john\.?doe|jdoe|jane\.?doe|your\.?name|user)$"
NOT_RECRUITING = r"(?i)^(privacy|gdpr|dpo|legal|abuse|no-?reply|donotreply|security|press|media|investors?|billing|invoices?|support|help|sales|info|hello|contact|partners?)$"


def own_domain(email, company) -> Column:
    """Whether an address is at the company's own domain: one name begins the other, three letters or more."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    label = plain(F.coalesce(F.get(F.reverse(F.split(F.split_part(text(email), F.lit("@"), F.lit(2)), r"\.")), F.lit(1)), F.lit("")))
    name = plain(F.regexp_replace(text(company), js(COMPANY_WORDS), ""))
    return (F.length(label) >= 3) & (F.length(name) >= 3) & (label.startswith(name) | name.startswith(label))


def recruiter_addresses(results_text, company) -> Column:
    """At most three addresses of a search result's text at the company's own domain that may be a recruiter's."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text(results_text), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), lambda e: F.regexp_replace(F.lower(e), r"\.+$", "")))
    local = lambda e: F.split_part(e, F.lit("@"), F.lit(1))
    return F.slice(F.filter(found, lambda e: own_domain(e, company) & ~local(e).rlike(PLACEHOLDERS) & ~local(e).rlike(NOT_RECRUITING)), 1, 3)


#: Sites that guess addresses, and the search service's own.
GUESSING_SITES = r"(?i)(rocketreach|zoominfo|signalhire|contactout|apollo\.io|lusha|hunter\.io|leadiq|clearbit|snov\.io|voilanorbert|emailformat|email-format|kendoemailapp|getemail|findthat)"
OWN_SITE = r"brave\.com|search\.brave"
ADDRESS, HREF = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r'href="(https?://[^"]+)"'


def positions(x: Column, pattern: str, group: int) -> Column:
    """array of (at, end, value) of all matches of a pattern in a text, counted from 0: the lengths of what lies between are summed."""
    between, whole, value = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(group + 1))
    each = F.zip_with(F.slice(between, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), value.alias("v")), lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m["w"]).alias("size"), m["v"].alias("v")))
    shape = "struct<at:int,out:array<struct<at:int,end:int,value:string>>>"

    def step(s: Column, m: Column) -> Column:
        at = s["at"] + m["gap"]
        return F.struct((at + m["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("at"), (at + m["size"]).alias("end"), m["v"].alias("value")))).alias("out")).cast(shape)

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,end:int,value:string>>").alias("out")).cast(shape), step)["out"]


def mails_with_links(html) -> Column:
    """array of (email, at, url): every address of a page's markup, scripts and styles taken out, with the nearest link before it; null without one.

    An as-of match in one pass: links and addresses are merged by place, and the last link is carried along.
    """
    clean = F.regexp_replace(F.regexp_replace(text(html), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")

    def matched(x: Column) -> Column:
        links = F.transform(F.filter(positions(x, HREF, 1), lambda p: ~p["value"].rlike(OWN_SITE)), lambda p: F.struct(p["end"].alias("at"), F.lit(0).alias("kind"), p["value"].alias("value"), p["at"].alias("start")))
        mails = F.transform(positions(x, ADDRESS, 0), lambda p: F.struct(p["at"].alias("at"), F.lit(1).alias("kind"), p["value"].alias("value"), p["at"].alias("start")))
        shape = "struct<url:string,out:array<struct<email:string,at:int,url:string>>>"

        def step(s: Column, p: Column) -> Column:
            mail = p["kind"] == 1
            found = F.array(F.struct(F.regexp_replace(F.lower(p["value"]), r"\.+$", "").alias("email"), p["start"].alias("at"), s["url"].alias("url")))
            return F.struct(F.when(mail, s["url"]).otherwise(p["value"]).alias("url"), F.when(mail, F.concat(s["out"], found)).otherwise(s["out"]).alias("out")).cast(shape)

        start = F.struct(F.lit(None).cast("string").alias("url"), F.array().cast("array<struct<email:string,at:int,url:string>>").alias("out")).cast(shape)
        return F.transform(F.aggregate(F.array_sort(F.concat(links, mails)), start, step)["out"], lambda m: F.struct(m["email"], m["at"], m["url"], _window(x, m).alias("window")))

    return let(clean, matched)


def _window(x: Column, m: Column) -> Column:
    """400 characters before an address and 200 behind it as plain text."""
    first = F.greatest(F.lit(0), m["at"] - 400)
    out = F.substring(x, first + 1, m["at"] + F.char_length(m["email"]) + 200 - first)
    for pattern in (r"<[^>]+>", r"<[^>]*$", r"^[^<]*>", r"(?i)&[a-z#0-9]+;"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def recruiter_contacts(html, company) -> Column:
    """array of (email, quote, url): at most three addresses of a result page at the company's own domain, each with its nearest preceding link and what is said around it."""
    local = lambda e: F.split_part(e, F.lit("@"), F.lit(1))
    fine = lambda m: own_domain(m["email"], company) & ~local(m["email"]).rlike(PLACEHOLDERS) & ~local(m["email"]).rlike(NOT_RECRUITING) & m["url"].isNotNull() & ~m["url"].rlike(GUESSING_SITES) & F.contains(F.lower(m["window"]), m["email"])

    def told(m: Column) -> Column:
        at = F.call_function("instr", F.lower(m["window"]), m["email"]) - 1
        first = F.greatest(F.lit(0), at - 160)
        return F.struct(m["email"], F.trim(F.substring(m["window"], first + 1, at + F.char_length(m["email"]) + 80 - first)).alias("quote"), m["url"])

    def firsts(ms: Column) -> Column:
        once = F.transform(F.slice(F.array_distinct(F.transform(ms, lambda m: m["email"])), 1, 3), lambda e: F.get(F.filter(ms, lambda m: m["email"] == e), F.lit(0)))
        return F.transform(once, told)

    return let(F.filter(mails_with_links(html), fine), firsts)


def reader_kind(adapter, method, url) -> Column:
    """Which reader a source gets: its adapter, else its method, else its address; null for unknown ones."""
    names = {"greenhouse": "greenhouse", "lever": "lever", "ashby": "ashby", "workday": "workday", "workday_cxs": "workday", "hn_whoishiring": "hiring_thread", "json_api": "json", "rss": "rss", "sitemap": "sitemap", "json_ld": "json_ld", "html_selector": "selector", "csv_download": "csv", "headless": "headless"}
    pairs = F.create_map(*[F.lit(v) for item in names.items() for v in item])
    hosts = F.lit(None).cast("string")
    for host, kind in (("myworkdayjobs.com", "workday"), ("ashbyhq.com", "ashby"), ("lever.co", "lever"), ("greenhouse.io", "greenhouse")):
        hosts = F.when(F.contains(F.lower(text(url)), F.lit(host)), kind).otherwise(hosts)
    by_method = F.when(col(method).isNull() | (F.lower(col(method)) == "custom_adapter"), hosts).otherwise(F.try_element_at(pairs, F.lower(col(method))))
    return F.when(col(adapter).isNotNull(), F.try_element_at(pairs, F.lower(col(adapter)))).otherwise(by_method)


def spaced(sends: DataFrame, seed: int = 1) -> DataFrame:
    """(zone, id, base) -> scheduled: in order of base, each four to twelve minutes after the later of its base and the one before.

    The gap is drawn from a hash of the id and the seed, so a run can be repeated. s(k) = max(base(k), s(k-1)) + g(k) is the
    running slot of base + gap. A zone may have all sends.
    """
    from tessera.operators.scan import running_slots

    gap = (240 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(481))) * 1_000_000
    out = running_slots(sends, ["zone"], ["base", "id"], F.unix_micros("base") + gap, gap, "scheduled")
    return out.withColumn("scheduled", F.timestamp_micros("scheduled"))


def listing_url(x) -> Column:
    """Whether an address is a list or search page rather than a posting."""
    return text(x).rlike(V.LISTING_URL)


BLOCK = "array<struct<kind:string,items:array<string>>>"


def description_blocks(x) -> Column:
    """array of (kind, items) of a description: heading, list, para. Neighbouring list lines are one list.

    A line after # marks, or a short one that ends in a colon, is a heading; a line of over 480 characters is cut into
    paragraphs of three sentences.
    """
    lines = F.filter(F.transform(F.split(text(x), r"\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    block = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), F.array(value).alias("items"))).cast(BLOCK)

    def one(line: Column) -> Column:
        parts = F.split(line, r'(?<=[.!?])\s+(?=[A-Z0-9"\u201C(])')
        threes = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(3)), lambda i: F.struct(F.lit("para").alias("kind"), F.array(F.array_join(F.slice(parts, i, 3), " ")).alias("items")))
        return (
            F.when(line.rlike(r"^[\u2022*-]\s+"), block("list", F.regexp_replace(line, r"^[\u2022*-]\s+", "")))
            .when(line.rlike(r"^#{1,6}\s+"), block("heading", F.regexp_replace(line, r"^#{1,6}\s+", "")))
            .when((F.char_length(line) < 60) & line.endswith(":"), block("heading", F.regexp_replace(line, ":$", "")))
            .when(F.char_length(line) > 480, threes.cast(BLOCK))
            .otherwise(block("para", line))
        )

    def put(made: Column, b: Column) -> Column:
        last = F.try_element_at(made, F.lit(-1))
        longer = F.array(F.struct(F.lit("list").alias("kind"), F.concat(last["items"], b["items"]).alias("items"))).cast(BLOCK)
        both = F.coalesce((b["kind"] == "list") & (last["kind"] == "list"), F.lit(False))
        return F.when(both, F.concat(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), longer)).otherwise(F.concat(made, F.array(b).cast(BLOCK)))

    return F.aggregate(F.flatten(F.transform(lines, one)), F.array().cast(BLOCK), put)


#: The characters of Unicode's Extended_Pictographic, which Java's patterns do not know by name.
PICTOGRAPHS = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}"
    r"\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}"
    r"\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}"
    r"\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}"
    r"\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}"
)


def without_pictographs(x) -> Column:
    """Quotes as they stand, without pictographs, their selectors and joiners; runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(x), f"[{PICTOGRAPHS}\\x{{FE0F}}\\x{{200D}}]", ""), r"(?U)\s{2,}", " "))


def admission(confidence, verdict, method, generic: list[str], now: Column, auto: bool = True) -> Column:
    """struct(status, trial_until): a source that is surely good and has a generic reader is active on a trial of seven days, others are candidates."""
    sure = (col(confidence) >= 0.75) & col(verdict) & col(method).isin(generic) & F.lit(auto)
    active = F.coalesce(sure, F.lit(False))
    return F.struct(F.when(active, "active").otherwise("candidate").alias("status"), F.when(active, F.timestamp_micros(F.unix_micros(now) + 7 * 86_400_000_000)).alias("trial_until"))


def country_short(x) -> Column:
    code = F.upper(text(x))
    known = F.create_map(*[F.lit(v) for item in V.COUNTRY_SHORT.items() for v in item])
    return F.coalesce(F.try_element_at(known, code), F.when(F.char_length(code) == 2, code), text(x))


PLACE = "struct<city:string,country:string,countries:array<string>,regions:array<string>>"


def _place(segment: Column, us_first: Column) -> Column:
    """What the parts of a place's text are: a city, countries, regions; the first city and the first country stand for it."""
    words = F.create_map(*[F.lit(v) for item in V.COUNTRY_WORDS.items() for v in item])
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, js(V.PLACE_NOISE), " "), r"\s+", " "), r"^[^\p{L}]+|[^\p{L}.]+$", ""))
    tokens = F.filter(F.transform(F.split(segment, js(r"(?i)\s*(?:,|:|\s-\s|\band\b)\s*")), clean), lambda t: t != "")

    def step(s: Column, token: Column) -> Column:
        key, no_city = F.lower(token), s["city"] == ""
        name = F.try_element_at(words, key)
        ends_us = key.rlike(r"\s(usa|us)$") & no_city
        state = ~no_city & key.isin(V.PLACE_STATES) & (us_first | (F.char_length(key) > 2) | name.isNull())
        country, region = name.isNotNull() & (name != ""), (name.isNotNull() & (name == "")) | (name.isNull() & key.isin(V.PLACE_REGIONS))
        other = key.rlike(r"\d") | key.rlike(js(r"^(days?|weeks?|week|hours?|months?|years?)\b"))
        first = lambda old, new: F.when(old == "", new).otherwise(old)
        in_us, plain = ends_us | state, ~(name.isNotNull() | region | other)
        return F.struct(
            F.when(ends_us, F.regexp_replace(token, r"(?i)\s+(usa|us)$", "")).when(~state & plain, first(s["city"], token)).otherwise(s["city"]).alias("city"),
            F.when(in_us, first(s["country"], F.lit("US"))).when(country, first(s["country"], name)).otherwise(s["country"]).alias("country"),
            F.when(~in_us & country, F.array_union(s["countries"], F.array(name))).otherwise(s["countries"]).alias("countries"),
            F.when(~in_us & region, F.array_union(s["regions"], F.array(token))).otherwise(s["regions"]).alias("regions"),
        ).cast(PLACE)

    none = F.array().cast("array<string>")
    return F.aggregate(tokens, F.struct(F.lit("").alias("city"), F.lit("").alias("country"), none.alias("countries"), none.alias("regions")).cast(PLACE), step)


def place_label(location, country) -> Column:
    """A location's text as one short phrase: a city and country and how many more cities, or a count of countries or regions."""
    raw = F.trim(F.regexp_replace(text(location), r"\([^)]*\)", " "))
    fallback = F.when(text(country).isin("", "Other", "Remote", "unknown"), "").otherwise(country_short(country))
    us_first = country_short(country) == "US"
    segments = F.filter(F.transform(F.split(raw, js(r"(?i)\s*(?:\||;|/|\bor\b)\s*")), lambda s: F.trim(s)), lambda s: s != "")
    places = F.transform(segments, lambda s: _place(s, us_first))

    def phrase(p: Column) -> Column:
        extra = F.size(F.filter(F.slice(places, 2, 2**30), lambda x: x["city"] != ""))
        plus = F.when(extra > 0, F.concat(F.lit(" +"), extra.cast("string"))).otherwise("")
        where = F.when(p["country"] == "", fallback).otherwise(p["country"])
        count = lambda a, word: F.concat(F.size(a).cast("string"), F.lit(f" {word}"))
        return (
            F.when((p["city"] == "") & (F.size(p["countries"]) >= 3), count(p["countries"], "countries"))
            .when((p["city"] == "") & (p["country"] == "") & (F.size(p["regions"]) >= 2), count(p["regions"], "regions"))
            .when((p["city"] != "") & (where != "") & (F.lower(p["city"]) != F.lower(where)), F.concat(p["city"], F.lit(", "), where, plus))
            .when(p["city"] != "", F.concat(p["city"], plus))
            .when(F.size(p["countries"]) == 2, F.array_join(p["countries"], " and "))
            .when(where != "", F.concat(where, plus))
            .when(F.size(p["regions"]) > 0, F.concat(F.get(p["regions"], F.lit(0)), plus))
            .otherwise("Location varies")
        )

    stated = F.get(F.transform(F.slice(places, 1, 1), phrase), F.lit(0))
    return F.when(raw == "", F.coalesce(F.nullif(fallback, F.lit("")), F.lit("Location not stated"))).otherwise(F.coalesce(stated, F.nullif(fallback, F.lit("")), F.lit("Location varies")))


def page_record(html) -> Column:
    """struct(text, title, site_name) of a page: what a reader sees, 40,000 characters at most of the first three million."""
    head = F.substring(text(html), 1, 3_000_000)
    title = normal_space(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1))
    site = F.nullif(F.regexp_extract(head, r'(?i)<meta[^>]+property="og:site_name"[^>]+content="([^"]+)"', 1), F.lit(""))
    return F.struct(F.substring(page_text(head), 1, 40_000).alias("text"), title.alias("title"), site.alias("site_name"))


def by_age(page: DataFrame, now: Column, zone: str | None = None) -> DataFrame:
    """(group, ids) of a page of targets in the order of `position`: today's, this week's, older ones; empty groups are left out."""
    group = age_group(F.coalesce("posted_at", "first_seen_at"), now, zone)
    rows = page.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("r"))
    return rows.select("group", F.transform("r", lambda x: x["id"]).alias("ids"))


def country_list(targets: DataFrame) -> DataFrame:
    return targets.select("country").filter(F.trim(F.coalesce("country", F.lit(""))) != "").distinct().orderBy("country")


def live_and_failing(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """One row: active sources, and companies whose health is not ok."""
    live = sources.agg(F.count_if(F.col("status") == "active").alias("live"))
    return live.crossJoin(companies.agg(F.count_if(~F.coalesce(F.col("health") == "ok", F.lit(False))).alias("failing")))  # one row each


def sent_today(outreach: DataFrame, now: Column, zone: str) -> DataFrame:
    return outreach.agg(F.count_if(local_day("sent_at", zone) == local_day(now, zone)).alias("sent_today"))


def week_totals(daily: DataFrame) -> DataFrame:
    """One row of a week's series: its sums and the height of its chart, 1 at least."""
    return daily.agg(F.coalesce(F.sum("discovered"), F.lit(0)).alias("posted"), F.coalesce(F.sum("targeted"), F.lit(0)).alias("targeted"), F.greatest(F.max("discovered"), F.lit(1)).alias("top"))


def last_crawl(times: list[Column], now: Column, hours: int = 6) -> Column:
    """struct(latest, idle): the latest crawl of any tier, and whether it was too long ago."""
    latest = F.greatest(*times)
    return F.struct(latest.alias("latest"), F.coalesce(F.unix_micros(now) - F.unix_micros(latest) > hours * 3_600_000_000, F.lit(True)).alias("idle"))


def fit_lines(parts: dict[str, Column]) -> Column:
    """array of (key, percent, label) of a score's parts, the highest first; nulls don't count."""
    each = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(percent(v).alias("percent"), F.lit(-i).alias("place"), F.lit(k).alias("key"), F.lit(FIT_LABELS.get(k, k)).alias("label"))) for i, (k, v) in enumerate(parts.items())]))
    return F.transform(F.reverse(F.array_sort(each)), lambda x: F.struct(x["key"], x["percent"], x["label"]))


def apply_first(contacts) -> Column:
    """Contacts with those that take applications first, else in their order."""
    mine = lambda c: F.coalesce(c["role"] == "apply", F.lit(False))
    return F.concat(F.filter(col(contacts), mine), F.filter(col(contacts), lambda c: ~mine(c)))


def motivation(replied, applied_week, fresh, waiting) -> Column:
    """One sentence of the week's counts; nulls count as 0."""
    replied, applied, fresh, waiting = (F.coalesce(col(x), F.lit(0)) for x in (replied, applied_week, fresh, waiting))
    some = lambda n, one, more: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more}"))
    return (
        F.when((replied > 0) & (applied > 0), F.concat(some(replied, "reply", "replies"), F.lit(" in, and "), applied.cast("string"), F.lit(" sent this week. Keep going.")))
        .when(fresh > 0, F.concat(some(fresh, "fresh role", "fresh roles"), F.lit(" landed in the last 72 hours.")))
        .when(applied > 0, F.concat(some(applied, "application", "applications"), F.lit(" out this week. Keep the streak.")))
        .when(waiting > 0, F.concat(waiting.cast("string"), F.lit(" targets are waiting. Pick the best one and draft an email.")))
        .otherwise("The scout is out looking. New roles will show up here.")
    )


def role_title(body, fallback) -> Column:
    """The role that a page says is hired for, else the page's title without the site's name, 140 characters at most."""
    role = F.trim(F.regexp_extract(text(body), V.ROLE_LINE, 1))
    plain = F.regexp_replace(F.regexp_replace(text(fallback), V.SITE_SUFFIX, ""), V.SITE_PREFIX, "")
    return F.when(role != "", role).otherwise(F.trim(F.substring(plain, 1, 140)))


def hiring_company(site_name, email, url) -> Column:
    """struct(name, domain) of who hires: the mail's domain, for a free mail service the page's host unless that is a social site.

    The name is the page's site name unless that is a social site's, else the label before the last of the domain (or host);
    80 characters at most. Null without an address that has a host.
    """
    from tessera.functions.urls import domain

    host, at = domain(url), F.lower(F.split_part(text(email), F.lit("@"), F.lit(2)))
    found = F.when(text(email).rlike(V.FREE_MAIL), F.when(~host.rlike(V.SOCIAL_HOST), host)).otherwise(at)

    def told(d: Column) -> Column:
        whole = F.coalesce(d["domain"], d["host"])
        label = F.coalesce(F.get(F.reverse(F.split(whole, r"\.")), F.lit(1)), whole)
        site = F.when((d["site"] != "") & ~d["site"].rlike(V.SOCIAL_SITE), d["site"])
        name = F.coalesce(site, F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 2**30)))
        return F.struct(F.substring(name, 1, 80).alias("name"), d["domain"].alias("domain"))

    return F.when(host.isNotNull(), let(F.struct(host.alias("host"), found.alias("domain"), text(site_name).alias("site")), told))
