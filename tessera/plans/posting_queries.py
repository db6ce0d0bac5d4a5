"""Queries of the rules over postings made of `documents`: each text gets a title, sentences before and after it, a place. SQL is written from the rules' definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules, scoring, text, views
from tessera.functions import vocabulary as V
from tessera.operators import evaluate
from tessera.plans.relational_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}

TITLES = ["AI Engineer", "Senior Software Engineer", "Marketing Manager", "Staff Backend Developer: Platform", "ML Intern", "Hardware Engineer", "Acme Labs: Agentic AI Full-Stack Engineer", "Gardener", "Junior Machine Learning Engineer", "Lead Front-end Architect", "Forward Deployed Engineer, ai"]
LEADS = [
    "You will build LLM features and RAG agents for our users. English is our working language.", "We use an LLM. Wir suchen einen Entwickler.", "German C1 is required. We build agentic systems with Python, golang and K8s.", "Founded in 2024, we are a seed-stage start-up. Remote within APAC.",
    "Work from anywhere. 3+ years of machine learning.", "For Saudi nationals only. Prompt engineering with OpenAI.", "Visa sponsorship is available. We ship generative AI; React and SQL help.", "We are unable to sponsor visas. Fully remote team.", "French is required, or a plus. No other words.",
    "The team is hybrid. Remote, US only. Deploying models to production.", "Nothing to see here.", "Japanese is preferred. Native Korean is mandatory.", "This is an old bank. Vector database work; evals and fine-tuning.",
]
TAILS = ["Send your CV to Jobs@acme.dev.", "Privacy questions: privacy@acme.dev.", "Interested in this role? Write to hello@acme.io, or to ann.lee@acme.io.", "Apply on our page.", "For an accommodation email your resume to hr@acme.dev.", "The office manager is bob@acme.dev. Ask Bob@acme.dev again.", "Apply by e-mail: careers@acme.careers)."]
SITES = ["Berlin, Germany", "Austin, TX", "Toronto, ON", "Remote (GB)", "", "Zürich or London", "Hybrid - Paris", "Springfield, IL; Portland, OR", "Anywhere", "Halifax, NS; Portland, OR"]
LINKS = ["mailto:work%40acme.dev?subject=Hi", "https://acme.dev/apply", "mailto:privacy@acme.dev", ""]


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def many(values: list[str], at: str) -> str:
    return f"[{', '.join(map(q, values))}][CAST({at} AS INTEGER) + 1]"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sents(x: str, ends: str = ".!?") -> str:
    """The splitter, without look-behind: a line end is put after the marks."""
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '([{ends}])\s+', E'\\1\n', 'g'), '\n+', E'\n', 'g'), E'\n'), lambda s: trim(s)), lambda s: s <> '')"


def clipped(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN {x}[1:{most - 3}] || '...' ELSE {x} END"


def cases(x: str, table: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p)} THEN {q(label)}" for label, p in table) + f" ELSE {otherwise} END"


#: id, title, lead, body, location, link of each document's posting.
P = f"""p AS MATERIALIZED (SELECT doc_id AS id, {many(TITLES, "doc_id % 11")} AS title, {many(LEADS, "doc_id // 2 % 13")} || E'\\n' || text || E'\\n' || {many(TAILS, "doc_id % 7")} AS body, {many(SITES, "doc_id // 3 % 10")} AS location, {many(LINKS, "doc_id // 5 % 4")} AS link FROM documents)"""


def postings(spark, sf):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    d = F.col("doc_id")
    body = F.concat(pick(LEADS, F.floor(d / 2)), F.lit("\n"), "text", F.lit("\n"), pick(TAILS, d))
    return t(spark, sf, "documents").select(d.alias("id"), pick(TITLES, d).alias("title"), body.alias("body"), pick(SITES, F.floor(d / 3)).alias("location"), pick(LINKS, F.floor(d / 5)).alias("link"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(map(q, V.ENGLISH_STOP_WORDS))
LANGUAGE = rf"""lang AS MATERIALIZED (SELECT id, CASE WHEN letters = 0 THEN 'english' WHEN latin / letters < 0.6 THEN 'non_english' WHEN len(words) < 15 THEN 'english' WHEN len(list_filter(words, lambda w: w IN ({_STOP}))) / len(words) >= 0.08 THEN 'english' ELSE 'non_english' END AS language
FROM (SELECT id, len(regexp_extract_all(h, '\p{{L}}')) AS letters, len(regexp_extract_all(h, '[A-Za-z]')) AS latin, regexp_extract_all(lower(h), '[a-z'']+') AS words FROM (SELECT id, substring(body, 1, 6000) AS h FROM p)))"""
IS_AI = lambda s: f"({has(s, V.AI_ACRONYM)} OR {has(s, V.AI_PHRASE)})"
EVIDENCE = f"""ev AS MATERIALIZED (SELECT id, (list_concat(CASE WHEN {has("title", V.AI_TITLE)} OR {IS_AI("title")} THEN [{{'quote': title, 'source': 'title'}}] ELSE [] END, list_transform(list_filter({sents("body")}, lambda s: {IS_AI("s")}), lambda s: {{'quote': {clipped("s", 280)}, 'source': 'JD'}})))[1:3] AS e FROM p)"""


@query(f"WITH {P}, {EVIDENCE} SELECT id, array_to_string(list_transform(e, lambda x: x.source || ':' || x.quote), '|') AS evidence, len(list_filter(e, lambda x: x.source = 'title')) > 0 OR len(list_filter(e, lambda x: x.source = 'JD')) >= 2 AS relevant FROM ev")
def posting_evidence(spark, sf):
    """At most three quotes of AI work, and whether they make the role relevant."""
    rows = postings(spark, sf).withColumn("e", rules.ai_evidence("title", "body"))
    return rows.select("id", F.array_join(F.transform("e", lambda x: F.concat(x["source"], F.lit(":"), x["quote"])), "|").alias("evidence"), rules.role_relevant("e").alias("relevant"))


@query(f"""WITH {P}, {LANGUAGE}, {EVIDENCE}, r AS (SELECT id, trim(title) AS name, body, nullif(regexp_extract(body, {q(V.REQUIRED_LANGUAGE)}, 0), '') AS asked FROM p)
SELECT id, language, CASE WHEN {has("name", V.EXCLUDED_TITLE)} THEN 'Excluded title: ' || name WHEN NOT {has("name", V.ENGINEERING_TITLE)} THEN 'Not an engineering title.'
WHEN {has("name", V.NON_SOFTWARE_TITLE)} AND NOT {has("name", V.AI_TITLE)} THEN 'Outside AI software engineering: ' || name
WHEN language <> 'english' AND NOT {has("body", V.ENGLISH_MARKER)} THEN 'Non-English JD does not mention English as a working language.' WHEN {has("body", V.NATIONALS_ONLY)} THEN 'Saudi-only role.'
WHEN asked IS NOT NULL AND NOT {has("asked", V.MERELY_A_PLUS)} THEN 'Requires a language other than English: "' || asked || '"' WHEN len(e) = 0 THEN 'No AI evidence in the title or description.' END AS reason FROM r JOIN lang USING (id) JOIN ev USING (id)""")
def posting_prefilter(spark, sf):
    """The first gate that a posting fails."""
    return postings(spark, sf).withColumn("g", rules.prefilter("title", "body")).select("id", "g.language", "g.reason")


@query(f"""WITH {P} SELECT id, array_to_string(list_transform(list_filter({sents("body")}, lambda s: {has("s", V.OTHER_LANGUAGE)} OR {has("s", V.NATIONALS_ONLY)} OR {has("s", V.ENGLISH_MARKER)})[1:4], lambda s: {clipped("s", 280)}), '|') AS said,
CASE WHEN NOT {has("asked", V.MERELY_A_PLUS)} THEN asked END AS required FROM (SELECT *, nullif(regexp_extract(body, {q(V.REQUIRED_LANGUAGE)}, 0), '') AS asked FROM p)""")
def posting_languages(spark, sf):
    """Mentions of languages, and the one that is required."""
    said = F.transform(rules.language_evidence("body"), lambda e: e["quote"])
    return postings(spark, sf).select("id", F.array_join(said, "|").alias("said"), rules.required_language("body").alias("required"))


_MODE = f"""CASE WHEN {has("lower(location)", r"\bhybrid\b")} THEN 'hybrid' WHEN {has("lower(location)", r"\b(remote|anywhere|worldwide)\b")} THEN 'remote' WHEN {has("lower(substring(body, 1, 1500))", r"\bfully remote\b|\b100% remote\b|\bremote[- ]first\b")} THEN 'remote' WHEN {has("lower(substring(body, 1, 1500))", r"\bhybrid\b")} THEN 'hybrid' WHEN trim(location) <> '' THEN 'onsite' ELSE 'unknown' END"""
_WHOLE = "title || E'\\n' || body"


@query(f"""WITH {P}, m AS (SELECT *, {_WHOLE} AS whole, {_MODE} AS mode FROM p) SELECT id, mode AS work_mode, {has("location", r"(?i)\b(remote|anywhere|worldwide|distributed)\b")} AS by_place,
{cases("whole", V.SCOPES, "CASE WHEN mode IN ('onsite', 'hybrid') THEN 'onsite' ELSE 'unknown' END")} AS scope, {cases("whole", V.SPONSORSHIP, "'unknown'")} AS sponsorship, {cases("title", V.TITLE_LEVELS, cases("whole", V.TEXT_LEVELS, "'unknown'"))} AS level FROM m""")
def posting_verdicts(spark, sf):
    """Work mode, remote scope, sponsorship and level."""
    rows = postings(spark, sf).withColumn("work_mode", rules.work_mode("location", "body"))
    return rows.select("id", "work_mode", rules.location_remote("location").alias("by_place"), rules.remote_scope("title", "body", "work_mode").alias("scope"), rules.sponsorship("title", "body").alias("sponsorship"), rules.seniority("title", "body").alias("level"))


_NAMED = " || ".join(f"CASE WHEN regexp_matches(location, {q('(?i)(^|[^\\p{L}])(' + '|'.join(w.replace('.', '\\.') for w in names) + ')($|[^\\p{L}])')}) THEN [{q(k)}] ELSE [] END" for k, names in V.PLACES.items())
_CODES = f"list_filter(list_transform(regexp_extract_all(location, '\\(([A-Z]{{2}})\\)', 1), lambda c: CASE WHEN c = 'GB' THEN 'UK' ELSE c END), lambda c: c IN ({', '.join(map(q, V.PLACES))}))"


@query(f"""WITH {P}, n AS (SELECT id, location, {_NAMED} || {_CODES} AS named, regexp_extract_all(location, ',\\s*([A-Z]{{2}})\\b', 1) AS after FROM p),
a AS (SELECT id, named, list_transform(after, lambda c, i: CASE WHEN c IN ({', '.join(map(q, V.CANADIAN_PROVINCES))}) THEN 'CA' WHEN c IN ({', '.join(map(q, V.US_STATES))}) AND NOT list_contains(named, 'CA') AND NOT list_has_any(after[1:i - 1], [{', '.join(map(q, V.CANADIAN_PROVINCES))}]) THEN 'US' END) AS more FROM n)
SELECT id, array_to_string(list_reduce(list_prepend([], list_transform(named || list_filter(more, lambda c: c IS NOT NULL), lambda c: [c])), lambda x, y: CASE WHEN list_contains(x, y[1]) THEN x ELSE x || y END), ',') AS countries FROM a""")
def posting_countries(spark, sf):
    """Countries of a place: names, codes, then states and provinces."""
    return postings(spark, sf).select("id", F.array_join(rules.countries("location"), ",").alias("countries"))


_PLAUSIBLE = lambda e: f"(split_part({e}, '@', 1) <> '' AND length(split_part({e}, '@', 1)) <= 64 AND (regexp_matches(lower(regexp_extract({e}, '@.*\\.([^.]+)$', 1)), '^[a-z]{{2,6}}$') OR lower(regexp_extract({e}, '@.*\\.([^.]+)$', 1)) IN ({', '.join(map(q, V.LONG_TLDS))})))"
_LOCAL = lambda e: f"split_part({e}, '@', 1)"
_SENT = f"s AS MATERIALIZED (SELECT id, link, i, parts[i] AS s, CASE WHEN i > 1 THEN parts[i - 1] || ' ' || parts[i] ELSE parts[i] END AS c FROM (SELECT id, link, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT id, link, {sents('body')} AS parts FROM p)))"
_FOUND = f"f AS MATERIALIZED (SELECT id, i, s, c, k, found[k] AS raw FROM (SELECT id, i, s, c, found, unnest(range(1, len(found) + 1)) AS k FROM (SELECT id, i, s, c, regexp_extract_all(s, {q(V.EMAIL)}) AS found FROM s)))"
_CLEAN = "lower(regexp_replace({}, '[.,;:)\\]]+$', ''))"


@query(f"""WITH {P}, {_SENT}, {_FOUND}, e AS (SELECT id, i, k, s, c, {_CLEAN.format("raw")} AS email FROM f WHERE NOT {has("s", V.NEVER_CONTEXT)}),
said AS (SELECT id, arg_min(email, (i, k)) AS email, arg_min({clipped("s", 300)}, (i, k)) AS quote FROM e WHERE {_PLAUSIBLE("email")} AND NOT {has(_LOCAL("email"), V.NEVER_MAILBOX)}
  AND ({has("c", V.APPLY_STRONG)} OR ({has("c", V.HIRING_CONTEXT)} AND ({has("c", V.APPLY_SOFT)} OR {has(_LOCAL("email"), V.HIRING_MAILBOX)}))) GROUP BY id),
l AS (SELECT id, {_CLEAN.format("trim(replace(regexp_extract(link, '(?i)^mailto:([^?]*)', 1), '%40', '@'))")} AS link FROM p),
g AS (SELECT id, link, contains(link, '@') AND {_PLAUSIBLE("link")} AND NOT {has(_LOCAL("link"), V.NEVER_MAILBOX)} AS good FROM l)
SELECT id, CASE WHEN good THEN link ELSE email END AS email, CASE WHEN good THEN 'Apply link: mailto:' || link ELSE quote END AS quote FROM g LEFT JOIN said USING (id)""")
def posting_apply_email(spark, sf):
    """The address that takes applications, and where it stands."""
    return postings(spark, sf).withColumn("a", rules.apply_email("body", "link")).select("id", "a.email", "a.quote")


@query(f"""WITH {P}, {_SENT}, {_FOUND}, e AS (SELECT id, lower(raw) AS email, arg_min({clipped("s", 400)}, (i, k)) AS quote FROM f WHERE {_PLAUSIBLE("lower(raw)")} AND NOT {has(_LOCAL("lower(raw)"), V.NEVER_MAILBOX)} GROUP BY id, lower(raw)) SELECT * FROM e""")
def posting_contacts(spark, sf):
    """Every public address with the first sentence that has it."""
    return postings(spark, sf).select("id", F.explode(rules.public_emails("body")).alias("c")).select("id", "c.*")


@query(f"""WITH {P} SELECT id, {cases("title", [("Agentic / AI agents", V.ROLE_BUCKETS[0][1]), ("Fullstack", V.ROLE_BUCKETS[1][1])], "CASE WHEN " + has("title", r"(?i)\bai\b|\bllm|genai|applied ai") + " AND " + has("title", "(?i)engineer") + " THEN 'AI engineer' ELSE " + cases("title", V.ROLE_BUCKETS[3:], "'Software engineer'") + " END")} AS bucket,
CASE WHEN {has("title", "(?i)full\\s?stack|backend|back-end|platform")} THEN 'ai_fullstack' ELSE 'ai_engineer' END AS cv, CASE WHEN contains(title, ':') THEN trim(title[instr(title, ':') + 1:]) ELSE title END AS short_title, CASE WHEN contains(title, ':') THEN trim(title[1:instr(title, ':') - 1]) END AS company FROM p""")
def posting_titles(spark, sf):
    """Bucket, CV variant, and the company that a title names."""
    rows = postings(spark, sf).withColumn("tc", rules.title_company("title", F.lit(None).cast("string"), ":"))
    return rows.select("id", rules.role_bucket("title").alias("bucket"), rules.cv_variant("title").alias("cv"), F.col("tc.title").alias("short_title"), F.col("tc.company").alias("company"))


_BODY_QUOTE = "regexp_extract(body, '(?s)([^.]*(?:(?i:sponsor\\w*))[^.]*\\.?)', 1)"


@query(f"""WITH {P} SELECT id, substring(list_filter({sents("body")}, lambda s: {has("s", V.NEW_COMPANY)})[1], 1, 300) AS young, CASE WHEN {_BODY_QUOTE} <> '' THEN trim({_BODY_QUOTE}, E' ') END AS sponsor, contains(body, 'English is our working language') AS grounded FROM p""")
def posting_quotes(spark, sf):
    """The sentence that tells of a young company, the text around a word, and whether a quote stands in the posting."""
    return postings(spark, sf).select("id", rules.new_company_signal("body").alias("young"), rules.quote_around("body", r"(?i:sponsor\w*)").alias("sponsor"), rules.grounded(F.array(F.lit("English is our working language")), "body").alias("grounded"))


_SKILL = {name: p.replace(r"\bgo\b(?= |,|\))", r"\bgo\b( |,|\))") for name, p in V.SKILLS}


@query(f"WITH {P} SELECT id, array_to_string({' || '.join(f'CASE WHEN {has("body", p)} THEN [{q(name)}] ELSE [] END' for name, p in _SKILL.items())}, ',') AS skills FROM p")
def posting_skills(spark, sf):
    return postings(spark, sf).select("id", F.array_join(rules.skills_found("body"), ",").alias("skills"))


@query(f"WITH {P}, s AS ({' UNION ALL '.join(f'SELECT {q(name)} AS skill, {i} AS place, count(*) FILTER (WHERE {has("body", p)}) AS n, {str(name in ("Python", "SQL", "LLMs", "PostgreSQL")).lower()} AS in_cv FROM p' for i, (name, p) in enumerate(_SKILL.items()))}) SELECT skill, n, in_cv FROM s WHERE n > 0 ORDER BY n DESC, place LIMIT 12")
def posting_skill_demand(spark, sf):
    """The skills that most postings ask for."""
    return rules.skill_demand(postings(spark, sf), "body", ["python", "sql", "llm", "postgres"])


@query(f"""WITH {P} SELECT id, CASE WHEN {has("title", V.AGENTIC)} THEN 0.9 ELSE round(least(0.85, 0.35 + len(regexp_extract_all(body, {q(V.AGENTIC)})) * 0.08), 6) END AS focus,
round(0.5 + 0.5 * least(1.0, ({' + '.join(f"CAST({has('lower(body)', '(^|[^a-z0-9])' + w + '($|[^a-z0-9])')} AS INTEGER)" for w in ("python", "react", "sql", "rag"))}) / 8), 6) AS overlap FROM p""")
def posting_focus(spark, sf):
    """How agentic a posting is, and how many of our skills it names."""
    return postings(spark, sf).select("id", F.round(scoring.agentic_focus("title", "body"), 6).alias("focus"), F.round(scoring.skill_overlap("body", ["Python", "React", "SQL", "RAG"]), 6).alias("overlap"))


_NORMAL = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_FIRST = lambda p: f"coalesce(list_filter({sents('title', '.!?;')}, lambda s: {has('s', p)})[1], list_filter({sents('body', '.!?;')}, lambda s: {has('s', p)})[1])"
_OUT = "CASE " + " ".join(f"WHEN {has('name' if only else 'whole', p)} THEN {q(label)}" for label, p, only in V.CASE_DISQUALIFIERS) + " END"
_ROLE = f"""n AS MATERIALIZED (SELECT id, title, body, {_NORMAL(_WHOLE)} AS whole, {_NORMAL('title')} AS name, {_FIRST(V.CASE_AI)} AS ai, {_FIRST(V.CASE_ML)} AS ml, {_FIRST(V.CASE_PRODUCT)} AS product, {_FIRST(V.CASE_ENGINEERING)} AS eng FROM p),
o AS MATERIALIZED (SELECT *, {_OUT} AS excluded, ai IS NOT NULL AND eng IS NOT NULL AS direct, ml IS NOT NULL AND product IS NOT NULL AND eng IS NOT NULL AS shipped FROM n)"""


@query(f"""WITH {P}, {_ROLE} SELECT id, excluded IS NULL AND (direct OR shipped) AS fit, CASE WHEN excluded IS NOT NULL THEN 'Excluded by pre-filter: ' || excluded || '.' WHEN direct THEN 'AI/LLM work is paired with engineering evidence.' WHEN shipped THEN 'Product-facing ML deployment is paired with engineering evidence.' ELSE 'No clear AI software engineering or product-facing ML evidence.' END AS reason,
{cases("name", V.CASE_LEVELS, "'unknown'")} AS level FROM o""")
def case_roles(spark, sf):
    """The evaluator's role rule and level over postings."""
    rows = postings(spark, sf).withColumn("r", evaluate.role("title", "body"))
    return rows.select("id", "r.fit", "r.reason", evaluate.seniority(F.lit(None).cast("string"), "title").alias("level"))


_COUNT = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
_FOREIGN = " + ".join(f"CAST({has('whole', '\\b(?:' + p + ')\\b')} AS INTEGER)" for p in V.CASE_FOREIGN)
_NEED = "CASE " + " ".join(
    f"WHEN ({has(said, '(?i)\\b(?:' + V.CASE_REQUIRED + '|' + strong + ')\\b')} OR {has(said, '(?i)\\b(?:' + V.CASE_LEVEL + ')\\b')}) AND NOT ({has(said, '(?i)\\b(?:' + V.CASE_WISH + '|' + wish + ')\\b')} AND NOT {has(said, '(?i)\\b(?:' + V.CASE_REQUIRED + '|' + strong + ')\\b')}) THEN {q(name)}"
    for said, (name, _, strong, wish) in [(f"q{i}", x) for i, x in enumerate(V.CASE_LANGUAGES)]
) + " END"
_QUOTES = ", ".join(f"{_FIRST('(?i)\\b(?:' + match + ')\\b')} AS q{i}" for i, (_, match, _, _) in enumerate(V.CASE_LANGUAGES))


@query(f"""WITH {P}, w AS MATERIALIZED (SELECT id, {_NORMAL(_WHOLE)} AS whole, {_FIRST(V.CASE_NATIONALS)} AS nationals, {_FIRST(V.CASE_ENGLISH)} AS named, {_QUOTES} FROM p),
c AS (SELECT *, {_COUNT("whole", V.CASE_NON_LATIN)} AS other, {_COUNT("whole", "[a-z]")} AS latin, {_FOREIGN} AS strange, {_COUNT("whole", "\\b(?:" + V.CASE_ENGLISH_WORDS + ")\\b")} AS words, {_NEED} AS need FROM w),
e AS (SELECT *, CASE WHEN other > greatest(3.0, latin * 0.08) OR strange >= 2 THEN false ELSE words >= 2 OR (latin > 0 AND strange = 0) END AS english FROM c)
SELECT id, english, nationals IS NULL AND need IS NULL AND (english OR named IS NOT NULL) AS fit, CASE WHEN nationals IS NOT NULL THEN 'Saudi-only roles are excluded.' WHEN need IS NOT NULL THEN need || ' is required as a non-English working language.' WHEN english THEN 'English JD satisfies the working-language rule.'
WHEN named IS NOT NULL THEN 'Non-English JD explicitly mentions English as a working language.' ELSE 'Non-English JD does not mention English as a working language.' END AS reason FROM e""")
def case_languages(spark, sf):
    """The evaluator's language rule over postings."""
    rows = postings(spark, sf).withColumn("l", evaluate.language("title", "body"))
    return rows.select("id", evaluate.english("title", "body").alias("english"), "l.fit", "l.reason")


@query(f"""WITH {P}, {_ROLE}, x AS (SELECT o.id, l.quality = 1 AS y, excluded IS NULL AND (direct OR shipped) AS fit, {cases("name", V.CASE_LEVELS, "'unknown'")} AS bucket FROM o JOIN labels l ON l.doc_id = o.id)
SELECT bucket, count(*) FILTER (WHERE y AND fit) AS tp, count(*) FILTER (WHERE NOT y AND fit) AS fp, count(*) FILTER (WHERE y AND NOT fit) AS fn, count(*) FILTER (WHERE NOT y AND NOT fit) AS tn, round(CASE WHEN count(*) FILTER (WHERE fit) > 0 THEN count(*) FILTER (WHERE y AND fit) / count(*) FILTER (WHERE fit) END, 6) AS precision,
coalesce(count(*) FILTER (WHERE y AND fit) / nullif(count(*) FILTER (WHERE fit), 0) >= 0.5, false) AS passes FROM x GROUP BY GROUPING SETS ((), (bucket))""")
def case_metrics(spark, sf):
    """Outcomes of the role rule against labels: overall and by level, with a gate on precision."""
    rows = postings(spark, sf).join(t(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    rows = rows.select((F.col("quality") == 1).alias("label"), evaluate.role("title", "body")["fit"].alias("predicted"), evaluate.seniority(F.lit(None).cast("string"), "title").alias("bucket"))
    return evaluate.metrics(rows, ["bucket"]).select("bucket", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), evaluate.gate(F.col("precision"), 0.5).alias("passes"))


@query(f"""WITH {P} SELECT id, replace(replace(initcap_first, '_', ' '), '~', '') AS mode, level FROM (SELECT id, CASE {cases("title", V.TITLE_LEVELS, "'unknown'")} WHEN 'early' THEN 'Junior' WHEN 'senior' THEN 'Senior' WHEN 'lead' THEN 'Lead' ELSE 'Level unknown' END AS level,
CASE {_MODE} WHEN 'onsite' THEN 'On-site' WHEN 'unknown' THEN 'Not stated' WHEN 'remote' THEN 'Remote' ELSE 'Hybrid' END AS initcap_first FROM p)""")
def posting_labels(spark, sf):
    """What the front end calls modes and levels."""
    level = text.first_case("title", V.TITLE_LEVELS, "unknown")
    return postings(spark, sf).select("id", views.mode_label(rules.work_mode("location", "body")).alias("mode"), views.level_label(level).alias("level"))
