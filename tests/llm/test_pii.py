import hashlib
import random
import re
import time
from collections import defaultdict

from tessera.llm import pii
from tessera.llm.pii import base_spans, candidates, luhn, personal_data


def plain(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@@", ".", "1", "12", "255", "0001", "300", ".4", " ", "-", "+", "(", ")", "4111111111111111", "é", "%", "\n", "٣", "example.com", "+1 (988) 555-2485"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 16)))
        assert base_spans(text) == plain(text), repr(text)


def test_long_runs_are_linear():
    base_spans("1" * 200_000)
    base_spans("a" * 200_000 + "@" * 50_000)
    base_spans("+1 " + "(" * 200_000)


def test_a_trusted_context_finds_unseen_identifiers(spark):
    rows = [(i, f"write to contact: user{i}@mail.example.com now", "en") for i in range(12)]
    rows += [(100, "contact: XK-99812-PL is mine", "en"), (101, "release 2024-10-11 of it", None), (102, None, None), (103, "", None), (102, "again contact: ZZ-11122-QQ", None)]
    out = {(r.doc_id, len(r.base)): [(s.start, s.end) for s in r.more] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert out[(100, 0)] == [(9, 20)] and out[(101, 0)] == [] and out[(103, 0)] == [] and out[(0, 1)] == []
    assert len(out) == 16 and personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_candidates_are_linear():
    began = time.perf_counter()
    for text in ("a-" * 100_000, "a1-" * 70_000, "1" * 200_000, " " * 200_000 + "abc123", "x" * 200_000 + " abcd12 " + "y" * 200_000, "a1@b.c " * 30_000):
        candidates(text, base_spans(text))
    assert time.perf_counter() - began < 5
    (_, _, what, _, _, patterns), = candidates("w" * 100 + ": ab-1234 next", base_spans(""))
    assert what == "ab-1234" and patterns == ["left|" + "w" * 100 + "|: ", "both|" + "w" * 100 + "|next"]


def brute_discovery(texts, rounds=3, support=5, confidence=0.8):
    """The pattern-instance graph in dictionaries."""
    edges, seed, known = defaultdict(set), set(), set()
    for t in texts:
        for _, _, what, is_seed, shape, patterns in candidates(t, base_spans(t)):
            for p in patterns:
                edges[p].add(what)
                seed |= {what} if is_seed else set()
                known |= {what} if is_seed or shape else set()
    told = set()
    for _ in range(rounds):
        share = {p: len(s & known) / len(s) for p, s in edges.items() if len(s & known) >= support}
        doubt = defaultdict(lambda: 1.0)
        for p, x in share.items():
            if x >= confidence:
                for what in edges[p]:
                    doubt[what] *= max(1e-9, 1 - x)
        hit = {w for w, x in doubt.items() if 1 - x >= confidence}
        told, known = told | hit, known | hit
    return told - seed


def test_discovery_equals_brute_force(spark):
    rng = random.Random(11)
    leads = ["contact: ", "token = \"", "at ", "the ", "mail to ", "id:"]
    def thing():
        return rng.choice([f"user{rng.randrange(40)}@mail.example.com", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"AB-{rng.randrange(10**5)}", "2024-10-11", "10.0.0.%d" % rng.randrange(9), "plainword"])
    texts = [" ".join(rng.choice(leads) + (thing() if rng.random() < 0.5 else thing() if j % 3 else "word") + "\" and so on" for j in range(rng.randrange(1, 6))) for _ in range(300)]
    texts += [f"key = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\" end" for _ in range(20)] + ["key = \"Tz-1a-secret\" end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_discovery(texts)
    assert "Tz-1a-secret" in want and len(want) > 20
    assert {r.instance for r in pii.discover(pii.scan(docs)).collect()} == want


def test_the_query_keeps_the_base_spans(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pii.op9_pii(spark, sf)
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in ("email", "ip", "card", "phone")]
        assert r.n_spans == sum(map(len, spans.values())) + r.n_id and r.n_spans == len(r.spans.split(",") if r.spans else [])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.spans == base or r.spans.startswith(base + "," if base else "id:"))
