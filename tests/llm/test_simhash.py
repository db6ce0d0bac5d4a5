import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.simhash import fingerprint, links, near_duplicates, segments


def plain(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", " \n", "One", "Two WORDS", "a b c", "É a b c\x1cd e\tf\x0bg", "x " * 2000 + "y", "a b a b a b a b"]:
        for words in (3, 5):
            assert fingerprint(text.encode(), words) == plain(text, words), repr(text)


@pytest.mark.parametrize("bits", [2, 3, 5])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    seen = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(500):
        f = rng.choice(sorted(seen))
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        seen.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in seen)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    got = [(r.a, r.b) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert sum(w for _, w in segments(bits)) == 64


def test_components_and_edges(spark):
    rows = [(5, "a b c d e", "x"), (3, "A b  c d e", "y"), (9, None, "x"), (8, "", None), (7, "q r s t u", "x"), (7, "q r s t u", "x")]
    out = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect())
    assert out == [(3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chains_are_one_component(spark):
    from tessera.llm.components import components

    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (None, 3), (7, 7)], "a long, b long"))
    out = {r.node: r.component for r in components(edges).collect()}
    assert len(out) == 203 and all(out[n] == (0 if n < 500 else 500) for n in out)


def test_jaccard_of_four_fifths_is_linked(spark):
    from tessera.llm import simhash

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shingled = lambda t: set(simhash.shingle_hashes(t.encode(), 5).tolist())
    rows, pairs = [], []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(150, 600))]
        aim = (0.8, 0.85, 0.9, 0.7)[i % 4]
        other, base = list(words), shingled(" ".join(words))
        while True:
            trial = list(other)
            trial[rng.randrange(len(trial))] = word()
            x = shingled(" ".join(trial))
            if len(x & base) / len(x | base) < aim:
                break
            other = trial
        if i % 4 == 3:
            other = trial
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(i % 4 != 3)
    family = [word() for _ in range(300)]  # many near copies of one text, each of them unlike some others
    for k in range(100):
        copy = list(family)
        copy[3 * k : 3 * k + 4] = [word() for _ in range(4)]
        rows.append((1000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, words=5, bits=5, least=0.8).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(120) if pairs[i]] == [True] * 90
    assert sum(got[2 * i + 1] == 2 * i for i in range(120) if not pairs[i]) <= 1
    assert {got[1000 + k] for k in range(100)} == {1000}
    before = {r.doc_id: r.component_id for r in near_duplicates(docs, words=5, bits=5).collect()}
    assert sum(before[2 * i + 1] != 2 * i for i in range(120) if pairs[i]) > 30


def test_the_query_equals_brute_force(spark):
    from tessera.llm.simhash import op2_simhash

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: plain(t, 3) for d, t in docs.items()}
    root = {d: d for d in docs}
    for x in sorted(docs):
        for y in sorted(docs):
            if x < y and bin(prints[x] ^ prints[y]).count("1") <= 2:
                low, high = sorted((root[x], root[y]))
                root = {d: low if r == high else r for d, r in root.items()}
    out = op2_simhash(spark, sf)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, out.collect())) == sorted((d, f"{prints[d]:016x}", root[d]) for d in docs)


def test_fingerprints_of_very_long_texts_are_counted_in_parts():
    text = " ".join(str(i * 7919 % 10007) for i in range(40_000))
    assert fingerprint(text.encode(), 3) == plain(text, 3)


@pytest.mark.parametrize("n", [100, 3000])
def test_families_whose_members_are_unlike_their_first(spark, n):
    """A chain of texts, each like its neighbours only: every link counts, however many there are."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words, rows = [word() for _ in range(150)], []
    for k in range(n):
        at = rng.randrange(0, 144)
        words[at : at + 4] = [word() for _ in range(4)]  # at most 8 of 146 shingles change: a similarity of 0.89 or more
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.component_id for r in near_duplicates(docs, words=5, bits=5, least=0.8).collect()]
    assert got == [0] * n


def test_no_table_that_grows_passes_through_the_driver(spark):
    """Joins are dealt by key even while their tables are small, and a sieve stands in no plan as a literal."""
    from pyspark.sql import functions as F

    from tessera.llm import chosenpath, simhash

    docs = spark.createDataFrame([(i, f"word{i % 3} and some more words here") for i in range(30)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.component_id for r in out.collect() if r.doc_id % 3 == 1} == {1}
    kept = chosenpath.sifted(docs, docs.filter("doc_id < 3"), "doc_id")
    assert {0, 1, 2} <= {r.doc_id for r in kept.collect()} and kept.columns == docs.columns and kept.count() < 10
    assert len(kept._jdf.queryExecution().toString()) < 20_000
    assert chosenpath.sifted(docs, docs.filter(F.lit(False)), "doc_id").count() == 0


@pytest.mark.parametrize("bits", [2, 5])
def test_the_index_of_variants_is_never_broadcast(spark, bits):
    """It has 64 rows a fingerprint, which Spark's estimate leaves out."""
    from tessera.llm.common import stored

    out = links(stored(spark.range(100).select(F.xxhash64("id").alias("fp"))), bits)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
