import random
import re

import numpy as np
import pytest

from tessera.llm import chosenpath


def shingles(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} or ({" ".join(tokens)} if tokens else set())


def brute(rows, least=80):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            same = len(s & sets[j])
            if 100 * same >= least * (len(s) + len(sets[j]) - same):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, id int")
    out = chosenpath.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def changed(rng, words, share):
    """A copy whose similarity is just above `share`, by words replaced one at a time."""
    base, out = shingles(" ".join(words)), list(words)
    while True:
        trial = list(out)
        trial[rng.randrange(len(trial))] = word(rng)
        other = shingles(" ".join(trial))
        if len(base & other) < share * len(base | other):
            return out
        out = trial


def test_sets_and_edges(spark):
    rows = [(5, "a b c d e"), (3, "A b\tc  d\ne"), (9, None), (8, ""), (10, " \n"), (7, "One two"), (2, "one TWO"), (11, "É a\x1cb c\x0bd"), (11, "É a\x1cb c d"), (None, "a b c d e"), (None, "lonely"), (12, "x y z w " * 3000 + "end"), (13, "x y z w " * 2999 + "END"), (-4, "q " * 50)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_pairs_near_the_threshold(spark):
    rng, rows = random.Random(3), []
    for i in range(160):
        words = [word(rng) for _ in range(rng.randrange(20, 400))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(rng, words, (0.8, 0.85, 0.95, 0.7)[i % 4])))]
    got, want = run(spark, rows), brute(rows)
    assert got == want and sum(not r[3] for r in want) >= 120


@pytest.mark.parametrize("n, share", [(100, 0.9), (100, 0.8), (1500, 0.85)])
def test_families(spark, n, share):
    """Many near copies of one text, most of them less like each other than like it; some only reachable through others."""
    rng = random.Random(n)
    base = [word(rng) for _ in range(150)]
    texts = [changed(rng, base, share) for _ in range(n)]
    texts += [changed(rng, rng.choice(texts), 0.82) for _ in range(n // 10)]
    notice = " ".join(word(rng) for _ in range(60))  # a passage that many documents share
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000 + i, notice + " " + " ".join(word(rng) for _ in range(rng.randrange(10, 90)))) for i in range(n)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nodes_that_branch(spark, monkeypatch):
    """With nodes compared exhaustively only up to a few members, the trees do the work; the links found are the same."""
    monkeypatch.setattr(chosenpath, "SMALL", 12)
    rng = random.Random(5)
    base = [word(rng) for _ in range(120)]
    kin = [changed(rng, base, 0.6) for _ in range(40)]
    texts = [changed(rng, t, 0.8) for t in kin for _ in range(3)] + kin
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_minwise_tokens_estimate_the_similarity():
    rng = random.Random(1)
    words = [word(rng) for _ in range(500)]
    texts = [" ".join(words), " ".join(changed(rng, words, 0.8)), "", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    hashes, at = chosenpath.shingle_sets(data, offsets, 4)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    tokens = chosenpath.minwise(hashes, at)
    assert abs((tokens[0] == tokens[1]).mean() - 0.8) < 0.15 and (tokens[0] == tokens[3]).sum() < 3


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = chosenpath.op11_chosen_path(spark, sf)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
