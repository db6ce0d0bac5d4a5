import random

import numpy as np
import pytest

from tessera.llm import substrings as S


def brute(rows):
    first, out = {}, []
    place = lambda d: -(2**63) if d is None else d
    for d, text in sorted(rows, key=lambda r: place(r[0])):
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], place(d))
    for d, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < place(d):
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out, key=lambda r: (place(r[0]), r[1:]))


def texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for d in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passage)[rng.randrange(3) :])
        rows.append((d * 7 % 151, " ".join(parts)))
    base = rows[3][1]
    rows += [(200 + i, base[:i] + "X" + base[i:]) for i in range(0, len(base), 9)]
    return rows + [(900, None), (901, ""), (902, "a" * 400), (903, "a" * 300), (904, "ab" * 100), (905, "q" * 49), (906, "q" * 50), (907, "q" * 51), (300, base), (300, base + " twice"), (908, "é" * 60), (909, "né" * 60)]


def result(docs, *hot):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.without_repeats(docs, *hot).collect()]
    return sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1:]))


@pytest.mark.parametrize("hot, long_, tasks", [(5000, 1 << 16, 3), (3, 1 << 16, 12), (1, 1 << 16, 3), (5000, 200, 3), (2, 60, 5), (5000, S.LONG, 3)])
def test_equals_brute_force(spark, monkeypatch, hot, long_, tasks):
    """Also with keys that many tasks have, of which some documents are told by their own task."""
    rows = texts(random.Random(hot))
    monkeypatch.setattr(S, "LONG", long_)
    docs = spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, kept string").repartition(tasks)
    assert result(docs, hot) == brute(rows)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [S.HOT, 20])
def test_a_passage_in_a_third_of_the_documents(spark, hot):
    """At the production settings, with near copies of it, null and repeated doc_ids."""
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for d in range(600):
        text = " ".join(word() for _ in range(rng.randrange(5, 40)))
        if d % 3 == 0:
            at = rng.randrange(len(passage))
            text = text[: rng.randrange(20)] + (passage if d % 2 else passage[:at] + word() + passage[at:]) + text
        rows.append((None if d % 10 == 0 else d // 12 * 12 if d % 7 == 0 else d, text))
    rows += [(None, None), (None, passage), (5, passage), (5, passage), (-3, passage[:80])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot) == brute(rows)


def test_windows_of_long_texts_are_told_by_finer_keys_as_by_one_text():
    rng = np.random.default_rng(3)
    line = rng.integers(97, 103, 90).astype(np.uint8)
    parts, docs = [], []
    for d in range(400):
        text = line.copy()
        text[rng.integers(0, 90)] = 65 + d % 26
        a = rng.integers(0, 30)
        parts.append(text[a : a + rng.integers(50, 60)])
        docs.append(int(rng.integers(0, 1000)))
    size, data, doc = np.array([len(p) for p in parts]), np.concatenate(parts), np.array(docs)
    got = S.least_documents(np.full(400, 7, np.uint64), data, size, doc, limit=300)
    windows = [(p[i : i + 50].tobytes(), d) for p, d in zip(parts, docs) for i in range(len(p) - 49)]
    least = {}
    for w, d in windows:
        least[w] = min(d, least.get(w, d))
    assert got.tolist() == [least[w] for w, _ in windows]


def test_ids_below_the_range_are_an_error(spark):
    with pytest.raises(Exception, match="not supported"):
        S.without_repeats(spark.createDataFrame([(-(2**63), "a")], "doc_id long, text string")).collect()


def test_the_query_equals_brute_force(spark, tmp_path):
    import hashlib

    rows = texts(random.Random(77))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op1_substrings(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute(rows))
