import random

import numpy as np

from tessera.llm import lines as L


def cut(text):
    data = text.encode()
    start, end, hashes, counts = L.pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [data[a:b].decode() for a, b in zip(start, end)]


def test_pieces():
    assert cut("One two. Three\nfour! " + "w " * 20) == ["One two.", "Three", "four!", " ".join("w" * 16), "w w w w"]
    assert cut("") == [] and cut(" \n ") == []


def brute(docs):
    """Every run of RUN + WINDOW - 1 pieces that stands earlier goes; nothing goes that is not in an earlier run of RUN."""
    seen3, seen4, must, may = set(), set(), {}, {}
    for d, text in docs:
        p = [" ".join(x.split()) for x in cut(text)]
        must[d], may[d] = set(), set()
        for i in range(len(p)):
            for n, seen, out in ((3, seen3, may), (4, seen4, must)):
                if i + n <= len(p):
                    key = tuple(p[i : i + n])
                    if key in seen:
                        out[d] |= set(range(i, i + n))
                    seen.add(key)
    return must, may


def test_runs_between_brute_force_bounds(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(2, 7))) + rng.choice([".", ".\n", "\n", "!"])
    passages = [[sentence() for _ in range(6)] for _ in range(5)]
    docs = []
    for d in range(60):
        parts = [sentence() for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.7:
            parts[1:1] = rng.choice(passages)
        docs.append((d, " ".join(parts)))
    out = {r.doc_id: r for r in L.without_repeats(spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_removed_pieces int")).collect()}
    must, may = brute(docs)
    for d, text in docs:
        p = cut(text)
        keep_least, keep_most = len(p) - len(may[d]), len(p) - len(must[d])
        assert keep_least <= len(p) - out[d].n_removed_pieces <= keep_most, d
        if not may[d]:
            assert out[d].text == text
    assert sum(r.n_removed_pieces for r in out.values()) > 100


def test_edges(spark):
    same = "a b c. d e f. g h i. j k l. m n o."
    rows = [(1, same), (1, same), (2, None), (3, ""), (4, "x. " * 50), (None, same), (5, "   "), (6, "x " * 100_000)]
    out = L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r.doc_id or -1, r.text or "", r.n_removed_pieces) for r in out)
    assert len(out) == 8 and texts[0] == (-1, same, 0) and [t[1] for t in texts if t[0] == 1] == ["", ""]
    assert L.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_spliced_in_mid_sentence_go(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passages = [words(60) for _ in range(50)]
    docs = [(i + 50 * late, " ".join(words(rng.randrange(5, 40)) + passages[i] + words(rng.randrange(5, 40)))) for late in (0, 1) for i in range(50)]
    out = {r.doc_id: r for r in L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed_pieces == 0 for i in range(50))
    assert all(out[i].n_removed_pieces >= 3 for i in range(50, 100))
    gone = [len(t.split()) - len(out[d].text.split()) for d, t in docs[50:]]
    assert max(gone) <= 60 and sum(gone) > 50 * 36


def test_matches_are_extended_against_the_place_that_has_the_same_neighbours(spark):
    rng = random.Random(7)
    sentences = lambda n: [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4)) + "." for _ in range(n)]
    docs = []
    for i in range(40):
        run, head, tail = sentences(4), sentences(1), sentences(1)
        first = head + run[1:] if i % 2 else run[:-1] + tail  # shares only three of the four
        docs += [(i, " ".join(first)), (100 + i, " ".join(run)), (200 + i, " ".join(sentences(2) + run + sentences(2)))]
    out = {r.doc_id: r.n_removed_pieces for r in L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in range(40)) and [out[200 + i] for i in range(40)] == [4] * 40


def test_a_passage_in_a_third_of_the_documents_goes_but_from_the_first(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = words(60)
    docs = [(d, " ".join(words(20) + (passage if d % 3 == 1 else []) + words(20))) for d in range(300)] + [(None, " ".join(words(50)))]
    out = {r.doc_id: r for r in L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert all((r.n_removed_pieces > 0) == (d is not None and d % 3 == 1 and d > 1) for d, r in out.items())
    assert all(out[d].text == t for d, t in docs if out[d].n_removed_pieces == 0)


def test_the_query_digests_what_is_left(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: (r.n_removed_pieces, (r.text or "").encode()) for r in L.without_repeats(docs).collect()}
    must, may = brute([(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()])
    rows = L.op6_line_dedup(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(left) and sum(r.n_removed_pieces for r in rows) > 0
    for r in rows:
        n, raw = left[r.doc_id]
        assert (r.n_removed_pieces, r.n_bytes, r.kept_sha256) == (n, len(raw), hashlib.sha256(raw).hexdigest())
        assert len(must[r.doc_id]) <= n <= len(may[r.doc_id])
