import random

import numpy as np
import pytest

from tessera.llm import decontaminate as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        n, used = D.common_subsequence(a, b)
        assert n == plain_lcs(a, b) == sum(used)
        left = [x for x, u in zip(a, used) if u]
        it = iter(b)
        assert all(x in it for x in left)


def test_planted_items_are_found_and_nothing_else(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60)), "x") for i in range(30)] + [(98, None, "x"), (99, "", "x")]
    rows, planted = [], set()
    for d in range(200):
        body = text(rng.randrange(1, 400))
        if d % 5 == 0:
            k = rng.randrange(30)
            words = items[k][1].split()
            if d % 10 == 0:  # a paraphrase: every ninth word is another one
                words = [rng.choice(vocabulary) if i % 9 == 4 else w for i, w in enumerate(words)]
            parts = body.split()
            parts[len(parts) // 2 : len(parts) // 2] = [" ".join(words).upper() + ","]
            body = " ".join(parts)
            planted.add((d, k))
        rows.append((d, body, 1))
    rows += [(300, None, 1), (301, "", 1), (302, "the " * 50_000, 1)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id int, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == planted
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_an_item_in_a_third_of_the_documents_is_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item, other = (" ".join(word() for _ in range(25)) for _ in range(2))
    rows = []
    for d in range(150):
        words = [word() for _ in range(120)]
        words[60:60] = item.split() if d % 3 == 0 else []
        rows.append((d, " ".join(words)))
    found = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, other)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(d, 1) for d in range(0, 150, 3)]


def test_short_items_are_found_anywhere(spark, monkeypatch):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(4 + i % 9))) for i in range(600)]
    rows = []
    for d in range(300):
        words = [word() for _ in range(100)]
        at = rng.randrange(100)
        words[at:at] = items[2 * d][1].split()
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "WORDS", 1600)  # several spaces, more of them than one scan takes
    monkeypatch.setattr(D, "SPACES", 2)
    assert len(D.item_blocks(bench)) == 3
    found = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(d, 2 * d) for d in range(300)]


def brute_force(docs, items):
    """Every passage's surroundings of every document against every item, by plain dynamic programming."""
    out = set()
    words_of = lambda t: D.terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    for k, text in items:
        item, answer = words_of(text), D.answer_words(text)
        for d, body in docs:
            words = words_of(body)
            blocks = -(-len(words) // D.BLOCK)
            for b in range(max(1, blocks - 1)):
                region = words[max(0, b * D.BLOCK - len(item)) : (b + 2) * D.BLOCK + len(item)]
                if sum(x in set(region) for x in item) < D.SHARE_WITH_ANSWER * len(item):
                    continue
                n, used = D.common_subsequence(item, region)
                assert n == plain_lcs(item, region)
                if n >= D.SHARE * len(item) or (n >= D.SHARE_WITH_ANSWER * len(item) and sum(used[len(item) - answer :]) >= D.ANSWER_SHARE * answer):
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize("share", [0.1, 0.3, 0.9])
def test_a_frequent_item_is_found_as_brute_force_finds_it(spark, share):
    rng = random.Random(int(share * 10))
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    word = lambda: rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else rng.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(12 + 3 * i))) for i in range(10)]
    docs = []
    for d in range(80):
        words = [word() for _ in range(90)]
        if d < share * 80:
            at = rng.randrange(90)
            words[at:at] = [rng.choice(vocabulary) if rng.random() < 0.15 * (d % 3) else w for w in items[4][1].split()]
        if d % 10 == 0:
            words[30:30] = items[d // 10][1].split()
        docs.append((d, " ".join(words)))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    truth = brute_force(docs, items)
    assert len([1 for _, k in truth if k == 4]) >= share * 60
    assert {(r.doc_id, r.item_id) for r in found.collect()} == truth


def test_a_paraphrase_of_other_words_is_found_by_what_the_corpus_knows(spark, monkeypatch):
    """Rare words of an item are replaced by words that stand beside the same ones elsewhere; common words and answer stay."""
    monkeypatch.setattr(D, "RANK", 20)  # of 104 terms: about one a topic and one a common word
    rng = random.Random(5)
    common = ["the", "of", "and", "in", "to", "is", "on", "by"]
    topics = [["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(8)] for _ in range(12)]
    items, docs = [], []
    for k, topic in enumerate(topics):
        rare = topic[:4] * 3 if k % 2 == 0 else topic[4:] * 3
        items.append((k, " ".join(w for r in rare[:12] for w in (rng.choice(common), r)) + " ? " + " ".join(rng.choice(common) for _ in range(8))))
        items.append((100 + k, " ".join(topic)))  # so that all words of the topic have a column
    for d in range(600):
        topic = topics[d % 12]
        docs.append((d, " ".join(rng.choice(topic) if rng.random() < 0.5 else rng.choice(common) for _ in range(64))))
    k = 0
    swap = dict(zip(topics[k][:4], topics[k][4:]))
    paraphrase = " ".join(swap.get(w, w) for w in items[0][1].split())
    docs.append((1000, paraphrase))
    weight = D.weights(*D.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string")))

    def vector(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        h, counts = D.terms(raw, np.array([0, len(raw)]))
        squares, _, col, value = D.tf_idf(h, np.array([len(h)]), weight, np.arange(D.TERMS))
        return dict(zip(col.tolist(), (value / np.sqrt(squares[0])).tolist()))

    a, b = vector(items[0][1]), vector(paraphrase)
    assert sum(v * b.get(c, 0.0) for c, v in a.items()) < D.COSINE
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert (1000, 0) in {(r.doc_id, r.item_id) for r in found.collect()}


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = D.op5_decontaminate(spark, sf)
    assert out.columns == ["doc_id", "item_id", "item_words", "common_words"]
    assert {(r.doc_id, r.item_id) for r in out.collect()} == brute_force(docs, items)
