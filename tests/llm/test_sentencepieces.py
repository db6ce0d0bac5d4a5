import itertools
import random

import numpy as np
import sentencepiece

from tessera.llm.sentencepieces import BPE, UNIGRAM, UNKNOWN, Viterbi, codec, decoded, encoded, model_path


def test_random_texts_encode_like_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    c = codec(model_path())
    rng = random.Random(8)
    bits = ["the", "ing", "tion", "er", "  ", " ", "\n", "\t", "é", "ß", "漢字", "🙂", ".", ",", "!!", "</s>", "<0x0A>", "A", "THE", "123", "aaaa", "        ", "ciónrauedo", "'", "0", "http://"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(3000)] + ["", " ", "a" * 300, "ab" * 200, " " * 100]
    ids, counts = c.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == sp.encode(text), repr(text)
    assert c.decode(ids, counts) == texts


def test_unigram_paths_equal_brute_force():
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {"a", "b"})
    score = [-rng.random() * 9 for _ in pieces]
    v = Viterbi({p: i for i, p in enumerate(pieces)}, score, UNIGRAM)
    for word in map("".join, itertools.product("abcd", repeat=6)):
        def best(t):
            if not t:
                return 0.0
            tries = [score[v.ids[t[:n]]] + best(t[n:]) for n in range(1, 5) if t[:n] in v.ids]
            return max(tries + ([v.bad + best(t[1:])] if t[:1] not in v.ids else []))

        if rng.random() < 0.1:
            got = sum(v.bad if t >= UNKNOWN else score[t] for t in v.segment([word])[0])
            assert abs(got - best(word)) < 1e-9


def test_merges_out_of_order_equal_the_greedy_merges():
    rng = random.Random(10)
    for _ in range(20):
        pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(20)} | {"a", "b"})
        order = list(range(len(pieces)))
        rng.shuffle(order)
        v = Viterbi({p: i for i, p in enumerate(pieces)}, [-float(x) for x in order], BPE)
        words = ["".join(rng.choice("abz") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
        for w, tokens in zip(words, v.segment(words)):
            assert [v.piece_text(t) for t in tokens] == v.merged(w) == [v.piece_text(t) for t in v.one_word(w)]


def test_edges(spark):
    rows = [(1, "Hello  world\n", 5), (2, None, 6), (3, "", 7), (1, "Hello  world\n", 5), (4, "word " * 60_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int")
    out = decoded(encoded(docs, model_path()), model_path()).collect()
    assert len(out) == 5 and all(r.decoded == (r.text or "") for r in out)
    assert decoded(encoded(docs.limit(0), model_path()), model_path()).count() == 0


def test_a_long_unbroken_word_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    c = codec(model_path())
    texts = ["=" * 32_000, "ab" * 3_000 + "=-" * 500]
    ids, counts = c.encode(texts)
    assert ids[: counts[0]].tolist() == sp.encode(texts[0]) and ids[counts[0] :].tolist() == sp.encode(texts[1])


def test_the_query_gives_the_librarys_ids(spark):
    from tessera.llm.sentencepieces import op3_sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_pieces for r in rows} == {d: len(sp.encode(t)) for d, t in docs.items()} and all(r.round_trip for r in rows)
