import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    net = T.Network(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = rng.standard_normal((9, 2 * T.WIDTH)), rng.integers(0, 9, (5, T.WINDOW))
    ids[0, 7:] = -1
    ids[1] = -1
    target, weight = np.array([1, 0, 1, 0, 1.0]), np.full(5, 0.2)

    def loss():
        z = net.run(net.gates(x), ids)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    g, d_x, _ = net.gradients(x, ids, target, weight)
    for name, grad, value in [*((k, g[k], net.p[k]) for k in g), ("x", d_x, x)]:
        flat, at = value.reshape(-1), rng.integers(0, value.size, 4)
        for i in at:
            old, e = flat[i], 1e-4
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad.reshape(-1)[i]) < 2e-3, name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        first, size, text = T.windows(np.array([n, 3]))
        mine = text == 0
        assert sorted({w for a, s in zip(first[mine], size[mine]) for w in range(a, a + s)}) == list(range(n)) and len(first) == mine.sum() + 1


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Grumbleface", "mockwit", "sneerzqu" + rng.choice(words)]))
        rows.append((i, " ".join(text), "clash"))
        labels.append((i, toxic))
    rows += [(900, None, None), (901, "", None), (902, "x " * 50_000, None), (902, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity_score string")
    net = T.fit(docs, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    got = T.scored(docs, net).withColumn("held", T.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity_score <= 1 for r in got)
    held = [(r.toxicity_score >= 0.5) == bool(labels[r.doc_id][1]) for r in got if r.held and r.doc_id < 500]
    assert sum(held) / len(held) > 0.9
    assert T.scored(docs.limit(0), T.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def slow_logit(net, x):
    """One window, word by word: two gated passes, attention over the states, the output."""
    p, sig = net.p, lambda v: 1 / (1 + np.exp(-v))
    states = []
    for d in "fb":
        h, out = np.zeros(T.H), [None] * len(x)
        for i in range(len(x)) if d == "f" else reversed(range(len(x))):
            a, b = x[i] @ p[f"Wx{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r = sig(a[: T.H] + b[: T.H]), sig(a[T.H : 2 * T.H] + b[T.H : 2 * T.H])
            h = z * h + (1 - z) * np.tanh(a[2 * T.H :] + r * b[2 * T.H :])
            out[i] = h
        states.append(out)
    both = [np.concatenate(s) for s in zip(*states)]
    raw = np.array([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in both])
    weight = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
    return sum(w * s for w, s in zip(weight, both)) @ p["w"] + p["c"][0]


def test_scores_are_the_highest_window_of_a_slow_forward_pass():
    rng = random.Random(6)
    net = T.Network(3)
    net.p = {k: v * (3 if k in ("word", "char") else 1) for k, v in net.p.items()}
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (1, 5, 31, 32, 33, 50, 90)]
    want = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        low, sums, start, end, _ = T.read_words(raw, np.array([0, len(raw)]))
        x = net.inputs(*T.features(low, start, end, sums)).astype(np.float64)
        begins = sorted({min(k, max(len(x) - T.WINDOW, 0)) for k in range(0, max(len(x) - T.WINDOW, 0) + T.STRIDE, T.STRIDE)})
        want.append(1 / (1 + np.exp(-max(slow_logit(net, x[b : b + T.WINDOW]) for b in begins))))
    joined = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = T.Scorer(net.p).score(np.frombuffer(joined, np.uint8), offsets)
    assert np.abs(got - np.array(want)).max() < 1e-4


def test_the_query_marks_the_labelled_documents(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    out = T.op10_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == docs and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [rows[d].predicted == y for d, y in labels if d in rows and rows[d].held_out]
    assert sum(held) / len(held) > 0.9


def test_a_repeated_id_trains_the_same_network_each_time(spark):
    rows = [(i % 30, f"word{i} other text {i % 2}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    nets = [T.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
