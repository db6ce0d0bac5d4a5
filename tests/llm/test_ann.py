import numpy as np
import pytest

from tessera.llm import ann


def brute(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x[i] * x).sum(1)
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[j], ids[j]))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("n, block", [(3000, 4096), (3000, 64), (15, 4096), (1, 4096)])
def test_recall_and_exact_scores(spark, monkeypatch, n, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((20, 16))
    x = (centre[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, 16))) * rng.uniform(0.5, 2, (n, 1))
    x[: n // 3] = x[0]  # a third of all vectors are one
    x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(100_000, None, "x"), (100_020, [0.0] * 16, "x"), (100_040, [float("nan")] * 16, "x"), (100_060, [float("inf")] + [1.0] * 15, "x"), (100_080, [None] * 16, "x"), (100_100, [1.0, 2.0], "x"), (None, [1.0] * 16, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df, k=20, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(n), x, 20, 20)
    if n == 1:
        assert got == {}
        return
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= (0.9 if n > 100 else 1)
    assert all(abs(s - (x[q] * x[v]).sum()) < 1e-9 for q in got for v, s in got[q])
    assert all(p == sorted(p, key=lambda t: (-t[1], t[0])) for p in got.values())


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_of_a_repeated_id_are_rows_and_huge_norms_keep_their_order(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.standard_normal((40, 8)), rng.standard_normal((60, 8)) * 1e8))
    ids = np.arange(100)
    ids[[1, 2, 41]] = [20, 20, 0]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in set(ids[ids % 20 == 0].tolist()):
        want = []
        for i in np.flatnonzero(ids == q):
            score = (x[i] * x).sum(1)
            order = sorted((j for j in range(100) if j != i), key=lambda j: (-score[j], ids[j]))[:20]
            want += [(n + 1, int(ids[j])) for n, j in enumerate(order)]
        assert sorted((n, v) for n, v, _ in got[q]) == sorted(want)


def test_the_query_finds_the_nearest(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    out = ann.op7_ann(spark, "/root/testdata/sf0.01")
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    where = {i: k for k, i in enumerate(ids.tolist())}
    assert all(s == (x[where[q]] * x[where[v]]).sum() for q in got for v, s in got[q])
