import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import quantize

BAD = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] + [0.0] * 7, 2)]


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract over Python integers. rows: (vec_id, vector, label) with vectors of one length that parts divides."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    whole = [[math.floor(Fraction(v) * 4096) for v in r[1]] for r in kept]
    w = len(whole[0]) // parts if whole else 0
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x[p], books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(choose(x, p), []).append(x[p])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))])
        books = new
    out = []
    for r, x in zip(kept, cut):
        which = [choose(x, p) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for e in which), sum(far(x[p], books[p][e]) for p, e in enumerate(which)), r[2]))
    return sorted(out, key=repr), ",".join(str(v) for book in books for entry in book for v in entry)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    out, books = quantize.compressed(df.withColumn("code", df.label).withColumn("error", df.label))
    return sorted(((r.vec_id, r.code, r.error, r.label) for r in out.collect()), key=repr), ",".join(map(str, books.ravel().tolist()))


@pytest.mark.parametrize("n, width, spread", [(400, 16, 1.0), (400, 24, 30.0), (300, 16, 0.002), (9, 8, 1.0), (1, 8, 1.0)])
def test_equals_exact_integers(spark, n, width, spread):
    rng = np.random.default_rng(n + width)
    x = (rng.standard_normal((n, width)) * spread + rng.integers(-3, 4, (n, 1))).astype(np.float32)
    x[n // 2 :: 3] = x[0]  # ties and repeated rows
    rows = [(int(i), v.tolist(), int(i % 4) if i % 7 else None) for i, v in zip(rng.permutation(n), x)] + [(None, x[0].tolist(), 3), (5, x[-1].tolist(), 1)]
    rows += [(i, (v * (width // 8)) if v else v, b) for i, v, b in BAD]
    got, want = run(spark, rows), plain(rows)
    assert got == want


def test_components_of_any_size(spark):
    rows = [(i, [float(10.0 ** (i % 40 - 2)) * (-1) ** (i // 3)] * 8, 0) for i in range(60)] + [(100 + i, [0.001 * i] * 8, 0) for i in range(50)]
    got, want = run(spark, rows, "double"), plain(rows)
    assert got[1] == want[1]
    assert got[0] == [(a, b, c if c < 2**63 else None, d) for a, b, c, d in want[0]]
    rows = [(1, [1e308] * 8, 0), (2, [-1e308] * 8, 0), (3, [1.0] * 8, 0)]
    assert run(spark, rows, "double")[1] == plain(rows)[1]


def test_screening_never_decides_what_it_cannot():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 2**20, 2**27):
        x = rng.integers(-scale, scale + 1, (3000, 8))
        c = x[:16] + rng.integers(-1, 2, (16, 8))
        c[5], c[9] = c[3], c[3]
        x[100:] = c[rng.integers(0, 16, 2900)] + rng.integers(-2, 3, (2900, 8))
        d = ((x[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(2)
        choice, distance = quantize.nearest(x, c)
        assert choice.tolist() == [min(range(16), key=lambda e: (r[e], e)) for r in d.tolist()]
        assert distance.tolist() == d[np.arange(len(x)), choice].tolist()


def test_empty_and_other_lengths(spark):
    assert run(spark, []) == ([], "")
    assert run(spark, BAD)[0] == []
    mixed = [(i, [float(i), 1.0, 2.0][: i % 4], 0) for i in range(30)]
    filled = [(i, (v + [0.0] * 8)[:8], b) for i, v, b in mixed]
    assert run(spark, mixed)[0] == plain(filled)[0]


def test_the_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(quantize.OP12_SQL)
    got = quantize.op12_vector_codes(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {len(r.codebooks_sha256) for r in got.collect()} == {len(hashlib.sha256(b"").hexdigest())}
