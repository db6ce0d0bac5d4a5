import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import manifest

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf int, pos long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """The contract, level by level, over Python lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(field(r[0]), field(r[1]), field(r[2]), field(r[3]), field(text))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def trail(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 8 * 8
            out.append((level[run:i], level[i + 1 : run + 8]))
            i //= 8
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = tree([leaf(r, r[4]) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = trail(trees[g], i) + trail(top, k)
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] if not struck or r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            h = leaf(r, text)
            for a, b in steps:
                h = H(*a, h, *b)
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], H(*(x for a, b in steps for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 700])
def test_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 - 50, rng.choice(["a", "é", None]), rng.choice(["en"] * 6 + ["de", "", None, "ÿ", *"abcdefghij"]), rng.choice([None, i]), rng.choice(["Some Text É ", "", None, "low"]) , "x", 1, 2) for i in range(n)]
    if n > 9:
        rows += [rows[5]] * 3 + [(7, "a", "en", i, f"T{i}", "x", 1, 2) for i in range(30)] + [(None, "a", "en", 1, "Null", "x", 1, 2), (None, None, None, None, None, None, None, None), (2**62, "a", "one", 5, "Long Text " * 100_000, "x", 1, 2)]
        rng.shuffle(rows)
    got = manifest.manifest(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    if n > 9:
        assert {r.verified for r in got} == {True, False}


def test_several_walks(spark):
    """Blocks of one level, so that walks are many."""
    rows = [(i, "s", "en" if i % 3 else f"l{i % 40}", i, f"Text {i}", None, None, None) for i in range(1200)]
    assert sorted((tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, SHAPE), levels=1).collect()), key=repr) == plain(rows)


def test_the_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(manifest.OP13_SQL)
    got = manifest.op13_merkle(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
