import random

import numpy as np

from tessera.llm.lyndon import suffix_arrays


def check(texts):
    codes = [[c + 1 for c in t] + [0] for t in texts]
    size = np.array([len(c) for c in codes])
    end = np.cumsum(size)
    got = suffix_arrays(np.array([x for c in codes for x in c], np.int64), end - size, end)
    for c, a, b in zip(codes, end - size, end):
        assert (got[a:b] - a).tolist() == sorted(range(len(c)), key=lambda i: c[i:]), c


def test_random_texts():
    rng = random.Random(1)
    for letters in (1, 2, 3, 5, 200):
        check([[rng.randrange(letters) for _ in range(rng.randrange(0, 40))] for _ in range(300)])


def test_runs_and_periods():
    check([[0] * 50, [1, 0] * 40, [0, 1] * 40, [2, 1, 0] * 20 + [2, 1], [0, 0, 1] * 30, list(range(60)), list(range(60))[::-1], [], [5]])
    word = [0, 1]
    for _ in range(6):  # Fibonacci words: many repeats
        word = word + word[: len(word) // 2 + 1]
    check([word, word[::-1], word * 2])
