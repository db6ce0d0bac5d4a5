"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, lean, mix, prefix_sums, ranges, slices, span_hashes, table, utf8, word_spans

#: Words of a window and between starts of windows; width of the state; buckets and width of either embedding.
WINDOW, STRIDE, H = 32, 16, 8
BUCKETS, WIDTH = 1 << 15, 12
NGRAMS = (3, 4, 5)
#: At most so many labelled rows of each class train the network; steps, documents a step.
SAMPLE, STEPS, BATCH = 1500, 500, 48
KEEP = np.float32(30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its bucket, the buckets of its character n-grams one after another (ends marked), and where they begin."""
    word = (span_hashes(sums, start, end) % np.uint64(BUCKETS)).astype(np.int64)
    parts, owner = [], []
    length = end - start
    for n in NGRAMS:
        # n-grams of the word with a mark at either end: those that start at the mark are n-1 characters long
        count = np.maximum(length - n + 1, 0)
        total = int(count.sum())
        who = np.repeat(np.arange(len(start)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + start[who]
        parts.append(span_hashes(sums, at, at + n) + np.uint64(n))
        owner.append(who)
        has = np.flatnonzero(length >= n - 1)
        for a, b, salt in ((start[has], start[has] + n - 1, 101), (end[has] - n + 1, end[has], 202)):
            parts.append(mix(span_hashes(sums, a, b) + np.uint64(salt + n)))
            owner.append(has)
    owner.append(np.arange(len(start)))  # the whole word: no word is without a character input
    parts.append(span_hashes(sums, start, end) ^ np.uint64(0x5BD1E995))
    every, order = np.concatenate(owner), None
    order = np.argsort(every, kind="stable")
    grams = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return word, grams, np.searchsorted(every[order], np.arange(len(start)))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words each: the first word of every window, its words, its text. The last window ends with the text."""
    n = np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return first[text] + begin, np.minimum(counts[text], WINDOW), text


def sums_by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number; rows under 0 don't count."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(row, kind="stable")
    order = order[np.searchsorted(row[order], 0) :]
    if len(order):
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        out[row[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters p: embeddings of words and characters; per direction Wx, b, U; attention A, a, v; output w, c."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": f(BUCKETS, WIDTH, scale=0.1), "char": f(BUCKETS, WIDTH, scale=0.1), "A": f(2 * H, H), "a": np.zeros(H, np.float32), "v": f(H), "w": f(2 * H), "c": np.float32([-1.0])}
        for d in "fb":
            self.p |= {f"Wx{d}": f(2 * WIDTH, 3 * H), f"b{d}": np.zeros(3 * H, np.float32), f"U{d}": f(H, 3 * H)}

    def inputs(self, word: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each word: its embedding and the sum of its n-grams' embeddings over the root of their number."""
        if not len(word):
            return np.zeros((0, 2 * WIDTH), np.float32)
        size = np.diff(np.append(at, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], at, axis=0) / np.sqrt(size)[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][word], chars), axis=1)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Input parts of the gates, forward and backward, with a last row for padding, whose update gate keeps the state."""
        pad = np.zeros((1, 3 * H), np.float32)
        pad[0, :H] = KEEP
        return [np.concatenate((x @ self.p[f"Wx{d}"] + self.p[f"b{d}"], pad)) for d in "fb"]

    def run(self, gates: list[np.ndarray], ids: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows: ids (windows x WINDOW) of rows of gates, padding -1."""
        n, t = ids.shape
        states = np.empty((t, n, 2 * H), np.float32)
        for d, g, order in (("f", gates[0], range(t)), ("b", gates[1], range(t - 1, -1, -1))):
            h, u, at = np.zeros((n, H), np.float32), self.p[f"U{d}"], slice(0, H) if d == "f" else slice(H, 2 * H)
            for i in order:
                x, hu = g[ids[:, i]], h @ u
                zr = sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
                if tape is not None:
                    tape.append((d, i, h, z, r, new, hu[:, 2 * H :]))
                h = new + z * (h - new)
                states[i, :, at] = h
        seen = np.tanh(states @ self.p["A"] + self.p["a"])
        raw = seen @ self.p["v"]
        raw[(ids < 0).T] = -30
        weight = np.exp(raw - raw.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if tape is not None:
            tape.append((states, seen, weight, pooled))
        return pooled @ self.p["w"] + self.p["c"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the weighted cross entropy: of the dense parameters, of x, and the logits."""
        gates, tape = self.gates(x), []
        logit = self.run(gates, ids, tape)
        states, seen, att, pooled = tape.pop()
        p, t = self.p, ids.shape[1]
        d_logit = ((sigmoid(logit) - target) * weight).astype(np.float32)
        g = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["w"]
        d_att = np.einsum("nh,tnh->tn", d_pooled, states)
        d_raw = att * (d_att - (att * d_att).sum(axis=0))
        d_raw[(ids < 0).T] = 0
        g["v"] = np.einsum("tn,tnh->h", d_raw, seen)
        d_pre = d_raw[:, :, None] * p["v"] * (1 - seen**2)
        g["A"], g["a"] = np.einsum("tni,tnj->ij", states, d_pre), d_pre.sum(axis=(0, 1))
        d_states = att[:, :, None] * d_pooled + d_pre @ p["A"].T
        d_x = np.zeros((len(x), 2 * WIDTH), np.float32)
        for d in "bf":
            part, u = slice(0, H) if d == "f" else slice(H, 2 * H), p[f"U{d}"]
            carry, g_u, d_steps = np.zeros((ids.shape[0], H), np.float32), np.zeros_like(u), np.empty((t, len(ids), 3 * H), np.float32)
            for _ in range(t):
                _, i, h, z, r, new, hu = tape.pop()
                dh = carry + d_states[i, :, part]
                dz, dn = dh * (h - new) * z * (1 - z), dh * (1 - z) * (1 - new**2)
                dr = dn * hu * r * (1 - r)
                d_g, d_hu = np.concatenate((dz, dr, dn), axis=1), np.concatenate((dz, dr, dn * r), axis=1)
                g_u += h.T @ d_hu
                carry = dh * z + d_hu @ u.T
                d_steps[i] = d_g
            d_gates = sums_by_row(ids.T.ravel(), d_steps.reshape(-1, 3 * H), len(x))
            g[f"U{d}"], g[f"b{d}"], g[f"Wx{d}"] = g_u, d_gates.sum(axis=0), x.T @ d_gates
            d_x += d_gates @ p[f"Wx{d}"].T
        return g, d_x, logit

    def step(self, grads: dict, rate: float) -> None:
        """Adam; the embeddings are moved only where their gradient is not zero."""
        if not hasattr(self, "moments"):
            self.moments, self.turn = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        self.turn += 1
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.moments[k]
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g * g
            self.p[k][rows] -= rate * (m[rows] / (1 - 0.9**self.turn)) / (np.sqrt(v[rows] / (1 - 0.99**self.turn)) + 1e-6)


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, their prefix sums, the words' starts and ends, and each text's number of words."""
    low = LOWER[data]
    start, end, counts = word_spans(low, offsets)
    return low, prefix_sums(low), start, end, counts


def window_ids(word_ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = first[:, None] + np.arange(WINDOW)
    return np.where(np.arange(WINDOW) < size[:, None], np.append(word_ids, 0)[np.minimum(at, len(word_ids))], -1)


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Network:
    """Multiple-instance training: a document's label is that of its highest window; a second window drawn at random of the clean ones."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        net.p["w"][:] = 0
        net.p["c"][0] = -3 if not len(texts) or labels.max() == 0 else 3
        return net
    # Every distinct word of the sample once: its features, and each document's words as numbers of them.
    index: dict[int, int] = {}
    docs, made = [], []
    for text in texts:
        low, sums, start, end, _ = read_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        keys, first, inverse = np.unique(span_hashes(sums, start, end), return_index=True, return_inverse=True)
        new = [i for i, k in enumerate(keys.tolist()) if k not in index]
        if new:
            made.append(features(low, start[first[new]], end[first[new]], sums))
            index.update(zip(keys[new].tolist(), range(len(index), len(index) + len(new))))
        docs.append(np.array([index[k] for k in keys.tolist()], np.int64)[inverse] if len(keys) else np.zeros(0, np.int64))
    word, grams = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    size_of = np.concatenate([np.diff(np.append(m[2], len(m[1]))) for m in made])
    at = np.cumsum(size_of) - size_of

    pools = [np.flatnonzero(labels == y) for y in (0, 1)]
    for turn in range(steps):
        chosen = np.concatenate([rng.choice(pool, BATCH // 2) for pool in pools])
        counts = np.array([len(docs[i]) for i in chosen])
        used, spots = np.unique(np.concatenate([docs[i] for i in chosen]), return_inverse=True)
        x = net.inputs(word[used], grams[ranges(at[used], size_of[used])], np.cumsum(size_of[used]) - size_of[used])
        first, size, text = windows(counts)
        ids = window_ids(spots, first, size)
        logit = net.run(net.gates(x), ids)
        order = np.lexsort((-logit - (rng.random(len(logit)) * 2 if turn < steps // 5 else 0), text))
        top = order[np.searchsorted(text[order], np.arange(len(chosen)))]
        some = rng.integers(0, len(text), BATCH // 2)
        pick = np.concatenate((top, some[labels[chosen[text[some]]] == 0]))
        near, spots = np.unique(ids[pick], return_inverse=True)
        spots = spots.reshape(ids[pick].shape) - int(near[0] < 0)
        near = near[near >= 0]
        g, d_x, _ = net.gradients(x[near], spots, labels[chosen[text[pick]]].astype(np.float32), np.full(len(pick), 1 / BATCH, np.float32))
        own = used[near]
        rows = np.repeat(np.arange(len(own)), size_of[own])
        for name, keys, grad in (("word", word[own], d_x[:, :WIDTH]), ("char", grams[ranges(at[own], size_of[own])], (d_x[:, WIDTH:] / np.sqrt(size_of[own])[:, None])[rows])):
            unique, inverse = np.unique(keys, return_inverse=True)
            g[name] = (unique, sums_by_row(inverse, grad, len(unique)))
        net.step(g, 0.02 if turn < steps * 3 // 5 else 0.005)
    return net


class Scorer:
    """A network at work: remembers the gates' input parts of up to `most` words by their hashes."""

    def __init__(self, params: dict, most: int = 150_000):
        self.net, self.most = Network(), most
        self.net.p = params
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, 6 * H), np.float32)

    def word_rows(self, low, sums, start, end) -> np.ndarray:
        unique, index, inverse = np.unique(span_hashes(sums, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == unique[old]
        if not old.all():
            new = ~old
            made = np.concatenate([g[:-1] for g in self.net.gates(self.net.inputs(*features(low, start[index[new]], end[index[new]], sums)))], axis=1)
            if len(self.keys) + len(made) > self.most:
                self.clear()
                if not new.all():
                    return self.word_rows(low, sums, start, end)
            keys = np.concatenate((self.keys, unique[new]))
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], np.concatenate((self.rows, made))[order]
            at = np.searchsorted(self.keys, unique)
        return at[inverse]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window's probability of each text, over all overlapping windows; an empty text has one empty window."""
        low, sums, start, end, counts = read_words(data, offsets)
        word = self.word_rows(low, sums, start, end) if len(start) else np.zeros(0, np.int64)
        pad = np.zeros((1, 3 * H), np.float32)
        pad[0, :H] = KEEP
        gates = [np.concatenate((part, pad)) for part in (self.rows[:, : 3 * H], self.rows[:, 3 * H :])]
        first, size, text = windows(counts)
        logits = np.concatenate([self.net.run(gates, window_ids(word, first[a : a + 4096], size[a : a + 4096])) for a in range(0, len(first), 4096)])
        return sigmoid(np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(text, np.arange(len(counts)))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    """Train on a bounded sample: at most `most` labelled rows of each class, by a hash of doc_id, without the held-out fifth.

    Of a repeated doc_id the least text counts, and the label is the largest; null doc_ids and other labels are left out.
    """
    named = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [named.filter(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return train([(r.text or "").encode() for r in rows], np.array([r.toxic for r in rows], np.int64))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """docs with a column toxicity_score (replaced if it is there already), over whole texts, one row for each input row.

    Null and empty texts get the empty window's score; equal texts get equal scores, whatever their doc_id; a very long
    text is many windows, 4096 at a time; an empty table gives an empty one; other columns are kept.
    """
    params = docs.sparkSession.sparkContext.broadcast({k: v for k, v in net.p.items()})
    columns = [c for c in docs.columns if c != "toxicity_score"]
    held = docs.select(*columns, F.lit(0.0).alias("toxicity_score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(params.value)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            out = [scorer.score(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at, 1 << 20)]
            values = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], values], schema=batch.schema)

    return held.mapInArrow(lean(run), held.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
