"""Benchmark decontamination: latent semantic retrieval of passages, then longest-common-subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, lean, partitions, prefix_sums, ranges, slices, span_hashes, stored, table, utf8, word_spans

#: Hashed terms; words of a block (a passage is two neighbouring blocks); rank of a latent space and further columns of its
#: sketch; least cosine of a candidate, where the shorter of the two vectors counts for both lengths: a short item is not
#: held against the foreign words of its window; rows that are multiplied at once.
TERMS, BLOCK, RANK, EXTRA, COSINE, TILE = 1 << 18, 16, 256, 16, 0.35, 128
#: A latent space is made for items of at most WORDS words (or one longer item), and so many are searched in one scan of
#: the documents. Partial sums of the corpus are one a task, of so many tasks at most for each core.
WORDS, SPACES, TASKS_A_CORE = 1 << 14, 4, 4
#: A document leaks an item if this share of its words is a common subsequence, or a lower one with the answer in it.
#: The answer is what follows the last question mark, or else the last ANSWER words.
SHARE, SHARE_WITH_ANSWER, ANSWER_SHARE, ANSWER = 0.7, 0.5, 0.8, 8


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 texts, lower-cased in ASCII and Latin-1, and each text's number of words."""
    low = LOWER[data]
    # In UTF-8 the capitals of Latin-1 are byte C3 and then 80 to 9E (97 is a sign).
    low[1:] += 32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8)
    start, end, counts = word_spans(low, offsets)
    return span_hashes(prefix_sums(low), start, end), counts


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each block of BLOCK words; the last one of a text may be shorter."""
    n = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), n)
    k = ranges(np.zeros(len(n), np.int64), n)
    return (np.cumsum(counts) - counts)[text] + k * BLOCK, np.minimum(counts[text] - k * BLOCK, BLOCK), text


def passages(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last block of each passage: two neighbouring blocks of a text, or its only one. Any BLOCK + 1 words in a row are in one."""
    n = len(text)
    fresh = np.diff(text, prepend=-1) != 0
    last = np.append(fresh[1:], True)[:n]
    first = np.flatnonzero(~last | fresh)
    return first, np.where(last[first], first, first + 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each hashed term (TERMS numbers), and how many documents there are."""
    width = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, 1 << 20):
                h, counts = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pairs = np.sort(np.repeat(np.arange(b - a), counts) * TERMS + bucket(h))
                if len(pairs):
                    total += np.bincount(pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] % TERMS, minlength=TERMS)
            n += len(batch)
        parts = np.concatenate((total, [n], np.zeros(width - 1, np.int64))).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "sums"])

    schema = "part long, sums binary"
    sums = docs.select("text").mapInArrow(lean(count), schema).repartition(min(partitions(docs.sparkSession), TERMS // width), "part").mapInArrow(add, schema)
    rows = sorted((r.part, np.frombuffer(r.sums, np.int64)) for r in sums.collect())  # TERMS numbers, whatever the input
    every = np.concatenate([v for _, v in rows]) if rows else np.zeros(TERMS + 1, np.int64)
    return every[:TERMS], int(every[TERMS])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, 1 at least: a leak that is in most documents makes its own terms common, and they still find it."""
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def tf_idf(h: np.ndarray, size: np.ndarray, weight: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks' squared lengths, and the entries (block, column, value) of terms that have a column. The weight of a term is root(tf) idf."""
    b = bucket(h)
    owner = np.repeat(np.arange(len(size)), size)
    squares = np.bincount(owner, weight[b].astype(np.float64) ** 2, len(size))
    hit = np.flatnonzero(column[b] >= 0)
    unique, tf = np.unique(owner[hit] * TERMS + b[hit], return_counts=True)
    term = unique % TERMS
    return squares, unique // TERMS, column[term], np.sqrt(tf).astype(np.float32) * weight[term]


def tiles(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A sparse matrix of n rows, by its entries in order of rows, as dense tiles of TILE rows: the rows, the columns that occur in them, the tile."""
    upto = np.searchsorted(row, np.arange(0, n + TILE, TILE))
    for k, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
        if a < b:
            rows = slice(k * TILE, min((k + 1) * TILE, n))
            known, at = np.unique(col[a:b], return_inverse=True)
            dense = np.zeros((rows.stop - rows.start, len(known)), np.float32)
            dense[row[a:b] - rows.start, at] = value[a:b]
            yield rows, known, dense


def projected(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A sparse matrix of n rows, by its entries in order of rows, times the basis."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    for rows, known, dense in tiles(n, row, col, value):
        out[rows] = dense @ basis[known]
    return out


def sketched(h: np.ndarray, counts: np.ndarray, weight: np.ndarray, column: np.ndarray, omega: np.ndarray, out: np.ndarray) -> float:
    """out += A'(A omega) of the texts' blocks of unit length; returns the trace of A'A."""
    _, size, _ = blocks(counts)
    squares, row, col, value = tf_idf(h, size, weight, column)
    value = value / np.sqrt(squares[row]).astype(np.float32)
    for _, known, dense in tiles(len(size), row, col, value):
        out[known] += dense.T @ (dense @ omega[known])
    return float((value.astype(np.float64) ** 2).sum())


def sketches(docs: DataFrame, weight: np.ndarray, columns: list[np.ndarray], omegas: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Of each space: A'(A omega) and the trace of A'A over all blocks of all documents.

    A task adds up what it reads, the partial sums are added block by block of columns, and (columns x rank) numbers of
    each space come to the driver, whatever the number of documents.
    """
    spark, width = docs.sparkSession, 256
    shared = spark.sparkContext.broadcast((weight, columns, omegas))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, columns, omegas = shared.value
        total, traces = [np.zeros_like(o) for o in omegas], np.zeros(len(omegas))
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, 1 << 18):
                h, counts = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(len(omegas)):
                    traces[k] += sketched(h, counts, weight, columns[k], omegas[k], total[k])
        for k, t in enumerate(total):
            for a in range(0, len(t), width):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a]), pa.array([t[a : a + width].tobytes()], pa.binary()), pa.array([traces[k] if a == 0 else 0.0])], ["space", "first", "sums", "trace"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                at = held.setdefault((r["space"], r["first"]), [0, 0.0])
                at[0], at[1] = at[0] + np.frombuffer(r["sums"], np.float32), at[1] + r["trace"]
        for (k, a), (x, trace) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a]), pa.array([x.tobytes()], pa.binary()), pa.array([trace])], ["space", "first", "sums", "trace"])

    schema = "space long, first long, sums binary, trace double"
    few = docs.select("text").coalesce(TASKS_A_CORE * max(8, spark.sparkContext.defaultParallelism))
    rows = few.mapInArrow(lean(part), schema).repartition(partitions(spark), "space", "first").mapInArrow(add, schema).collect()
    shared.destroy()
    out = []
    for k, omega in enumerate(omegas):
        mine = sorted(((r.first, r.sums, r.trace) for r in rows if r.space == k), key=lambda r: r[0])
        out.append((np.frombuffer(b"".join(m[1] for m in mine), np.float32).reshape(omega.shape) if mine else np.zeros_like(omega), sum(m[2] for m in mine)))
    return out


def singular_vectors(sketch: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The leading RANK right singular vectors of A from one sketch A'(A omega), omega orthonormal (the Nystrom form of the randomised SVD)."""
    sketch = sketch.astype(np.float64)
    shift = 1e-6 * np.linalg.norm(sketch)
    sketch = sketch + shift * omega
    core = omega.T @ sketch
    values, turn = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-12)
    u, s, _ = np.linalg.svd(sketch @ (turn[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return np.ascontiguousarray(u[:, : min(RANK, int((s**2 > 4 * shift).sum()))]).astype(np.float32)


def subsequence_rows(a: list[int], b: list[int]) -> list[int]:
    """Rows of bits of the longest common subsequence's table: 0 at bit j of row i where b[j] makes it longer for a[: i + 1]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    return rows


def common_subsequence(a: list[int], b: list[int], rows: list[int] | None = None) -> tuple[int, list[bool]]:
    """Length of the longest common subsequence and which elements of a are in one: a walk back over the rows."""
    rows, full = subsequence_rows(a, b) if rows is None else rows, (1 << len(b)) - 1
    used, j = [False] * len(a), len(b)
    for i in range(len(a) - 1, -1, -1):
        length = lambda r, j: j - (r & ((1 << j) - 1)).bit_count()
        before = rows[i - 1] if i else full
        while j and length(rows[i], j) == length(rows[i], j - 1):
            j -= 1
        if j and length(before, j) < length(rows[i], j):
            used[i], j = True, j - 1
    return sum(used), used


def leaked(item: list[int], answer: int, words: list[int]) -> tuple[bool, int]:
    """Whether words hold the item (its last `answer` words are the answer), and the common words."""
    known = set(words)
    most = sum(x in known for x in item)  # no common subsequence is longer
    if most < SHARE_WITH_ANSWER * len(item):
        return False, most
    rows = subsequence_rows(item, words)
    n = len(words) - rows[-1].bit_count()
    share = n / len(item)
    if share >= SHARE or share < SHARE_WITH_ANSWER:
        return share >= SHARE, n
    used = common_subsequence(item, words, rows)[1]
    return (sum(used[len(item) - answer :]) / answer if answer else 1.0) >= ANSWER_SHARE, n


def answer_words(text: str) -> int:
    """How many of the item's last words are its answer."""
    raw = text.encode()
    count = lambda t: int(terms(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1][0])
    after = raw.rpartition(b"?")[2] if b"?" in raw else b""
    return count(after) or min(ANSWER, count(raw))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) -> (doc_id, item_id, item_words, common_words): each document that holds an item.

    Whole texts are searched, in overlapping passages. An item of no words is no item; null texts are empty; repeated
    rows give repeated results; an empty table on either side gives an empty one; very long texts are read 256 kB of
    documents at a time, a longer one at once.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words int, common_words int"
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null").distinct(), "items")
    found = item_blocks(items)
    if not found:
        return spark.createDataFrame([], schema)
    weight = weights(*document_frequencies(docs))
    out = None
    for a in range(0, len(found), SPACES):
        spaces = [space(items.filter(F.col("item_id").between(low, high)), weight) for low, high in found[a : a + SPACES]]
        part = search(docs, weight, with_latent_space(docs, weight, spaces), schema)
        out = part if out is None else out.unionAll(part)
    return out


def item_blocks(items: DataFrame) -> list[tuple[int, int]]:
    """First and last item_id of blocks of at most WORDS words; an item of more is a block of its own. One row an item of the benchmark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            _, words = terms(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64))], ["item_id", "n"])

    out, held = [], 0
    for r in items.select("item_id", "text").mapInArrow(count, "item_id long, n long").filter("n > 0").groupBy("item_id").agg(F.sum("n").alias("n")).orderBy("item_id").collect():
        if out and held + r.n <= WORDS:
            out[-1], held = (out[-1][0], r.item_id), held + r.n
        else:
            out.append((r.item_id, r.item_id))
            held = r.n
    return out


def space(items: DataFrame, weight: np.ndarray) -> dict:
    """A block of items (at most WORDS words, or one item): the columns of their terms, their words and answers."""
    rows = sorted((r.item_id, r.text) for r in items.collect())
    raw = [t.encode() for _, t in rows]
    h, counts = terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))
    known = np.unique(bucket(h))
    column = np.full(TERMS, -1, np.int32)
    column[known] = np.arange(len(known))
    ends = np.cumsum(counts)
    words = [h[e - n : e].tolist() for e, n in zip(ends, counts)]
    return {"column": column, "n": len(known), "h": h, "counts": counts, "ids": [i for i, _ in rows], "words": words, "answers": [answer_words(t) for _, t in rows]}


def with_latent_space(docs: DataFrame, weight: np.ndarray, spaces: list[dict]) -> list[dict]:
    """Spaces with the basis of their latent space and their items' passages in it.

    What is decomposed are the TF-IDF blocks of the items and of all documents over the items' terms, either of them with
    half the weight: the documents alone keep their common words and lose the items, the items alone know nothing of
    which terms stand for each other. A passage's vector is divided by the share of its square that the space keeps, so
    a copy's product with its item is the item's length, however much of it the space keeps.
    """
    rng = np.random.default_rng(1)
    omegas = [np.linalg.qr(rng.standard_normal((s["n"], min(RANK + EXTRA, s["n"]))))[0].astype(np.float32) for s in spaces]
    out = []
    for s, omega, (sketch, trace) in zip(spaces, omegas, sketches(docs, weight, [s["column"] for s in spaces], omegas)):
        own = np.zeros_like(omega)
        mine = sketched(s["h"], s["counts"], weight, s["column"], omega, own)
        basis = singular_vectors(own + sketch * (mine / trace if trace else 0), omega)
        length, latent, text = in_space(s["h"], s["counts"], weight, s["column"], basis)
        kept = np.maximum((latent * latent).sum(axis=1), 1e-3 * length**2)
        out.append({"column": s["column"], "basis": basis, "latent": (latent * (length / kept)[:, None]).astype(np.float32), "length": length, "of": text, "ids": s["ids"], "words": s["words"], "answers": s["answers"]})
    return out


def in_space(h: np.ndarray, counts: np.ndarray, weight: np.ndarray, column: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage its length, its vector in the latent space, and its text."""
    _, size, text = blocks(counts)
    squares, row, col, value = tf_idf(h, size, weight, column)
    y = projected(len(size), row, col, value, basis)
    a, b = passages(text)
    two = a != b
    vectors, length = y[a], squares[a]
    vectors[two] += y[b[two]]
    length[two] += squares[b[two]]
    return np.sqrt(length).astype(np.float32), vectors, text[a]


def search(docs: DataFrame, weight: np.ndarray, spaces: list[dict], schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((weight, spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, spaces = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc, found = [], []
            for a, b in slices(offsets, 1 << 18):
                h, counts = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                _, size, block_text = blocks(counts)
                first, last = passages(block_text)
                upto = np.cumsum(size)
                begin, close, ends = upto[first] - size[first], upto[last], np.cumsum(counts)
                for s in spaces:
                    length, vectors, text = in_space(h, counts, weight, s["column"], s["basis"])
                    where, which = [], []
                    for x in range(0, len(text), 4096):
                        p, q = np.nonzero(vectors[x : x + 4096] @ s["latent"].T >= COSINE * np.minimum(length[x : x + 4096, None], s["length"]))
                        where += (p + x).tolist()
                        which += s["of"][q].tolist()
                    leaking = set()
                    for p, k in dict.fromkeys(zip(where, which)):
                        t = int(text[p])
                        if (t, k) in leaking:
                            continue
                        n = len(s["words"][k])
                        low, high = max(int(ends[t] - counts[t]), int(begin[p]) - n), min(int(ends[t]), int(close[p]) + n)
                        hit, same = leaked(s["words"][k], s["answers"][k], h[low:high].tolist())
                        if hit:
                            leaking.add((t, k))
                            doc.append(a + t)
                            found.append((s["ids"][k], n, same))
            taken = batch.column(0).take(pa.array(doc, pa.int64())).cast(pa.int64())
            parts = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([taken, *parts], ["doc_id", "item_id", "item_words", "common_words"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_words, common_words of every document that holds a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
