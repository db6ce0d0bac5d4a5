"""Product codes of vectors over integers: codebooks by rounds of exact assignment, whatever the order of floating-point sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Half a unit in the last place of float32 for a number of 1.
UNIT = 2.0**-24
#: Sums go from tasks to Spark in digits of so many bits, so that they overflow nowhere.
DIGIT = 40
BLOCK = 4096


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: int64 where all of them fit in 62 bits, else Python integers."""
    scaled = values.astype(np.float64) * SCALE
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    big = np.abs(values) >= 2.0**53  # integers already; times SCALE they may be too large for a double
    return np.array([int(v) * SCALE if b else int(np.floor(s)) for v, s, b in zip(values.tolist(), scaled.tolist(), big.tolist())], object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row a vector, shorter ones filled up with zeros to `width`."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    flat = integers(column.flatten().to_numpy(zero_copy_only=False))
    if n and (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in the integers of the arguments."""
    d = x - c
    return (d * d).sum(axis=1)


def safe(x: np.ndarray) -> bool:
    """Whether a squared distance between such rows fits in int64."""
    return x.dtype != object and (not x.size or int(np.abs(x).max()) < int((2.0**62 / max(1, x.shape[1])) ** 0.5 / 2))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of c, the lower of equals, and its squared distance.

    |c|^2 - 2 x.c orders the entries of a row. It is computed by one float32 matrix product with an interval that holds the
    exact value: w products of numbers rounded to float32, in any order of summation, fused or not, are off by at most
    (w + 2) u / (1 - (w + 2) u) times |x||c|; rounding |c|^2, the product by 2 and the difference add three u of what
    they yield. Every entry whose interval reaches below the least upper end is computed again in int64.
    """
    n, w = x.shape
    choice, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return choice, distance
    if not (safe(x) and safe(c)):  # beyond int64: Python integers, row by row for the rows that need it
        fine = np.array([safe(r[None, :]) for r in x]) if x.dtype != object else np.array([max(map(abs, r), default=0) < 2**26 for r in x.tolist()])
        fine &= safe(c)
        distance = distance.astype(object)
        if fine.any():
            choice[fine], distance[fine] = nearest(x[fine].astype(np.int64), c)
        rest = np.flatnonzero(~fine)
        for a in range(0, len(rest), 256):
            some = rest[a : a + 256]
            d = ((x[some].astype(object)[:, None, :] - c.astype(object)[None]) ** 2).sum(axis=2)
            choice[some] = [min(range(len(c)), key=r.__getitem__) for r in d.tolist()]
            distance[some] = d[np.arange(len(some)), choice[some]]
        return choice, distance
    square = (c * c).sum(axis=1)
    score = square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)
    long = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square.astype(np.float64))
    slack = 1.0001 * UNIT * ((2 * w + 12) * long + 4 * square)  # (2(w + 2) + 3 * 2) |x||c| and 2 |c|^2, with room for what is computed in double
    low, high = score - slack, score + slack
    overlaps = low <= high.min(axis=1)[:, None]
    row, entry = np.nonzero(overlaps)
    choice = overlaps.argmax(axis=1)
    many = (overlaps.sum(axis=1) > 1)[row]
    row, entry = row[many], entry[many]
    if len(row):
        d = exact(x[row], c[entry])
        order = np.lexsort((entry, d, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        choice[row[first]] = entry[first]
    return choice, exact(x, c[choice])


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer; only the highest digit has a sign."""
    place = 0
    while value >> DIGIT not in (0, -1):
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1
    yield place, value


def updated(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry becomes the floor of the mean of its parts. At most books.size sums reach the driver."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                x = matrix(batch.column(0).slice(a, BLOCK), parts * w)
                small = x.dtype != object and np.abs(x).max(initial=0) < 2**50
                for p in range(parts):
                    own = x[:, p * w : (p + 1) * w]
                    which = nearest(own, books[p])[0]
                    order = np.argsort(which, kind="stable")
                    there, starts = np.unique(which[order], return_index=True)
                    if len(there) and w:
                        sums[p, there] += np.add.reduceat((own if small else own.astype(object))[order], starts, axis=0).astype(object)
                    counts[p] += np.bincount(which, minlength=entries)
        out = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts))]
        out += [(p, e, i, place, digit) for p, e in zip(*np.nonzero(counts)) for i in range(w) for place, digit in digits(int(sums[p, e, i]))]
        columns = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], ["part", "entry", "at", "place", "digit"])

    found = vectors.select("embedding").mapInArrow(lean(run), "part long, entry long, at long, place long, digit long")
    sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), object)
    for r in found.groupBy("part", "entry", "at", "place").agg(F.sum("digit").alias("digit")).collect():
        if r["at"] < 0:
            counts[r["part"], r["entry"]] += r["digit"]
        else:
            sums[r["part"], r["entry"], r["at"]] += r["digit"] << (DIGIT * r["place"])
    out = books.astype(object)
    for p, e in zip(*np.nonzero(counts)):
        out[p, e] = [s // counts[p, e] for s in sums[p, e]]
    return narrow(out)


def narrow(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if all(abs(v) < 2**62 for v in books.ravel().tolist()) else books


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of the rows whose vector is not null and holds no null or non-finite component."""
    kind = rows.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), "label").filter("embedding is not null")
    return kept.filter(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """usable() rows -> integers (parts, entries, width of a part), from the vectors of the smallest ids; each round reads all vectors once."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    w = -(-longest // parts)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    start = matrix(first.column("embedding").combine_chunks(), parts * w)
    books = narrow(start.reshape(len(start), parts, w).transpose(1, 0, 2))
    for _ in range(rounds):
        books = updated(vectors, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """usable() rows -> (vec_id, label, code, error): two hex digits a part, squared distances summed over parts; an error beyond 63 bits is null."""
    parts, _, w = books.shape
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = matrix(part.column(1), parts * w)
                found = [nearest(x[:, p * w : (p + 1) * w], books[p]) for p in range(parts)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                errors = reduce(lambda a, b: a + b, (f[1].astype(object) for f in found))
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array([e if e < 2**63 else None for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(lean(run), f"vec_id long, label {kind}, code string, error long")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, label, ...) -> (vec_id, label, code, error) and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. Where lengths differ or `parts` does not divide
    them, missing components count as 0. Null ids are in order behind all others and repeated ones in order of their
    vectors, which matters for the first codebooks only. With fewer vectors than entries, codebooks are that short. Components of any
    size are exact. Other columns are ignored; an empty table gives an empty one.
    """
    vectors = usable(rows)
    books = codebooks(vectors, parts, entries, rounds)
    if not books.shape[1]:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"), books
    return coded(vectors, books), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256. A label that a third of all rows have is summed before the exchange; its join is split by adaptive execution or broadcast if small."""
    out, books = compressed(table(spark, sf_dir, "embeddings"))
    out = stored(out, "codes")
    sums = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    whole = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(whole).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other; a codebook is a row for each part, entry and component."""
    distance = "CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT)"
    nearest = f"SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.id, x.p, c.e, {distance} AS d FROM x JOIN {{0}} c ON c.p = x.p AND c.i = x.i GROUP BY x.id, x.p, c.e) GROUP BY id, p"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda y: NOT isfinite(y))) = 0)",
        f"x AS MATERIALIZED (SELECT id, (i - 1) // (len(embedding) // {PARTS}) AS p, (i - 1) % (len(embedding) // {PARTS}) AS i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept))",
        f"c0 AS MATERIALIZED (SELECT p, id - 1 AS e, i, v FROM x WHERE id <= {ENTRIES})",
    ]
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(f'c{k}')})")
        steps.append(f"s{k} AS (SELECT a.p, a.e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN x USING (id, p) GROUP BY a.p, a.e, x.i)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.v) AS v FROM c{k} c LEFT JOIN s{k} s USING (p, e, i))")
    steps.append(f"final AS MATERIALIZED ({nearest.format(f'c{ROUNDS}')})")
    steps.append("rows AS (SELECT k.vec_id, k.label, string_agg(lower(printf('%02x', f.e)), '' ORDER BY f.p) AS code, CAST(sum(f.d) AS BIGINT) AS error FROM final f JOIN kept k USING (id) GROUP BY k.id, k.vec_id, k.label)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{ROUNDS}) AS codebooks_sha256 FROM rows"


OP12_SQL = _sql()
