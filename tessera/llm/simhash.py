"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within two bits by deletion variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chosenpath
from tessera.llm.common import lean, partitions, stored, table, utf8
from tessera.llm.components import components

SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the shingles of the lower-cased words, repeats included. Under `words` words the whole sequence is the one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, n)


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64. Repeats count; under `words` words the whole sequence is the one shingle."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):  # a hash is 64 bytes here: a very long text is counted piece by piece
        part = hashes[a : a + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long: the 64 bits). One row for each input row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            out = np.fromiter((fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1], at[1:])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of 64 bits of which one differs by at most one bit when `bits` bits differ."""
    n = (bits + 2) // 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(fp) distinct -> (a, b) all pairs within `bits` bits, each once.

    Two or three differing bits leave one of two segments with at most one, four or five one of three, and so on. Each
    segment is indexed under its one-wildcard variants (a bit deleted), so equality of a variant finds every such pair;
    the join's condition verifies the distance and keeps a pair at one variant only: the first segment that agrees, at
    the differing bit or else its lowest. A hot variant is a skewed join key, which adaptive execution splits.
    The index is always dealt by key: Spark sizes it by the fingerprints before the explode, about 30 times too low.
    """
    index, agreeing = None, "NULL"
    for shift, width in segments(bits):
        mask = (1 << width) - 1
        segment = f"(shiftrightunsigned(fp, {shift}) & {mask}L)"
        wild = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j")
        # which bit of the 64 is deleted and the segment's other bits, in one long
        part = fps.select("fp", wild).select("fp", F.expr(f"shiftleft(CAST({shift} + j AS BIGINT), 48) ^ ({segment} & ~shiftleft(1L, j))").alias("variant"))
        index = part if index is None else index.unionAll(part)
    for shift, width in reversed(segments(bits)):
        mask = (1 << width) - 1
        differing = f"(shiftrightunsigned(x.fp ^ y.fp, {shift}) & {mask}L)"
        agreeing = f"CASE WHEN bit_count({differing}) <= 1 THEN {shift} + bit_count({differing} - 1 & {mask}L) % {width} ELSE {agreeing} END"
    x, y = index.alias("x"), index.alias("y")
    near = F.expr(f"x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {bits} AND shiftrightunsigned(x.variant, 48) = {agreeing}")
    return x.hint("merge").join(y, (F.col("x.variant") == F.col("y.variant")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def beside_fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, text, hash) -> also fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            out = np.fromiter((fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1], at[1:])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["doc_id", "text", "hash", "fp"])

    return rows.select("doc_id", "text", "hash").mapInArrow(lean(run), "doc_id long, text string, hash long, fp long")


def similar(sets: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """chosenpath.with_sets() with fp -> (a, b) fingerprints, enough of them to join all documents whose shingle sets have a Jaccard similarity of `least` or more.

    The pairs are those of the chosen-path join, confirmed on full sets; families of any size are joined by the same rule.
    """
    classes = chosenpath.classes_of(sets, F.min("fp").alias("fp"))
    name = classes.select("id", "key", "fp")
    pairs = chosenpath.links(classes, rows, words, 100 * least)
    across = pairs.hint("merge").join(name.select(F.col("id").alias("a"), F.col("fp").alias("x")), "a").hint("merge").join(name.select(F.col("id").alias("b"), F.col("fp").alias("y")), "b").select("x", "y")
    within = sets.select("key", F.col("fp").alias("x")).distinct().hint("merge").join(name.select("key", F.col("fp").alias("y")), "key").select("x", "y")
    return across.unionAll(within).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, least: float | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp, component_id): the smallest doc_id reachable by links of `bits` bits or fewer (at most 30).

    With `least`, documents whose shingle sets have that Jaccard similarity or more are linked as well.
    Equal fingerprints are pre-aggregated to one node, so copies cost one row in the index. Null and empty texts share
    fingerprint 0 and link like any other; other columns are ignored; an empty table gives an empty one; a repeated
    doc_id keeps a row for each input row, a null doc_id counts as a document of its own that no component is named by.
    Very long texts are taken whole: about 40 bytes a word while their shingles are hashed. All joins are dealt by key:
    their tables grow with the documents, and a broadcast passes through the driver.
    """
    if least is None:
        marked = stored(with_fingerprints(docs, words), "fingerprints")
    else:
        rows = chosenpath.identified(docs)
        marked = stored(chosenpath.with_sets(beside_fingerprints(rows, words), words, "fp"), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = links(nodes.select("fp").repartition(partitions(docs.sparkSession), "fp"), bits)
    parts = components(linked if least is None else linked.unionAll(similar(marked, rows, words, least)))
    member = nodes.hint("merge").join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least_id = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.hint("merge").join(least_id, "component").select("fp", "component_id")
    return marked.select("doc_id", "fp").hint("merge").join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
