"""Line dedup by winnowing: window minima over hashes of line sequences join positions; matches are extended and later runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACE, lean, mix, prefix_sums, ranges, slices, span_hashes, stored, table, utf8, word_spans

#: A line is cut where a sentence ends, before a word whose hash is the least of NEAR words on either side in its sentence
#: (the cuts of a passage are its own, wherever it begins), and LONG words after a cut. RUN pieces make a shingle; of two
#: consecutive shingles (the window) the lesser is a fingerprint: every repeated run of RUN + 1 pieces is found, and no more
#: than one piece on either side of its fingerprints is left to extend a match by.
LONG, NEAR, RUN, WINDOW = 16, 3, 3, 2


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 texts -> starts and ends of their pieces, 64-bit hashes of the pieces' words, and each text's number of pieces."""
    start, end, counts = word_spans(data, offsets, NOT_SPACE)
    n = len(start)
    if not n:
        return start, end, np.zeros(0, np.uint64), counts
    newline = np.concatenate(([0], np.cumsum(data == 10)))
    last = data[end - 1]
    fresh = np.zeros(n, bool)
    first_of = np.cumsum(counts) - counts
    fresh[first_of[counts > 0]] = True
    fresh[1:] |= (newline[start[1:]] > newline[end[:-1]]) | np.isin(last[:-1], np.frombuffer(b".!?", np.uint8))
    at = np.arange(n)
    words = span_hashes(prefix_sums(data), start, end)
    least = np.ones(n, bool)
    sentence = np.cumsum(fresh)
    for i in range(1, min(NEAR, n - 1) + 1):
        # no cut within NEAR words of a sentence's edge either
        same = sentence[i:] == sentence[:-i]
        least[i:] &= same & (words[i:] < words[:-i])
        least[:-i] &= same & (words[:-i] <= words[i:])
        least[:i] = least[n - i :] = False
    fresh |= least
    since = at - np.maximum.accumulate(np.where(fresh, at, 0))
    begin = np.flatnonzero(since % LONG == 0)
    close = np.append(begin[1:], n) - 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + (since % LONG).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
    hashes = mix(sums[close + 1] - sums[begin])
    return start[begin], end[close], hashes, np.diff(np.searchsorted(begin, np.append(first_of, n)))


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of RUN consecutive pieces of one text, the piece each starts at, and each text's number of them."""
    n = np.maximum(counts - RUN + 1, 0)
    at = ranges(np.cumsum(counts) - counts, n)
    out, other = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    if len(at):
        for i in range(RUN):
            out = mix(out * np.uint64(3) + hashes[at + i] + np.uint64(i))
            other = (other ^ hashes[at + i]) * np.uint64(0xFF51AFD7ED558CCD)
    return out, mix(other), at, n


def winnow(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each shingle is the least of some window of WINDOW in its text (all windows there are, at least one)."""
    picked = np.zeros(len(value), bool)
    size = np.minimum(counts, WINDOW)
    first = np.cumsum(counts) - counts
    begin = ranges(first, np.maximum(counts - WINDOW + 1, (counts > 0).astype(np.int64)))
    if not len(begin):
        return picked
    width = np.repeat(size, np.maximum(counts - WINDOW + 1, (counts > 0).astype(np.int64)))
    best = begin.copy()
    for i in range(1, WINDOW):
        nxt = np.minimum(begin + i, len(value) - 1)
        best = np.where((i < width) & (value[nxt] < value[best]), nxt, best)
    picked[best] = True
    return picked


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tie) -> (h, g, doc_id, tie, at, prev, next): fingerprints, 128 bits in two, with 64-bit hashes of the pieces beside them (0 at a text's end).

    What is deleted is decided by these: h and g, and then one more piece's hash for an extension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, tie = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, 1 << 20):
                _, _, hashes, counts = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                value, other, at, n = shingles(hashes, counts)
                keep = winnow(value, n)
                who = np.repeat(np.arange(a, b), n)[keep]
                first = np.cumsum(counts) - counts
                low, high, at, value, other = first[who - a], (first + counts)[who - a], at[keep], value[keep], other[keep]
                near = []
                for i in (-1, RUN):
                    spot = at + i
                    inside = (spot >= low) & (spot < high)
                    beside = hashes[np.where(inside, spot, 0)] if len(hashes) else np.zeros(0, np.uint64)
                    near.append(pa.array(np.where(inside, beside | np.uint64(1), np.uint64(0)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(other.view(np.int64)), pa.array(ids[who], pa.int64()), pa.array(tie[who]), pa.array((at - low).astype(np.int32)), *near], ["h", "g", "doc_id", "tie", "at", "prev", "next"])

    return docs.mapInArrow(lean(run), "h long, g long, doc_id long, tie long, at int, prev long, next long")


def repeated(prints: DataFrame) -> DataFrame:
    """fingerprints() -> (doc_id, tie, runs: array of (from, pieces)): what repeats an earlier place, extended both ways.

    A place is (doc_id, tie, at). Each fingerprint is matched with its earliest place, which is a partial aggregate and
    one row a fingerprint, so a passage that a third of all documents share costs a row each. Where the piece beside it
    is another one there, the earliest place of the fingerprint with that very piece on that side extends the match: those
    are aggregated by (fingerprint, side, piece) of the rows that differ. Only what has two places or more enters a join,
    from a table of its own: a hot one is a skewed key of a join between two exchanges, which adaptive execution splits.
    """
    spot = F.struct("doc_id", "tie", "at")
    place = F.struct("doc_id", "tie", "at", "prev", "next")
    first = stored(prints.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "first"), "first-places")
    later = (spot > F.struct("first.doc_id", "first.tie", "first.at")).alias("later")
    met = stored(prints.join(first, ["h", "g"]).select("h", "g", *(F.col(c) for c in ("doc_id", "tie", "at", "prev", "next")), F.col("first.prev").alias("first_prev"), F.col("first.next").alias("first_next"), later), "repeats")
    left, right = (F.expr(f"CAST({x} = first_{x} AND {x} <> 0 AS INT)") for x in ("prev", "next"))
    spans = met.filter("later").select("doc_id", "tie", F.struct((F.col("at") - left).alias("from"), (F.lit(RUN) + left + right).alias("pieces")).alias("run"))
    beside = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(x).alias("piece"), F.col(f"first_{x}").alias("known")) for side, x in ((-1, "prev"), (0, "next"))))).alias("b")
    others = met.select("h", "g", "doc_id", "tie", "at", beside).filter("b.piece <> 0 AND b.piece <> b.known").select("h", "g", "doc_id", "tie", "at", "b.side", "b.piece")
    keys = ["h", "g", "side", "piece"]
    known = stored(others.groupBy(*keys).agg(F.min(spot).alias("earliest"), F.count("*").alias("n")).filter("n > 1").select(*keys, "earliest"), "first-neighbours")
    more = others.join(known, keys).filter(spot > F.col("earliest")).select("doc_id", "tie", F.struct((F.col("at") + F.col("side")).alias("from"), F.lit(RUN + 1).alias("pieces")).alias("run"))
    return spans.unionAll(more).groupBy("doc_id", "tie").agg(F.collect_list("run").alias("runs"))


def removed_pieces(begin: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Which of n pieces are in a run."""
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, begin, 1)
    np.add.at(out, np.minimum(begin + count, n), -1)
    return np.cumsum(out)[:n] > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated runs of lines taken out of `text`, and a column n_removed_pieces (replaced if it is there already).

    A run is RUN pieces or more that stand at an earlier place: in a document of smaller doc_id (null first; equal ids by
    a hash of the text) or earlier in the same one. Runs of RUN + WINDOW - 1 pieces are always found. A run goes with the
    white space after it, line by line; what is left is stripped of white space at its end. Texts without a repeat stay
    byte for byte; null texts stay null. The other columns are kept; an empty table gives an empty one. Texts are read
    1 MB at a time, a longer one at once.
    """
    columns = [c for c in docs.columns if c != "n_removed_pieces"]
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), tie.alias("tie"))
    runs = repeated(fingerprints(narrow))
    keyed = docs.select(*columns).withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_tie": tie})
    joined = keyed.join(runs.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("runs").alias("_runs")), ["_id", "_tie"], "left").select(*columns, F.lit(0).cast("long").alias("n_removed_pieces"), "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, old = len(batch), batch.column("text")
            runs_of = batch.column("_runs")
            size = runs_of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, every = np.concatenate(([0], np.cumsum(size))), runs_of.flatten()
            begin, count = (every.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("from", "pieces"))
            some = np.flatnonzero((size > 0) & old.is_valid().to_numpy(zero_copy_only=False))
            data, offsets = utf8(old.take(pa.array(some)))
            texts, gone = [], np.zeros(n, np.int64)
            for a, b in slices(offsets, 1 << 20):
                raw = data[offsets[a] : offsets[b]].tobytes()
                at = offsets[a : b + 1] - offsets[a]
                start, _, _, counts = pieces(data[offsets[a] : offsets[b]], at)
                first = np.cumsum(counts) - counts
                for i in range(a, b):
                    mine = start[first[i - a] : first[i - a] + counts[i - a]]
                    runs = slice(upto[some[i]], upto[some[i] + 1])
                    away = removed_pieces(begin[runs], count[runs], len(mine))
                    close = np.append(mine[1:], at[i - a + 1])
                    kept = np.flatnonzero(np.diff(np.concatenate(([True], away, [True]))))  # where kept pieces begin and end, by turns
                    parts = (raw[mine[x] : close[y - 1]] for x, y in zip(kept[::2].tolist(), kept[1::2].tolist()))
                    texts.append((raw[at[i - a] : mine[0]] + b"".join(parts)).rstrip(b" \t\n\r\x0b\x0c"))
                    gone[some[i]] = away.sum()
            new = pa.array(texts, pa.binary()).cast(pa.string()).cast(old.type)
            which = np.arange(n)
            which[some] = n + np.arange(len(some))
            mixed = pa.concat_arrays([old, new]).take(pa.array(which)) if len(some) else old
            arrays = [mixed if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone)], [*columns, "n_removed_pieces"])

    return joined.mapInArrow(lean(cut), joined.drop("_runs").schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed_pieces, n_bytes left, kept_sha256 of what is left."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed_pieces", F.octet_length(kept).cast("long").alias("n_bytes"), F.sha2(kept, 256).alias("kept_sha256"))
