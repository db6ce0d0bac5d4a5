"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in an earlier document.

Two exchanges bring equal strings together without moving every suffix. Each window of LENGTH bytes is keyed by the least
hash of the K-byte strings in it (its minimiser), so equal windows have equal keys, and neighbouring windows with one key
form a segment. First only the keys are exchanged, to find those that more than one document has; then the segments
with such keys are, and each key's segments are a text whose suffix array puts equal windows side by side. Hashes only
bring together what may be equal: what is equal is told by the suffix arrays and by comparing bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _powers, lean, mix, partitions, prefix_sums, ranges, slices, span_hashes, table, utf8
from tessera.llm.lyndon import suffix_arrays

LENGTH, K = 50, 16
#: Windows of a segment at most. One task sorts the segments of a key, up to HOT of them (some 6 MB). Of keys with more each
#: task sorts its own segments and sends only their distinct windows, dealt one by one, so a key that a third of all
#: documents share is in all tasks. Rows or bytes that a task gathers before it sends them.
MOST, HOT, GATHER = 64, 50_000, 1 << 19
#: A text over LONG bytes is made into several by the minimisers of longer strings, which equal windows share too; those of
#: the longest are sorted whatever their length. So many bytes are sorted at once, and of so many bytes texts of about
#: one length are put together.
LONG, FINER, AT_ONCE, TOGETHER = 800, {K: 32, 32: 44, 44: 49}, 1 << 19, 1 << 22
LOW48 = np.uint64((1 << 48) - 1)
HOT_BIT, SLOTS, TWICE = 1 << 48, 1 << 16, 128
#: Runs that a task holds back, so that a document is one row of it.
HELD = 2_000_000
#: Rows without doc_id go under numbers below this one, made of their texts, and count as one document before all others.
NULLS = -(2**62)


def segments(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' bytes: each segment's first byte, number of windows, key and text. Every window is in one segment."""
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not n.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums, down = prefix_sums(data), _powers(len(data) + 1)[1]
    least = mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
    width, wide = LENGTH - k + 1, 1
    while wide * 2 <= width:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    at = ranges(offsets[:-1], n)
    key, owner = least[at], np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero((np.diff(key, prepend=~key[0]) != 0) | (np.diff(owner, prepend=-1) != 0))
    count = np.diff(np.append(first, len(key)))
    parts = -(-count // MOST)
    part = ranges(np.zeros(len(parts), np.int64), parts)
    start, left = np.repeat(first, parts) + part * MOST, np.repeat(count, parts) - part * MOST
    return at[start], np.minimum(left, MOST), key[start], owner[start]


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of an array as binary values."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def digests(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans of so many bytes each, a piece of the data at a time."""
    at = np.concatenate(([0], np.cumsum(size)))
    out = [span_hashes(prefix_sums(data[at[a] : at[b]]), at[a:b] - at[a], at[a + 1 : b + 1] - at[a]) for a, b in slices(at, AT_ONCE)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number (a view)."""
    return np.ndarray((max(len(data) - 7, 0),), np.uint64, np.ascontiguousarray(data), strides=(1,))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Whether the spans of so many bytes (8 or more) at a and b are equal, byte by byte."""
    words = words_at(data)
    if isinstance(size, int):
        out = np.ones(len(a), bool)
        for o in [*range(0, size - 7, 8), size - 8]:
            out &= words[a + o] == words[b + o]
        return out
    if not len(a):
        return np.zeros(0, bool)
    n = -(-size // 8)
    step = np.minimum(ranges(np.zeros(len(n), np.int64), n) * 8, np.repeat(size - 8, n))
    same = words[np.repeat(a, n) + step] == words[np.repeat(b, n) + step]
    return np.logical_and.reduceat(same, np.cumsum(n) - n)


def distinct(key: np.ndarray, doc: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments in an order in which equal ones of a key are neighbours, that of the least document first, and where each new one begins.

    A hash puts them in order and bytes decide; if two hashes were ever equal, a segment would merely come twice.
    """
    digest = digests(data[ranges(start, size)], size) if not contiguous(start, size) else digests(data, size)
    order = np.lexsort((doc, digest, key))
    fresh = (np.diff(key[order], prepend=~key[order[:1]]) != 0) | (np.diff(digest[order], prepend=~digest[order[:1]]) != 0) | (np.diff(size[order], prepend=-1) != 0)
    maybe = np.flatnonzero(~fresh)
    fresh[maybe] = ~equal_spans(data, start[order[maybe - 1]], start[order[maybe]], size[order[maybe]])
    return order, np.flatnonzero(fresh)


def contiguous(start: np.ndarray, size: np.ndarray) -> bool:
    return not len(start) or (start[0] == 0 and bool((start[1:] == start[:-1] + size[:-1]).all()))


def by_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Keys are least hashes, so they are small numbers: a hash of theirs deals them evenly."""
    return ((mix(key) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def grouped(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0) if len(values) else np.zeros(0, np.int64)


def rank(doc: np.ndarray) -> np.ndarray:
    """Order of documents: those without doc_id are one, before all others."""
    return np.maximum(doc, NULLS)


def send_keys(key: np.ndarray, doc: np.ndarray, digest: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's keys -> one entry a key (any of its documents, the logarithm of how many distinct segments it has, TWICE more if another document has it), and at once the keys of the other documents.

    That pre-aggregation makes a key one entry a task, however many documents have it.
    """
    order = np.lexsort((digest, key))
    head = grouped(key[order])
    fresh = (np.diff(key[order], prepend=~key[order[:1]]) != 0) | (np.diff(digest[order], prepend=~digest[order[:1]]) != 0)
    kinds = np.ceil(np.log2(np.add.reduceat(fresh.astype(np.int64), head))).astype(np.int64) if len(head) else np.zeros(0, np.int64)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[fresh], doc[fresh]
    head = grouped(key)
    size = np.diff(np.append(head, len(key)))
    many = np.repeat(rank(doc[head]) < rank(doc[head + size - 1]), size)
    yield from key_rows(key[head], doc[head], (kinds + TWICE * many[head]).astype(np.uint8), 0, buckets)
    # rows without doc_id only come to know a key by another document, so they are entries of their own
    rest = many.copy()
    rest[head] = False
    if rest.any():
        yield from key_rows(key[rest], doc[rest], np.zeros(int(rest.sum()), np.uint8), 1, buckets)
    others = np.repeat(size > 1, size) & ~many
    others[head] = False
    if others.any():
        yield from key_rows(key[others], doc[others], np.zeros(int(others.sum()), np.uint8), 0, buckets)


def key_rows(key: np.ndarray, doc: np.ndarray, kinds: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = by_bucket(key if kind == 0 else doc.view(np.uint64), buckets)
    order = np.lexsort((doc, bucket))
    key, doc, kinds, bucket = key[order], doc[order], kinds[order], bucket[order]
    head = grouped(bucket)
    count = np.diff(np.append(head, len(bucket)))
    step = np.diff(doc, prepend=0)
    step[head] = doc[head]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[head]), pa.array(np.full(len(head), kind, np.int32)), binary_rows(short_keys(key), count * 6), binary_rows(step, count), binary_rows(kinds, count)],
        ["bucket", "kind", "keys", "docs", "kinds"],
    )


def short_keys(key: np.ndarray) -> np.ndarray:
    """The low 48 bits of keys, six bytes each."""
    return np.ascontiguousarray(np.ascontiguousarray(key & LOW48).view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def long_keys(short: bytes) -> np.ndarray:
    key = np.zeros((len(short) // 6, 8), np.uint8)
    key[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
    return key.view(np.uint64).reshape(-1)


def slot_of(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(SLOTS - 1)).astype(np.int64)


def packed(key, doc, tie, start, size, data) -> bytes:
    """Segments of a bucket as one compressed value."""
    parts = (key, np.diff(doc, prepend=0), tie, start.astype(np.int32), size.astype(np.uint8), data)
    return pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, n_bytes: int) -> list[np.ndarray]:
    raw, out, at = pa.decompress(blob, decompressed_size=n * 29 + n_bytes, codec="zstd", asbytes=True), [], 0
    for kind, count in ((np.uint64, n), (np.int64, n), (np.int64, n), (np.int32, n), (np.uint8, n), (np.uint8, n_bytes)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    out[1:5] = [np.cumsum(out[1]), out[2], *(x.astype(np.int64) for x in out[3:5])]
    return out


def read_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = long_keys(b"".join(batch.column("keys").to_pylist()))
    docs = [np.cumsum(np.frombuffer(b, np.int64)) for b in batch.column("docs").to_pylist()]
    return key, np.concatenate(docs) if docs else np.zeros(0, np.int64), np.frombuffer(b"".join(batch.column("kinds").to_pylist()), np.uint8).astype(np.int64)


def by_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task that come in order of buckets, a bucket at a time."""
    held, current = [], None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                if held and bucket[a] != current:
                    yield pa.Table.from_batches(held)
                    held = []
                current = bucket[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pa.array(rows.column("kind").to_numpy() == kind))


def shared_keys(docs: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(doc, text) -> (doc, keys): the keys that another document has too (low 48 bits, and HOT_BIT if it is dealt by whole windows).

    Whether a key is hot must be one answer for all its documents, also those that a task told at once. So it hangs on a
    slot of the key's hash: all keys of a slot in which one has over `hot` entries are hot. There are SLOTS at most.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(offsets, AT_ONCE):
                part = data[offsets[a] : offsets[b]]
                start, count, key, owner = segments(part, offsets[a : b + 1] - offsets[a])
                held.append((key, ids[a:b][owner], span_hashes(prefix_sums(part), start, start + count + LENGTH - 1)))
                n += len(key)
                if n >= GATHER:
                    yield from send_keys(*(np.concatenate(x) for x in zip(*held)), buckets)
                    held, n = [], 0
        if n:
            yield from send_keys(*(np.concatenate(x) for x in zip(*held)), buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_buckets(batches):
            key, doc, _ = read_keys(of_kind(rows, 1))
            told = [(doc, key)]
            key, doc, kinds = read_keys(of_kind(rows, 0))
            if len(key):
                order = np.argsort(key, kind="stable")
                key, doc, kinds = key[order], doc[order], kinds[order]
                head, place = grouped(key), rank(doc)
                shared = (np.minimum.reduceat(place, head) < np.maximum.reduceat(place, head)) | (np.maximum.reduceat(kinds, head) >= TWICE)
                keep = np.repeat(shared, np.diff(np.append(head, len(key))))
                told.append((doc[keep], key[keep]))
            for doc, key in told:
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key.view(np.int64)), pa.array(slot_of(key))], ["doc", "key", "slot"])

    def hot_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_buckets(batches):
            key, _, kinds = read_keys(of_kind(rows, 0))
            if len(key):
                order = np.argsort(key, kind="stable")
                key, head = key[order], grouped(key[order])
                entries = np.add.reduceat(1 << (kinds[order] % TWICE), head)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot_of(key[head[entries > hot]])))], ["slot"])

    sent = docs.select("doc", "text").mapInArrow(lean(send), "bucket long, kind int, keys binary, docs binary, kinds binary")
    dealt = sent.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    hots = dealt.mapInArrow(hot_slots, "slot long").distinct().select("slot", F.lit(HOT_BIT).alias("mark"))  # SLOTS rows at most
    pairs = dealt.mapInArrow(lean(meet), "doc long, key long, slot long").join(F.broadcast(hots), "slot", "left")
    return pairs.groupBy("doc").agg(F.collect_list(F.col("key") + F.coalesce("mark", F.lit(0))).alias("keys"))


def window_minima(key: np.ndarray, data: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct segments of one key or several, in order of keys -> for each window, segment by segment, the least document that has it.

    The segments of a key, each closed by a 1, make a text closed by a 0; windows with equal bytes are neighbours in
    its suffix array.
    """
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    head = grouped(key)
    count = np.diff(np.append(head, len(key)))
    alone = np.repeat(count == 1, count)
    if alone.any():
        # a text of one segment has nothing to be put in order: only its own document has its windows
        out, many = np.repeat(doc, size - LENGTH + 1), np.flatnonzero(~alone)
        if len(many):
            first = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
            out[ranges(first[many], (size - LENGTH + 1)[many])] = window_minima(key[many], data[ranges(starts[many], size[many])], np.cumsum(size[many]), doc[many])
        return out
    family = np.repeat(np.arange(len(head)), count)
    # where each segment begins in the texts: after the bytes, the ones and the zeros before it
    begin = starts + np.arange(len(key)) + family
    text = np.ones(int(ends[-1]) + len(key) + len(head), np.int64)
    text[ranges(begin, size)] = data.astype(np.int64) + 2
    close = np.append(begin[head[1:]], len(text)) - 1
    text[close] = 0
    opened = np.concatenate(([0], close[:-1] + 1))
    windows = size - LENGTH + 1
    valid = np.full(len(text), -1, np.int64)
    valid[ranges(begin, windows)] = np.arange(int(windows.sum()))
    where = ranges(starts, windows)
    owner = np.repeat(doc, windows)
    out = np.empty(len(where), np.int64)
    # texts of about one length are sorted together, so that they advance in step
    length = close + 1 - opened
    order = np.argsort(length, kind="stable")
    total = np.cumsum(length[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, side="right")))
        some = order[a:b]
        spot = ranges(opened[some], length[some])
        upto = np.cumsum(length[some])
        sorted_ = valid[spot[suffix_arrays(text[spot], upto - length[some], upto)]]
        of = np.repeat(some, length[some])[sorted_ >= 0]
        w = sorted_[sorted_ >= 0]
        if len(w):
            fresh = np.diff(of, prepend=-1) != 0
            fresh[1:] |= ~equal_spans(data, where[w[:-1]], where[w[1:]], LENGTH)
            same = np.flatnonzero(fresh)
            out[w] = np.repeat(np.minimum.reduceat(owner[w], same), np.diff(np.append(same, len(w))))
        a = b
    return out


def least_documents(key: np.ndarray, data: np.ndarray, size: np.ndarray, doc: np.ndarray, k: int = K, limit: int = LONG) -> np.ndarray:
    """Segments, one after another in data -> for each of their windows, segment by segment, the least document of its key's that has it.

    Equal segments are one. A key whose segments come to over `limit` bytes is split by the minimisers of longer strings.
    """
    ends = np.cumsum(size)
    order, head = distinct(key, doc, data, ends - size, size)
    one, count = order[head], np.diff(np.append(head, len(order)))
    d_key, d_doc, d_size, d_start = key[one], doc[one], size[one], (ends - size)[one]
    windows = d_size - LENGTH + 1
    first = np.cumsum(windows) - windows
    family = grouped(d_key)
    weight, members = np.add.reduceat(d_size, family), np.diff(np.append(family, len(d_key)))
    least = np.empty(int(windows.sum()), np.int64)
    long = np.repeat((weight > limit) & (members > 1), members) if k in FINER else np.zeros(len(d_key), bool)
    # keys with about as many bytes are taken together, so that their texts advance in step
    plain = family[~long[family]]
    many = members[~long[family]]
    by = np.argsort(weight[~long[family]], kind="stable")
    for a, b in slices(np.concatenate(([0], np.cumsum(weight[~long[family]][by]))), AT_ONCE):
        some = ranges(plain[by[a:b]], many[by[a:b]])
        least[ranges(first[some], windows[some])] = window_minima(d_key[some], data[ranges(d_start[some], d_size[some])], np.cumsum(d_size[some]), d_doc[some])
    if long.any():
        some = np.flatnonzero(long)
        part = data[ranges(d_start[some], d_size[some])]
        at = np.concatenate(([0], np.cumsum(d_size[some])))
        start, n, finer, of = segments(part, at, FINER[k])
        text = part[ranges(start, n + LENGTH - 1)]
        found = least_documents(mix(d_key[some][of] ^ mix(finer)), text, n + LENGTH - 1, d_doc[some][of], FINER[k], limit)
        least[ranges(first[some[of]] + start - at[of], n)] = found
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(head)), count)
    return least[ranges(first[entry], size - LENGTH + 1)]


RUN = np.dtype([("tie", "<i8"), ("start", "<i4"), ("n", "<i4")])
OF_DOC = np.dtype([("doc", "<i8"), *RUN.descr])


def window_runs(least: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows, segment by segment with n each, the runs that an earlier document has: segment, first window in it, number."""
    owner, at = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
    gone = rank(least) < rank(doc)[owner]
    edge = np.flatnonzero(gone & ~(np.concatenate(([False], gone[:-1])) & (at > 0)))
    stop = np.flatnonzero(gone & ~np.concatenate((gone[1:] & (at[1:] > 0), [False])))
    return owner[edge], at[edge], stop - edge + 1


def earlier_windows(docs: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    """(doc, tie, text) with their shared keys -> (doc, runs): blobs of (tie, first window, number of windows) that an earlier document has."""
    limit = LONG
    names = ["bucket", "doc", "runs", "n", "n_bytes", "packed"]
    schema = "bucket long, doc long, runs binary, n long, n_bytes long, packed binary"

    def run_rows(doc, tie, start, n) -> pa.RecordBatch:
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        runs = np.empty(len(doc), RUN)
        runs["tie"], runs["start"], runs["n"] = tie[order], start[order], n[order]
        head = grouped(doc)
        blob = binary_rows(runs, np.diff(np.append(head, len(doc))))
        bucket, zero = by_bucket(doc[head].view(np.uint64), buckets), pa.array(np.zeros(len(head), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(doc[head]), blob, zero, zero, pa.array([b""] * len(head), pa.binary())], names)

    def packed_runs(doc, tie, start, n) -> pa.RecordBatch:
        """What a task found, a value for each bucket of documents: as many rows as there are buckets, whatever the documents."""
        runs, bucket = np.empty(len(doc), OF_DOC), by_bucket(doc.view(np.uint64), buckets)
        order = np.argsort(bucket, kind="stable")
        for name, values in (("doc", doc), ("tie", tie), ("start", start), ("n", n)):
            runs[name] = values[order]
        head = grouped(bucket[order])
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][head]), binary_rows(runs, np.diff(np.append(head, len(doc))))], ["bucket", "runs"])

    def blob_rows(key, doc, tie, start, size, data) -> pa.RecordBatch:
        at = np.cumsum(size) - size
        bucket = by_bucket(key, buckets)
        own = np.argsort(bucket, kind="stable")
        bucket, blobs = bucket[own], []
        head = grouped(bucket)
        upto, weight = np.append(head, len(own)), np.add.reduceat(size[own], head)
        for x, y in zip(upto[:-1].tolist(), upto[1:].tolist()):
            some = own[x:y]
            blobs.append(packed(key[some], doc[some], tie[some], start[some], size[some], data[ranges(at[some], size[some])]))
        nothing = pa.array([b""] * len(head), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(np.zeros(len(head), np.int64)), nothing, pa.array(np.diff(upto)), pa.array(weight), pa.array(blobs, pa.binary())], names)

    def flush(key, doc, tie, start, size, data) -> Iterator[pa.RecordBatch]:
        """Equal segments of a task are one entry, of their earliest document; those of later ones need no other answer."""
        at = np.cumsum(size) - size
        order, head = distinct(key, rank(doc), data, at, size)
        least = np.repeat(rank(doc)[order[head]], np.diff(np.append(head, len(order))))
        later = order[rank(doc)[order] > least]
        if len(later):
            yield run_rows(doc[later], tie[later], start[later], (size - LENGTH + 1)[later])
        own = rank(doc)[order] == least
        fresh = np.zeros(len(order), bool)
        fresh[head] = True
        own = np.sort(order[own & (fresh | (least > NULLS))])  # rows without doc_id get no answer: one is enough
        yield blob_rows(key[own], doc[own], tie[own], start[own], size[own], data[ranges(at[own], size[own])])

    def flush_hot(key, doc, tie, start, size, data) -> Iterator[pa.RecordBatch]:
        """Of a hot key the task tells what earlier documents of its own have, and sends the windows that none of these has, each by itself."""
        n = size - LENGTH + 1
        least = least_documents(key, data, size, rank(doc), limit=limit)
        of, at, many = window_runs(least, doc, n)
        if len(of):
            yield run_rows(doc[of], tie[of], start[of] + at, many)
        owner, shift = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
        own = np.flatnonzero(least == rank(doc)[owner])
        if not len(own):
            return
        owner, shift = owner[own], shift[own]
        begin = (np.cumsum(size) - size)[owner] + shift
        window = mix(np.concatenate([span_hashes(prefix_sums(data[begin[a] : begin[b - 1] + LENGTH]), begin[a:b] - begin[a], begin[a:b] - begin[a] + LENGTH) for a, b in slices(np.append(begin, len(data)), AT_ONCE)]))
        for a in range(0, len(own), 4 * AT_ONCE // LENGTH):
            some = slice(a, a + 4 * AT_ONCE // LENGTH)
            part = ranges(begin[some], np.full(len(begin[some]), LENGTH))
            yield from flush(window[some], doc[owner[some]], tie[owner[some]], start[owner[some]] + shift[some], np.full(len(begin[some]), LENGTH), data[part])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {False: [], True: []}
        weight = {False: 0, True: 0}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "tie"))
            lists = batch.column("keys")
            upto = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            every = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in slices(offsets, AT_ONCE):
                part, begin = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, count, key, owner = segments(part, begin)
                mine = every[upto[a] : upto[b]]
                known, is_hot = mine & LOW48, mine > LOW48
                which = np.repeat(np.arange(b - a), np.diff(upto[a : b + 1]))
                mark = mix(known ^ mix(which.astype(np.uint64)))
                asked = mix((key & LOW48) ^ mix(owner.astype(np.uint64)))
                shared, hot = np.isin(asked, mark), np.isin(asked, mark[is_hot])
                for flag, some in ((False, np.flatnonzero(shared & ~hot)), (True, np.flatnonzero(hot))):
                    if len(some):
                        size = count[some] + LENGTH - 1
                        who = owner[some]
                        held[flag].append((key[some], ids[a:b][who], ties[a:b][who], start[some] - begin[who], size, part[ranges(start[some], size)]))
                        weight[flag] += int(size.sum())
                        if weight[flag] >= 8 * GATHER:  # bytes
                            yield from (flush_hot if flag else flush)(*(np.concatenate(x) for x in zip(*held[flag])))
                            held[flag], weight[flag] = [], 0
        for flag, parts in held.items():
            if parts:
                yield from (flush_hot if flag else flush)(*(np.concatenate(x) for x in zip(*parts)))

    def answers(parts: list[dict]) -> Iterator[tuple]:
        """Runs of whole keys of one or several buckets, so many bytes of segments at a time."""
        key, doc, tie, start, size, data = (np.concatenate(x) for x in zip(*[unpacked(p["packed"], p["n"], p["n_bytes"]) for p in parts]))
        at, order = np.cumsum(size) - size, np.argsort(key, kind="stable")
        head = grouped(key[order])
        count, weight = np.diff(np.append(head, len(order))), np.add.reduceat(size[order], head)
        for a, b in slices(np.concatenate(([0], np.cumsum(weight))), TOGETHER):
            some = order[ranges(head[a:b], count[a:b])]
            least = least_documents(key[some], data[ranges(at[some], size[some])], size[some], rank(doc[some]), limit=limit)
            of, first, many = window_runs(least, doc[some], size[some] - LENGTH + 1)
            if len(of):
                yield doc[some[of]], tie[some[of]], start[some[of]] + first, many

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few buckets together, so that many texts advance in step; what the tasks told themselves joins the answers."""
        parts, weight, held, n = [], 0, [], 0

        def found() -> Iterator[tuple]:
            nonlocal parts, weight
            for rows in by_buckets(batches):
                sent = np.array(rows.column("n").to_pylist()) > 0
                told = rows.filter(pa.array(~sent))
                if len(told):
                    blobs = told.column("runs").to_pylist()
                    runs = np.frombuffer(b"".join(blobs), RUN)
                    yield np.repeat(told.column("doc").to_numpy(), [len(b) // RUN.itemsize for b in blobs]), runs["tie"], runs["start"].astype(np.int64), runs["n"].astype(np.int64)
                own = rows.filter(pa.array(sent)).select(["n", "n_bytes", "packed"]).to_pylist()
                parts += own
                weight += sum(p["n_bytes"] for p in own)
                if weight >= TOGETHER:
                    yield from answers(parts)
                    parts, weight = [], 0
            if parts:
                yield from answers(parts)

        for some in found():
            held.append(some)
            n += len(some[0])
            if n >= HELD:
                yield packed_runs(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield packed_runs(*(np.concatenate(x) for x in zip(*held)))

    sent = docs.join(answered, "doc").select("doc", "tie", "text", "keys").mapInArrow(lean(send), schema)
    met = sent.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "bucket long, runs binary")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All runs of a bucket's documents, a row a document."""
        for rows in by_buckets(batches):
            runs = np.frombuffer(b"".join(rows.column("runs").to_pylist()), OF_DOC)
            runs = runs[np.argsort(runs["doc"], kind="stable")]
            head, bare = grouped(runs["doc"]), np.empty(len(runs), RUN)
            for name in RUN.names:
                bare[name] = runs[name]
            yield pa.RecordBatch.from_arrays([pa.array(runs["doc"][head]), binary_rows(bare, np.diff(np.append(head, len(runs))))], ["doc", "runs"])

    return met.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(spread), "doc long, runs binary")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept binary): every byte covered by a LENGTH-byte string that
    also starts in a document with a smaller doc_id is removed; strings are judged on the input.

    One row for each input row. Null texts are empty; a null doc_id comes before all others; rows with equal doc_ids do
    not remove each other's bytes (nor do null ones); other columns are ignored; kept may end within a character, so it is
    binary; an empty table gives an empty one. A text is worked on at once, in about 60 bytes for each of its own. Ids
    under -2**62 are an error.
    """
    buckets = partitions(docs.sparkSession)  # a hash deals them evenly; larger values compress better than more of them
    text = F.coalesce("text", F.lit(""))
    known = F.col("doc_id").cast("long")
    without = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(-(2**63))
    if not docs.filter(known < NULLS).isEmpty():  # a filter that Parquet's statistics answer
        raise ValueError("doc_ids under -2**62 are not supported")
    doc = F.coalesce(known, without)
    rows = docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(text).alias("tie"))
    runs = earlier_windows(rows, shared_keys(rows, buckets, hot), buckets)
    joined = rows.join(runs, "doc", "left").select("doc", "tie", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ties, runs = batch.column("tie").to_pylist(), batch.column("runs")
            for a, b in slices(offsets, 4 * AT_ONCE):
                removed, spans, kept = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), []
                for i in range(a, b):
                    raw = data[offsets[i] : offsets[i + 1]]
                    run = np.frombuffer(runs[i].as_py(), RUN) if runs[i].is_valid else np.zeros(0, RUN)
                    run = run[run["tie"] == ties[i]]
                    if len(run):
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, run["start"], 1)
                        np.add.at(edge, run["start"] + run["n"] + LENGTH - 1, -1)
                        away = np.cumsum(edge)[:-1] > 0
                        removed[i - a], spans[i - a] = away.sum(), (away & ~np.concatenate(([False], away[:-1]))).sum()
                        raw = raw[~away]
                    kept.append(raw.tobytes())
                columns = [batch.column("doc").slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(lean(cut), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") >= NULLS, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
