"""Near-duplicates by a chosen-path similarity join: trees whose nodes branch documents by selected minwise tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, NOT_SPACE, lean, mix, partitions, prefix_sums, ranges, slices, span_hashes, stored, table, utf8, word_spans
from tessera.llm.components import components

WORDS, LEAST = 4, 80
#: Minwise tokens of a document; a node branches by some of them. Their low bytes tell likely pairs from others.
TOKENS = 128
#: Independent trees; nodes of the first LEVELS levels select two tokens each, further ones one, and every fourth of them two.
#: Two documents of a similarity of 0.8 share 1.6 children of a node of the first kind on average and one of the second, so
#: after the first levels a tree has lost 1 of 16 such pairs at most, five trees one in a million.
TREES, LEVELS = 5, 2
#: A node of so many documents and shingles at most is compared exhaustively by one task.
SMALL, SHINGLES = 4096, 1 << 22
#: Bits of the hashes by which sieves keep most rows that are not asked for out of an exchange.
SIEVE = 18
#: A pair's share of equal tokens may lie so many standard deviations under the similarity asked for.
DEVIATIONS = 5
#: Documents that a task compares with one head in a row.
RUN = 256
SLICE = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, ascending, and the offsets of the texts' sets. Fewer words: the whole sequence is one."""
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    start, end, counts = word_spans(data, offsets, NOT_SPACE)
    hashes = span_hashes(prefix_sums(data), start, end)
    n = np.where(counts > 0, np.maximum(1, counts - words + 1), 0)
    at = ranges(np.cumsum(counts) - counts, n)
    doc = np.repeat(np.arange(len(n)), n)
    length = np.minimum(counts, words)[doc].astype(np.uint64)
    out = mix(length + np.uint64(77))
    for j in range(words):
        more = np.uint64(j) < length
        out = np.where(more, mix(out * np.uint64(3) + hashes[np.minimum(at + j, max(0, len(hashes) - 1))]), out) if len(at) else out
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])] if len(out) else np.zeros(0, bool)
    return out[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(n)))].astype(np.int64)


def minwise(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens (32 bits) of each non-empty set."""
    k = np.arange(TOKENS, dtype=np.uint64)
    odd, shift = mix(k + np.uint64(11)) | np.uint64(1), mix(k + np.uint64(1 << 40))
    out = np.zeros((len(at) - 1, TOKENS), np.uint64)
    some = np.flatnonzero(np.diff(at))
    for i in range(TOKENS if len(some) else 0):
        out[some, i] = np.minimum.reduceat(hashes * odd[i] + shift[i], at[some])
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text, hash): what tells the texts of a repeated doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))


def with_sets(docs: DataFrame, words: int, *kept: str) -> DataFrame:
    """(doc_id, text, hash, kept) -> (doc_id, hash, n_shingles, key, tokens, bits, kept): key is 128 bits of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                hashes, at = shingle_sets(data, offsets[a : b + 1], words)
                tokens = minwise(hashes, at)
                keys = [xxhash.xxh3_128_digest(hashes[x:y].tobytes()) if y > x else None for x, y in zip(at, at[1:])]
                blobs = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(at)), pa.array(keys, pa.binary()), blobs(tokens), blobs(tokens.astype(np.uint8)), *(batch.column(c).slice(a, b - a) for c in kept)], ["doc_id", "hash", "n_shingles", "key", "tokens", "bits", *kept])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select("doc_id", "text", "hash", *kept).mapInArrow(lean(run), "doc_id long, hash long, n_shingles long, key binary, tokens binary, bits binary" + more)


def classes_of(sets: DataFrame, *more: Column) -> DataFrame:
    """with_sets() -> a row for each distinct set, empty ones left out, with an id of its own."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    classes = sets.filter("key is not null").groupBy("key").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"), *more)
    return stored(classes.select(F.monotonically_increasing_id().alias("id"), "key", "first.doc_id", "first.hash", *classes.columns[2:]), "classes")


def sifted(rows: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be among the values asked for, by their hashes: 2**SIEVE of them at most are broadcast, whatever the number of values. None is lost."""
    mark = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE))
    return rows.withColumn("_mark", mark).join(F.broadcast(asked.select(mark.alias("_mark")).distinct()), "_mark", "left_semi").select(rows.columns)


def branched(members: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """(node, id, n_shingles) -> the members of the nodes' children, also numbered k by how they branched. Level 0: `classes` branch from the roots of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(n, TOKENS).astype(np.uint64)
            nodes, rows, numbers = [], [], []
            for j in range(2 * TREES if not level else 2):
                if not level:
                    node, position, chosen = np.full(n, mix(np.array([j + 1], np.uint64))[0]), np.full(n, j), np.ones(n, bool)
                else:
                    parent = batch.column("node").to_numpy().view(np.uint64)
                    node = mix(parent * np.uint64(2) + np.uint64(j + 1))
                    position = ((node >> np.uint64(40)) % np.uint64(TOKENS)).astype(np.int64)
                    chosen = np.full(n, level < LEVELS or not j) | (mix(parent) % np.uint64(4) == 0)
                child = mix(node + tokens[np.arange(n), position] * np.uint64(0x9E3779B97F4A7C15))
                nodes.append(child[chosen])
                rows.append(np.flatnonzero(chosen))
                numbers.append(np.full(int(chosen.sum()), j))
            taken = [batch.column(c).take(pa.array(np.concatenate(rows))) for c in ("id", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), *taken, pa.array(np.concatenate(numbers), pa.int32())], ["node", "id", "n_shingles", "k"])

    of = classes.select("id", "n_shingles", "tokens")
    rows = of if not level else members.select("node", "id").hint("merge").join(of, "id")
    return rows.mapInArrow(lean(run), "node long, id long, n_shingles long, k int")


def likely(pairs: DataFrame, classes: DataFrame, least_equal: int) -> DataFrame:
    """(a, b) whose tokens are equal at `least_equal` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), TOKENS) for c in ("x", "y"))
            keep = np.flatnonzero((x == y).sum(axis=1) >= least_equal)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    bits = classes.select("id", "bits")
    both = pairs.hint("merge").join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").hint("merge").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(name).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(name)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, labels and homes of the rows of a node."""
    homes = rows.column("homes").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    return rows.column("node")[0].as_py(), rows.column("label").to_numpy(), homes


def here(node: int, homes: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Which pairs of row i are compared in this node: those that have no earlier small node of level 0 in common."""
    common = (homes[among] == homes[i]) & (homes[i] != 0)
    return ~common.any(axis=1) | (homes[i][common.argmax(axis=1)] == node)


def active(members: DataFrame, classes: DataFrame, least_equal: int) -> DataFrame:
    """(node, id, label, homes) of small nodes -> those rows that have a likely partner of another label to be compared with in this node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "node"):
            node, labels, homes = columns(rows)
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(rows), TOKENS)
            keep = np.zeros(len(rows), bool)
            for i in range(len(rows) - 1):
                among = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
                among = among[(bits[among] == bits[i]).sum(axis=1) >= least_equal]
                among = among[here(node, homes, i, among)]
                keep[among] = True
                keep[i] |= len(among) > 0
            yield from rows.select(["node", "id", "label", "homes"]).filter(pa.array(keep)).combine_chunks().to_batches()

    rows = members.hint("merge").join(classes.select("id", "bits"), "id").select("node", "id", "label", "homes", "bits")
    dealt = rows.repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node")
    return dealt.mapInArrow(lean(run), "node long, id long, label long, homes array<long>")


def linked(node: int, labels: np.ndarray, homes: np.ndarray, hashes: np.ndarray, at: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Pairs of a node's members that join all that are alike, counted on full sets; of members that are joined already no further pair is counted."""
    where = np.unique(hashes, return_inverse=True)[1]
    sizes, parts = np.diff(at), np.unique(labels, return_inverse=True)[1]
    mark = np.zeros(len(hashes) + 1, bool)
    first, second = [], []
    for i in range(len(sizes) - 1):
        among = i + 1 + np.flatnonzero(parts[i + 1 :] != parts[i])
        among = among[100 * np.minimum(sizes[among], sizes[i]) >= least * np.maximum(sizes[among], sizes[i])]
        among = among[here(node, homes, i, among)]
        own = where[at[i] : at[i + 1]]
        mark[own] = True
        for a in range(0, len(among), 256):
            some = among[a : a + 256]
            same = np.add.reduceat(mark[where[ranges(at[some], sizes[some])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[100 * same >= least * (sizes[some] + sizes[i] - same)].tolist():
                if parts[j] != parts[i]:
                    first.append(i)
                    second.append(j)
                    parts[parts == parts[j]] = parts[i]
        mark[own] = False
    return first, second


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, docs: DataFrame, words: int, least: int) -> DataFrame:
    """Links confirmed on full sets, with `least` percent of their union in common or more: of (a, b), and within the nodes of active() rows.

    The texts are fetched once for all. Pairs are dealt to heads, their first members; a head of many pairs is given to
    several tasks, RUN of its pairs each, which hold the head's set beside the text that they compare. A node goes to one
    task, which holds its sets: SHINGLES hashes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "grp"):
            ids = group.column("id").to_numpy()
            first, second = [], []
            if group.column("star")[0].as_py():
                texts, head = group.column("text"), None
                data, offsets = utf8(texts)
                for a, b in slices(offsets, SLICE):
                    hashes, at = shingle_sets(data, offsets[a : b + 1], words)
                    for i in range(a, b):
                        own = hashes[at[i - a] : at[i - a + 1]]
                        if head is None:
                            head = own
                            continue
                        found = np.searchsorted(head, own)
                        same = int((head[np.minimum(found, len(head) - 1)] == own).sum())
                        if 100 * same >= least * (len(head) + len(own) - same):
                            first.append(0)
                            second.append(i)
            else:
                data, offsets = utf8(group.column("text"))
                parts = [shingle_sets(data, offsets[a : b + 1], words) for a, b in slices(offsets, SLICE)]
                at = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]
                first, second = linked(*columns(group), np.concatenate([p[0] for p in parts]), at, least)
            pair = ids[np.array(first, np.int64)], ids[np.array(second, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

    none = F.array().cast("array<long>")
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    star = lambda a, run, member: F.struct(F.xxhash64(a, run).alias("grp"), F.lit(True).alias("star"), F.lit(member).alias("member"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("label"), none.alias("homes"))
    members = pairs.hint("merge").join(runs, "a").select(F.col("b").alias("id"), star(F.col("a"), F.pmod(F.xxhash64("b"), F.col("runs")).cast("int"), True).alias("place"))
    heads = runs.select(F.col("a").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda i: star(F.col("a"), i, False))).alias("place"))
    inside = rows.select("id", F.struct(F.xxhash64("node", F.lit("node")).alias("grp"), F.lit(False).alias("star"), F.lit(True).alias("member"), "node", "label", "homes").alias("place"))
    places = stored(members.unionAll(heads).unionAll(inside).hint("merge").join(classes.select("id", "doc_id", "hash"), "id"), "places")
    texts = sifted(docs, places, "hash").select(F.col("doc_id").alias("of"), F.col("hash").alias("text_hash"), "text")
    # always dealt by key: the places grow with the documents, so a broadcast would only work while they are few
    found = places.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("text_hash"))).select("place.*", "id", "text")
    dealt = found.repartition(partitions(pairs.sparkSession), "grp").sortWithinPartitions("grp", "member", "id")
    return dealt.mapInArrow(lean(run), "a long, b long")


def least_equal_tokens(least: int) -> int:
    share = least / 100
    return max(1, int(TOKENS * share - DEVIATIONS * (TOKENS * share * (1 - share)) ** 0.5))


def links(classes: DataFrame, docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(id, n_shingles, doc_id, hash, tokens, bits) of distinct sets -> (a, b): enough links to join all that are alike, every one confirmed on full sets.

    Level by level: a small node is compared exhaustively by one task, each pair in one of its nodes. The members of a large
    one are compared with one of them, which links a family of any size by as many pairs as it has members; if they are
    not all linked then, the node branches. Levels go on until no node is left.
    """
    enough = least_equal_tokens(least)
    members = stored(branched(classes, classes, 0), "members")
    homes = labels = found = None
    level = 0
    while True:
        heads = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("sum"), F.min_by("id", F.col("id") if not level else F.xxhash64("id", "node")).alias("head")).filter("n > 1")
        met = stored(members.hint("merge").join(heads.select("node", "head", ((F.col("n") <= SMALL) & (F.col("sum") <= SHINGLES)).alias("small")), "node"), "met")
        small, large = met.filter("small"), met.filter("not small")
        if homes is None:  # the small nodes of level 0 of each document, by the numbers of their trees
            homes = stored(small.groupBy("id").agg(F.array(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("node"))), F.lit(0)) for k in range(2 * TREES)]).alias("homes")), "homes")
        rows = small.select("node", "id").hint("merge").join(homes, "id", "left").withColumn("homes", F.coalesce("homes", F.array_repeat(F.lit(0).cast("long"), 2 * TREES)))
        rows = rows.withColumn("label", F.col("id")) if labels is None else rows.hint("merge").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        pairs = large.filter("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
        ready, busy = stored(likely(pairs, classes, enough), "likely"), stored(active(rows.select("node", "id", "label", "homes"), classes, enough), "active")
        new = stored(verified(ready, busy, classes, docs, words, least), "links")
        found = new if found is None else found.unionAll(new)
        if large.isEmpty():
            return found
        labels = stored(components(found).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
        tagged = large.select("node", "id").hint("merge").join(labels, "id", "left").select("node", "id", F.coalesce("label", "id").alias("label"))
        mixed = tagged.groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("node")
        level += 1
        left = stored(tagged.hint("merge").join(mixed, "node").select("node", "id"), "left")
        classes = stored(sifted(classes, left, "id"), "classes")  # only these come to deeper levels
        members = stored(branched(left, classes, level), "members")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id (the smallest doc_id reachable), kept: a row for each row.

    Documents of equal sets are one member of the trees. Texts without words (null, empty, white space) have no shingle
    and are linked with nothing. Rows of a repeated doc_id are documents of their own with one name. A null doc_id names
    no component unless nothing else is in it. Other columns are ignored; an empty table gives an empty one. Texts
    are taken whole, however long.
    """
    rows = identified(docs)
    sets = stored(with_sets(rows, words), "sets")
    classes = classes_of(sets)
    named = components(links(classes, rows, words, least)).withColumnRenamed("node", "id")
    parts = classes.select("id", "key", "doc_id").join(named, "id", "left").select("key", "doc_id", F.coalesce("component", "id").alias("component"))
    parts = parts.join(parts.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("key", "component_id")
    linked = sets.filter("key is not null").select("doc_id", "n_shingles", "key").join(parts, "key").select("doc_id", "n_shingles", "component_id")
    alone = sets.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))
