"""Approximate nearest neighbours by balanced posting lists: boundary replicas, a graph over the centroids, distance-ratio pruning."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, partitions, stored, table

#: The index is fitted on at most SAMPLE vectors (by a hash of vec_id); every vector is indexed. Vectors a list aims at,
#: lists at most (or the root of the number of vectors, and no more than a quarter of the sample), rows of a block;
#: replicas of a boundary vector, the ratio of distances up to which it has them, how far apart centroids of one vector
#: are at least (as a share of its distance), links of a centroid, and how many lists are read before the others.
SAMPLE, LIST_SIZE, MOST_LISTS, BLOCK = 20_000, 512, 1024, 4096
REPLICAS, BOUNDARY, APART, DEGREE, FIRST = 2, 1.05, 0.3, 16, 4
#: The ratio of distances that prunes the lists of a query is measured: PROBES queries (by a hash of their row) are compared with all
#: vectors, and it is the one that brings RECALL of their neighbours.
PROBES, RECALL = 128, 0.95


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means in which a list over the mean size looks farther away, so sizes even out."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    push = np.zeros(k)
    for _ in range(rounds):
        d = distances(x, c) ** 2
        own = (d + push).argmin(1)
        size = np.bincount(own, minlength=k)
        push += 0.1 * d.min(1).mean() * (size / size.mean() - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = size > 0
        c[full] = sums[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class CentroidGraph:
    """Each centroid knows its nearest ones and the previous one; search walks best-first from node 0 until `width` nodes are settled."""

    def __init__(self, c: np.ndarray):
        self.c = c
        d = distances(c, c)
        near = np.argsort(d, axis=1)[:, 1 : DEGREE + 1]
        links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row[: DEGREE // 2]:
                links[j].add(i)
        for i in range(1, len(c)):  # a path through all: every node can be reached
            links[i].add(i - 1)
            links[i - 1].add(i)
        self.links = [np.array(sorted(s), np.int64) for s in links]

    def search(self, q: np.ndarray, ratio: float) -> list[tuple[float, int]]:
        """Centroids within `ratio` of the nearest found, nearest first: the walk goes on while it meets such nodes."""
        first = float(np.linalg.norm(self.c[0] - q))
        heap, seen, best, found = [(first, 0)], {0}, first, []
        stale = 0
        while heap:
            d, i = heapq.heappop(heap)
            found.append((d, i))
            best = min(best, d)
            stale = stale + 1 if d > best * ratio else 0
            if stale > 4 * DEGREE:
                break
            new = [j for j in self.links[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for e, j in zip(np.linalg.norm(self.c[new] - q, axis=1).tolist(), new):
                    heapq.heappush(heap, (e, j))
        return sorted(found)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that nearest by distance to a query of length `norm` is largest by inner product."""
    return np.concatenate((x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))[:, None]), axis=1)


def as_queries(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries beside lifted vectors: of length `norm`, which changes no order."""
    return np.concatenate((x * (norm / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))), axis=1) if len(x) else np.zeros((0, 0))


def pruning_ratio(asked: DataFrame, postings: DataFrame, centroids: np.ndarray, norm: float, k: int) -> float:
    """The least ratio of distances to the nearest centroid's at which the lists hold RECALL of the probes' k neighbours among all vectors.

    A neighbour needs the nearest of its lists. PROBES x k rows come to the driver at most.
    """
    some = asked.orderBy(F.xxhash64("vec_id", "row"), "row").limit(PROBES).select("v", "row").toArrow()
    if not len(some):
        return 1.0
    probes, rows = matrix(some.column("v").combine_chunks()), some.column("row").to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast((probes, rows))
    keep = k * (REPLICAS + 1)  # so many copies hold the k best rows of a task

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        held = [np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))]
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                lists, ids = part.column(0).to_numpy(), part.column(2).to_numpy()
                score = q @ matrix(part.column(1)).T
                score[own[:, None] == ids] = -np.inf
                both = [np.concatenate((h, np.broadcast_to(x, score.shape)), axis=1) for h, x in zip(held, (lists, ids, score))]
                top = np.argsort(-both[2], axis=1, kind="stable")[:, :keep]
                held = [np.take_along_axis(x, top, 1) for x in both]
        n = np.repeat(np.arange(len(q)), held[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(x.ravel()) for x in held)], ["probe", "list", "row", "score"])

    found = postings.select("list", "v", "row").mapInArrow(lean(best), "probe long, list long, row long, score double").filter("score > double('-inf')")
    each = found.groupBy("probe", "row").agg(F.max("score").alias("score"), F.collect_set("list").alias("lists"))
    nearest = each.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "row"))).filter(F.col("n") <= k)
    d = distances(as_queries(probes, norm), centroids)
    needed = [d[r.probe, r.lists].min() / max(d[r.probe].min(), 1e-300) for r in nearest.select("probe", "lists").collect()]
    shared.destroy()
    return float(np.quantile(needed, RECALL, method="higher")) * (1 + 1e-9) if needed else 1.0


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) without vectors that are null, zero, of another length than most (no inner product), or hold null or non-finite components."""
    v = F.col("embedding") if rows.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)  # in the type that is stored; scores are in double precision
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0").filter(fine)
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("v") == (usual[0]["n"] if usual else -1))


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by `every`.

    Every usable vector is indexed in its nearest lists and each query reads the lists within the pruning ratio (see
    pruning_ratio()), more of them until they hold k other vectors; scores are exact. Lists and the queries of a list are dealt in blocks, so a
    list that holds a third of all vectors is many tasks. Ties go to the smaller vec_id. Rows of a repeated vec_id are
    rows like any others, as queries and as candidates (of each other too). Null ids take no part, other columns are
    ignored, an empty table gives an empty one.
    """
    spark = rows.sparkSession
    good = stored(usable(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored, so that a row keeps its number
    norm, n = good.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    most = max(MOST_LISTS, min(int(n**0.5), SAMPLE // 4))
    centroids = balanced_centroids(lifted(sample, norm), int(np.clip(n // LIST_SIZE, 1, most)))
    shared = spark.sparkContext.broadcast((centroids, norm))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, top = shared.value
        among = distances(c, c)
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                d = distances(lifted(matrix(part.column(1)), top), c)
                order = np.argsort(d, axis=1)[:, : REPLICAS + 1]
                where, which = [np.arange(len(part))], [order[:, 0]]
                chosen = order[:, :1]
                for r in range(1, order.shape[1]):
                    nxt = order[:, r]
                    dist = np.take_along_axis(d, nxt[:, None], 1)[:, 0]
                    # near the boundary, and not behind a centroid that has it already
                    ok = (dist <= BOUNDARY * d.min(1)) & (among[nxt[:, None], chosen] >= dist[:, None] * APART).all(1)
                    where.append(np.flatnonzero(ok))
                    which.append(nxt[ok])
                    chosen = np.concatenate((chosen, np.where(ok, nxt, chosen[:, 0])[:, None]), 1)
                rows_, lists = np.concatenate(where), np.concatenate(which)
                primary = np.arange(len(rows_)) < len(part)
                taken = [part.column(c).take(pa.array(rows_)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(lists), taken[0], taken[1], taken[2], pa.array(primary)], ["list", "vec_id", "v", "row", "main"])

    kind = good.schema["v"].dataType.simpleString()
    postings = stored(good.select("vec_id", "v", "row").mapInArrow(lean(assign), f"list long, vec_id long, v {kind}, row long, main boolean"), "postings")
    sizes = {r["list"]: (r["n"], r["main"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("main").cast("int")).alias("main")).collect()}

    asked = good.filter(F.pmod("vec_id", F.lit(every)) == 0)
    ratio = pruning_ratio(asked, postings, centroids, norm, k)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, top = shared.value
        graph = CentroidGraph(c)
        for batch in batches:
            which, lists, turns = [], [], []
            x = matrix(batch.column(1))
            for i, q in enumerate(as_queries(x, top)):
                held, found = 0, graph.search(q, ratio)
                if sum(sizes.get(j, (0, 0))[1] for _, j in found) <= k:
                    found = [(0.0, j) for j in range(len(c))]
                for turn, (d, j) in enumerate(found):
                    if held > k and d > found[0][0] * ratio:
                        break
                    held += sizes.get(j, (0, 0))[1]
                    which.append(i)
                    lists.append(j)
                    turns.append(turn)
            taken = [batch.column(c).take(pa.array(which, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(turns, pa.int32()), *taken], ["list", "turn", "query_id", "q", "asker"])

    visits = stored(asked.repartition(partitions(spark), "row").select("vec_id", "v", "row").mapInArrow(lean(choose), f"list long, turn int, query_id long, q {kind}, asker long"), "visits")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "asker": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, x, own = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(np.float64), right["row"].to_numpy()
        queries, q, bound, asker = left["query_id"].to_numpy(), np.stack(left["q"].to_numpy()).astype(np.float64), left["bound"].to_numpy(), left["asker"].to_numpy()
        # how far the two ways to sum a product may be apart
        slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        out = []
        for a in range(0, len(q), 512):
            rough = q[a : a + 512] @ x.T
            rough[asker[a : a + 512, None] == own] = -np.inf
            least = np.maximum(np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))], bound[a : a + 512])
            i, j = np.nonzero((rough >= (least - slack[a : a + 512])[:, None]) & np.isfinite(rough))
            exact = np.concatenate([(q[a + i[s : s + 65536]] * x[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            order = np.lexsort((own[j], ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query_id": queries[a + i[keep]], "asker": asker[a + i[keep]], "vec_id": ids[j[keep]], "row": own[j[keep]], "score": exact[keep]}))
        return pd.concat(out)

    pair = ["query_id", "asker", "vec_id", "row"]

    def searched(visits: DataFrame) -> DataFrame:
        """Each visit's k best of its list that reach the query's bound."""
        # At most MOST_LISTS rows: into how many blocks each side of a list is dealt.
        blocks = visits.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs")).join(postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ps")), "list")
        q_side = visits.join(blocks, "list").withColumn("qb", F.pmod(F.xxhash64("asker"), F.col("qs")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("ps") - 1))).select("list", "qb", "pb", "query_id", "asker", "q", "bound")
        p_side = postings.join(blocks, "list").withColumn("pb", F.pmod(F.xxhash64("row"), F.col("ps")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("list", "qb", "pb", "vec_id", "row", "v")
        keys = ("list", "qb", "pb")
        found = q_side.groupBy(*keys).cogroup(p_side.groupBy(*keys)).applyInPandas(score, "query_id long, asker long, vec_id long, row long, score double")
        return found.groupBy(*pair).agg(F.max("score").alias("score"))  # a replica is no other row

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # The nearest lists give each query a score that its k-th neighbour reaches; the other lists return only what reaches it too.
    early = stored(best(searched(visits.filter(F.col("turn") < FIRST).withColumn("bound", F.lit(float("-inf"))))), "early")
    bound = early.filter(F.col("rank") == k).select("asker", F.col("score").alias("bound"))
    late = visits.filter(F.col("turn") >= FIRST).join(bound, "asker", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    both = early.select(*pair, "score").unionByName(searched(late)).groupBy(*pair).agg(F.max("score").alias("score"))
    return best(both).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings"))
