"""Merkle manifest of a table: a leaf a row, a tree of fan-out 8 a language, a tree over the languages, proofs for all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, lean, partitions, stored, table

FAN = 8
#: A task walks aligned blocks of so many levels, 512 leaves; their roots are the leaves of the next distributed walk.
LEVELS = 3

STEP = "array<struct<left string, right string>>"  # a node's siblings, level by level, before and after it


def digest(*parts: str) -> str:
    """H: lowercase hex sha256 of the inputs, concatenated; digests are inputs as hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int, most: int) -> int:
    """Levels above n nodes, those of a block at most."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def walked(leaves: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a block and the siblings of each of its leaves, lowest level first.

    Post order: a subtree returns its digest, and while the recursion unwinds the siblings of each child are appended to
    the leaves that the child contains.
    """
    trails: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def subtree(low: int, high: int, level: int) -> str:
        if not level:
            return leaves[low]
        width = FAN ** (level - 1)
        spans = [(a, min(a + width, high)) for a in range(low, high, width)]
        roots = [subtree(a, b, level - 1) for a, b in spans]
        for i, (a, b) in enumerate(spans):
            siblings = "".join(roots[:i]), "".join(roots[i + 1 :])
            for trail in trails[a:b]:
                trail.append(siblings)
        return digest(*roots)

    return subtree(0, len(leaves), levels), trails


def field(col: Column | str) -> Column:
    """`-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): grp orders languages as text does, with null first; tampered is null where nothing was tampered with."""
    leaf = lambda text: F.sha2(F.concat(field("doc_id"), field("source"), field("lang"), field("n_chars"), field(text)), 256)
    struck = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    grp = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf("text").alias("leaf"), F.when(struck, leaf(ascii_lower(F.col("text")))).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with grp -> also n, rows of the group, and pos, the row's place in it by `order`.

    One range exchange by group and order, so a group of any size is many tasks; of each task and group only a count goes on.
    """
    sort = ["grp", *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "numbered")
    counts = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return dealt.join(places, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks_of(nodes: DataFrame, levels: int, *payload: str) -> DataFrame:
    """(grp, n, pos, digest) -> (grp, n, block, nodes): the consecutive nodes of a block in one row, in order."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    return stored(nodes.groupBy("grp", "n", F.floor(F.col("pos") / FAN**levels).alias("block")).agg(packed.alias("nodes")), "blocks")


def roots_of(blocks: DataFrame, levels: int) -> DataFrame:
    """The nodes of the walk above: (grp, n, pos, digest), one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            out = [walked(leaves, levels_of(m, levels))[0] for leaves, m in zip(batch.column("leaves").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([-(-m // FAN**levels) for m in n], pa.int64()), batch.column("block"), pa.array(out, pa.string())], ["grp", "n", "pos", "digest"])

    return stored(blocks.select("grp", "n", "block", F.col("nodes")["digest"].alias("leaves")).mapInArrow(lean(run), "grp string, n long, pos long, digest string"), "roots")


def climbed(nodes: DataFrame, levels: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all walks, lowest first, and (grp, digest): a root for each group. A walk leaves a node for each block."""
    tables = [blocks_of(nodes, levels, *payload)]
    roots = roots_of(tables[0], levels)
    while not roots.filter("n > 1").isEmpty():
        tables.append(blocks_of(roots, levels))
        roots = roots_of(tables[-1], levels)
    return tables, roots.select("grp", "digest")


def descended(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Siblings of each block's nodes up to the root, for the walk below: (grp, pos, trail, subroot, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for grp, n, leaves, at, trail, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "leaves", "first", "trail", "subroot", "root"))):
                upper = [(x["left"], x["right"]) for x in trail]
                out += [(grp, at + i, [{"left": a, "right": b} for a, b in own + upper], subroot, root) for i, own in enumerate(walked(leaves, levels_of(n, levels))[1])]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])), pa.string(), pa.string()]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["grp", "pos", "trail", "subroot", "root"])

    first = F.col("nodes")[0]["pos"].alias("first")
    joined = blocks.withColumnRenamed("block", "pos").join(above, ["grp", "pos"]).select("grp", "n", F.col("nodes")["digest"].alias("leaves"), first, "trail", "subroot", "root")
    return stored(joined.mapInArrow(lean(run), f"grp string, pos long, trail {STEP}, subroot string, root string"), "trails")


def folded(leaf: str, trail: list[tuple[str, str]]) -> str:
    """Root that a leaf and the siblings on its way up give."""
    for left, right in trail:
        leaf = digest(left, leaf, right)
    return leaf


def proved(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """A row for each leaf, with the digest of its proof and the root that the tampered leaf gives."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, leaves, tampered, trail, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "leaves", "tampered", "trail", "subroot", "root"))):
                upper = [(x["left"], x["right"]) for x in trail]
                proofs, roots = [], []
                for own, leaf, changed in zip(walked(leaves, levels_of(n, levels))[1], leaves, tampered):
                    whole = own + upper
                    proofs.append(digest(*(x for both in whole for x in both)))
                    roots.append(folded(changed or leaf, whole))
                texts = [leaves, [subroot] * len(ids), [root] * len(ids), proofs, roots]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in texts), pa.array([x == root for x in roots], pa.bool_())], names)

    get = lambda c: F.col("nodes")[c]
    joined = blocks.withColumnRenamed("block", "pos").join(above, ["grp", "pos"]).select("n", get("doc_id").alias("ids"), get("digest").alias("leaves"), get("tampered").alias("tampered"), "trail", "subroot", "root")
    return joined.mapInArrow(lean(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row.

    A null field counts as `-`, so it differs from an empty one. Rows of a language are in order of doc_id, null first, those
    of a repeated doc_id in order of their leaves; a row without doc_id is never tampered with. A null language is a group
    of its own, before the others. Other columns are ignored; an empty table gives an empty one. Texts of any length
    are hashed whole by a native function.
    """
    rows = numbered(leaves_of(docs), "doc_id", "leaf").withColumnRenamed("leaf", "digest")
    below, subroots = climbed(rows, levels, "doc_id", "tampered")
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
    upper, root = climbed(tops, levels)
    above = root.select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast(STEP).alias("trail"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(upper):
        above = descended(blocks, above, levels)
    above = above.drop("grp", "subroot").join(tops.select("pos", F.col("name").alias("grp"), F.col("digest").alias("subroot")), "pos").withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(below[1:]):
        above = descended(blocks, above, levels)
    return proved(below[0], above, levels)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return manifest(table(spark, sf_dir, "documents"))


#: crc32 a bit at a time: each byte is eight steps, of which the first takes the byte in.
_CRC = "xor(CAST(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) AS BIGINT), 4294967295)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 8),
subroots AS MATERIALIZED (SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM upper WHERE n > 1 GROUP BY level, pos // 8),
steps AS MATERIALIZED (
  SELECT p.grp, p.pos AS leaf_pos, x.level, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS r
  FROM placed p JOIN nodes x ON x.grp = p.grp AND x.n > 1 AND x.pos = p.pos // CAST(pow(8, x.level) AS BIGINT) JOIN nodes y ON y.grp = x.grp AND y.level = x.level AND y.pos // 8 = x.pos // 8
  GROUP BY ALL
  UNION ALL
  SELECT p.grp, p.pos, s.height + x.level, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), ''), coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '')
  FROM placed p JOIN subroots s ON s.grp = p.grp JOIN upper x ON x.n > 1 AND x.pos = s.pos // CAST(pow(8, x.level) AS BIGINT) JOIN upper y ON y.level = x.level AND y.pos // 8 = x.pos // 8
  GROUP BY p.grp, p.pos, s.height, x.level),
proofs AS (SELECT grp, leaf_pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS trail FROM steps GROUP BY grp, leaf_pos),
walk AS (
  SELECT p.grp, p.pos, coalesce(p.tampered, p.leaf) AS h, coalesce(f.trail, []) AS trail FROM placed p LEFT JOIN proofs f ON f.grp = p.grp AND f.leaf_pos = p.pos
  UNION ALL
  SELECT grp, pos, sha256(trail[1].l || h || trail[1].r), trail[2:] FROM walk WHERE len(trail) > 0)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, coalesce(f.proof, sha256('')) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp JOIN walk w ON w.grp = p.grp AND w.pos = p.pos AND len(w.trail) = 0
  JOIN (SELECT h FROM upper WHERE n = 1) t ON true LEFT JOIN proofs f ON f.grp = p.grp AND f.leaf_pos = p.pos
"""
