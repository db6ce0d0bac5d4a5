"""Running values of keys of any size, and deep pages.

Rows are sorted by one range exchange on key and order, so a key that has all rows is dealt over all tasks like any other.
Sorted rows are cut in blocks; a block has one row of composable summaries, and only these are scanned key by key. A
second pass adds to each row of a block what the key had before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import stored

#: Rows of a block are 2 to this power at most.
BLOCK_BITS = 16


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """Rows in order of key and `order` (total within a key), with _key, _at (ascending in that order) and _block. Nulls are a key like others."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["_key", *order]
    dealt = rows.withColumn("_key", F.struct(*keys)).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    kept = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "blocks")  # once: both passes must see the same blocks
    return kept.withColumn("_block", F.shiftright("_at", bits))


def _blockwise():
    return Window.partitionBy("_key", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)


def _earlier():
    return Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(rows: DataFrame, keys: list[str], order: list[str], bits: int = BLOCK_BITS, **values: Column) -> DataFrame:
    """Rows with the running sum of each value in the order of their key, the row itself included. F.lit(1) gives their number."""
    blocks = in_blocks(rows, keys, order, bits)
    local = blocks.withColumns({f"_{name}": F.sum(v).over(_blockwise()) for name, v in values.items()})
    sums = blocks.groupBy("_key", "_block").agg(*[F.sum(v).alias(name) for name, v in values.items()])
    before = sums.select("_key", "_block", *[F.sum(name).over(_earlier()).alias(f"_before_{name}") for name in values])
    whole = {name: F.coalesce(F.col(f"_before_{name}") + F.coalesce(f"_{name}", F.lit(0)), f"_before_{name}", f"_{name}") for name in values}
    return local.join(before, ["_key", "_block"]).withColumns(whole).select(*[c for c in rows.columns if c not in values], *values)


def running_slots(rows: DataFrame, keys: list[str], order: list[str], at: Column, gap: Column, name: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows with slot(k) = max(at(k), slot(k-1) + gap(k)), microseconds in the order of their key.

    It unrolls to G(k) + max over j <= k of at(j) - G(j), with G the running sum of gaps. A block's summary is the pair of
    its sum of gaps and its greatest at - G; pairs compose, so blocks are scanned like single rows.
    """
    blocks = in_blocks(rows, keys, order, bits).withColumns({"_own": gap.cast("long"), "_asked": at.cast("long")})
    w = _blockwise()
    local = blocks.withColumn("_gaps", F.sum("_own").over(w))
    local = local.withColumn("_lead", F.max(F.col("_asked") - F.col("_gaps")).over(w))
    pairs = local.groupBy("_key", "_block").agg(F.sum("_own").alias("_sum"), F.max("_lead").alias("_most"))
    pairs = pairs.withColumn("_before", F.coalesce(F.sum("_sum").over(_earlier()), F.lit(0)))
    pairs = pairs.select("_key", "_block", "_before", F.max(F.col("_most") - F.col("_before")).over(_earlier()).alias("_reach"))
    slot = F.col("_before") + F.col("_gaps") + F.greatest("_reach", F.col("_lead") - F.col("_before"))
    return local.join(pairs, ["_key", "_block"]).withColumn(name, slot).select(*[c for c in rows.columns if c != name], name)


class Ranked:
    """A table dealt in ranges of an order, from which any page is read by itself.

    Built by one exchange; then a page costs the one or two ranges that hold it, whatever its number. Counts of the
    ranges, a row each, are the only thing that the driver holds.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        """The order must be total."""
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.order, self.columns = order, df.columns
        self.table = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranked", "_range")
        self.counts = dict(sorted((r["_range"], r["count"]) for r in self.table.groupBy("_range").count().collect()))
        self.total = sum(self.counts.values())

    def page(self, number: int, size: int) -> DataFrame:
        """A page in order with the total of all rows; empty beyond the last one."""
        first, at, before, held = (number - 1) * size, 0, 0, []
        for i, n in self.counts.items():
            if at + n <= first:
                before = at + n
            elif at < first + size:
                held.append(i)
            at += n
        return self.table.filter(F.col("_range").isin(held)).orderBy(*self.order).offset(first - before if held else 0).limit(size).select(*self.columns, F.lit(self.total).cast("long").alias("total"))
