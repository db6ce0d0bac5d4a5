"""State that outlives batches: keyed tables in buckets, of which a batch rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedState:
    """A keyed table below `path`, as folders _batch=N/_bucket=b; a bucket's state is that of its latest batch.

    Batch N reads the buckets that its keys fall in as they were before N and writes them anew below _batch=N. The number
    is in the path, so a batch that runs again, whole or after it broke off, replaces what it wrote itself and
    changes nothing else. The driver holds a number for each bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def latest(self, before: int | None = None) -> dict[int, int]:
        """The batch that each bucket was last written by, before a batch or at all."""
        try:
            rows = self._all()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        rows = rows if before is None else rows.filter(F.col("_batch") < before)
        return {r["_bucket"]: r["b"] for r in rows.groupBy("_bucket").agg(F.max("_batch").alias("b")).collect()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The state, or that of some buckets: only their latest folders are listed as inputs."""
        wanted = {b: n for b, n in self.latest(before).items() if only is None or b in only}
        if not wanted:
            return self.spark.createDataFrame([], T.StructType(self.schema.fields[:-2]))
        by_batch: dict[int, list[int]] = {}
        for b, n in wanted.items():
            by_batch.setdefault(n, []).append(b)
        hit = F.lit(False)
        for n, some in by_batch.items():
            hit = hit | ((F.col("_batch") == n) & F.col("_bucket").isin(some))
        return self._all().filter(hit).select(*self.columns)

    def merge(self, batch: DataFrame, number: int, step: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Run a transition (state, batch) -> state over the buckets of the batch's keys; their numbers come back."""
        touched = sorted(r["b"] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most one a bucket
        out = step(self.read(number, touched), batch).select(*self.columns).withColumn("_bucket", self._bucket())
        out.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/_batch={number}")
        return touched
