"""A bucketed state over batches: only touched buckets are written, a batch that runs again changes nothing."""

import glob
import os

from pyspark.sql import functions as F

from tessera.operators.stored_state import BucketedState


def count(state, batch):
    """Events of each user, with the last id."""
    new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    s, b = state.alias("s"), new.alias("b")
    both = s.join(b, F.col("s.user_id") == F.col("b.user_id"), "full_outer")
    return both.select(F.coalesce("s.user_id", "b.user_id").alias("user_id"), (F.coalesce("s.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), F.greatest("s.last", "b.last").alias("last"))


def test_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id", "event_id")
    path = str(tmp_path / "state")
    state = BucketedState(spark, path, count(events.groupBy("user_id").agg(F.lit(0).cast("long").alias("n"), F.max("event_id").alias("last")).limit(0), events).schema, ["user_id"], buckets=32)
    assert state.read().count() == 0
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/_batch=*/_bucket=*/*.parquet")}
    state.merge(events.filter("event_id % 2 = 0"), 0, count)
    state.merge(events.filter("event_id % 2 = 1 and event_id % 100 <> 7"), 1, count)
    before = files()
    few = events.filter("event_id % 100 = 7 and user_id < 3")
    touched = state.merge(few, 2, count)
    users = few.select("user_id").distinct().count()
    assert 0 < len(touched) <= users < 32
    after = files()
    assert {p: t for p, t in after.items() if p in before} == before
    assert {int(p.split("_bucket=")[1].split("/")[0]) for p in after.keys() - before.keys()} == set(touched)
    rest = events.filter("event_id % 100 = 7 and user_id >= 3")
    state.merge(rest, 3, count)
    want = sorted(map(tuple, events.groupBy("user_id").agg(F.count("*"), F.max("event_id")).collect()))
    key = lambda s: sorted((r.user_id, r.n, r.last) for r in s.read().collect())
    assert key(state) == want
    state.merge(rest, 3, count)  # the batch runs again, in a new session of the state
    again = BucketedState(spark, path, state.read().schema, ["user_id"], buckets=32)
    assert key(again) == want and sorted(r.n for r in again.read(before=1).collect()) == sorted(r["count"] for r in events.filter("event_id % 2 = 0").groupBy("user_id").count().collect())


def test_a_stream_of_batches(spark, tmp_path):
    """foreachBatch gives the number; a stream that is started again from its checkpoint goes on where it was."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id").cache()
    state = BucketedState(spark, str(tmp_path / "state"), count(events.groupBy("user_id").agg(F.lit(0).cast("long").alias("n"), F.max("event_id").alias("last")).limit(0), events).schema, ["user_id"], buckets=8)

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda batch, n: state.merge(batch, n, count) and None).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for k in range(3):
        events.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert sorted((r.user_id, r.n) for r in state.read().collect()) == sorted((r.user_id, r["count"]) for r in events.groupBy("user_id").count().collect())
