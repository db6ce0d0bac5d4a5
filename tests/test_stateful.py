"""Streams with keyed state against the batch operators: three batches, late rows, a restart from the checkpoint, timers."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import state as S
from tessera.streaming import stateful

NOW = dt.datetime(2026, 10, 2)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def last_rows(spark, path, key):
    rows = spark.read.parquet(path)
    return {r[key]: r.r for r in rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r")).collect()}


def run(spark, source, schema, made, out, checkpoint):
    """What is there now, in a query of its own; a later one goes on from the checkpoint. The number is in the path."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = made(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_circuits_equal_the_batch_operator(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    user = F.col("user_id").cast("string")
    ends = e.select(F.concat(F.lit("https://h"), user, F.lit(".io/x")).alias("url"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 9 == 0).alias("blocked"), "event_id").cache()
    paths = [str(tmp_path / x) for x in ("in", "out", "ck")]
    third = F.ntile(3).over(Window.orderBy("at"))
    shuffled = ends.withColumn("k", F.when(F.col("event_id") % 13 == 0, F.least(third + 1, F.lit(3))).otherwise(third)).cache()  # some rows are late by a batch
    for k in (1, 2, 3):
        shuffled.filter(F.col("k") == k).drop("k", "event_id").coalesce(1).write.mode("append").parquet(paths[0])
        run(spark, paths[0], ends.drop("event_id").schema, lambda s: stateful.circuits(s, "20 days"), *paths[1:])
    got = last_rows(spark, paths[1], "key")
    want = {r.key: (r.streak, r.us) for r in S.circuits(ends).select("key", "streak", F.unix_micros("rests_until").alias("us")).collect()}
    assert {k: r.streak for k, r in got.items() if r.streak} == {k: v[0] for k, v in want.items()}
    rests = {r.key: r.us for r in spark.read.parquet(paths[1]).filter("rests_us is not null").groupBy("key").agg(F.max_by("rests_us", "version").alias("us")).collect()}
    assert {k: rests[k] for k in want} == {k: v[1] for k, v in want.items()}


def test_leases_end_by_a_timer(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "ck")]
    schema = "id long, at timestamp, event string"
    at = lambda s: NOW + dt.timedelta(seconds=s)
    batches = [[(1, at(0), "claim"), (2, at(0), "claim"), (3, at(10), "claim")], [(1, at(100), "done"), (9, at(1000), "claim")], [(9, at(2000), "done"), (3, at(2000), "claim")], [(8, at(9000), "claim")], [(8, at(9001), "done")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
        run(spark, paths[0], schema, lambda s: stateful.leases(s, "1 minute", 300, 2), *paths[1:])
    got = {i: (r.status, r.attempts) for i, r in last_rows(spark, paths[1], "id").items()}
    # 1 in time; 2 ran out once; 3 ran out twice, the second time for good; 9 ran out before it was done
    assert got == {1: ("done", 0), 2: ("queued", 1), 3: ("failed", 2), 9: ("queued", 1), 8: ("done", 0)}
