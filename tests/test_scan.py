"""Running values by blocks against the plain recurrences, also for one key that has all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import views
from tessera.operators import relational as R
from tessera.operators import scan
from tessera.operators import state as S

NOW = dt.datetime(2026, 10, 2)


@pytest.mark.parametrize("keys", [1, 4])
def test_running_values(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *range(keys)]) if keys > 1 else 0, rng.randrange(1000), i, rng.choice([None, 1.0, 2.5, -1.0]), rng.randrange(0, 30)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, at long, id int, value double, gap int")
    sums, slots = {}, {}
    want_sum, want_slot = {}, {}
    for k, at, i, v, gap in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            sums[k] = sums.get(k, 0.0) + v
        want_sum[i] = (sums.get(k), None)
        slots[k] = max(at, slots[k] + gap) if k in slots else at
        want_slot[i] = slots[k]
    for bits in (3, 16):
        got = scan.running_sums(df, ["k"], ["at", "id"], bits, total=F.col("value"), n=F.lit(1)).collect()
        assert {r.id: (r.total, None) for r in got} == want_sum
        assert sorted(r.n for r in got if r.k == 0) == list(range(1, sum(r[0] == 0 for r in rows) + 1))
        assert {r.id: r.slot for r in scan.running_slots(df, ["k"], ["at", "id"], F.col("at"), F.col("gap"), "slot", bits).collect()} == want_slot
    assert scan.running_sums(df.limit(0), ["k"], ["at", "id"], total=F.col("value")).count() == 0


def test_one_host_equals_the_window_form(spark):
    """All events as requests of one host: the slots are those of a window over all rows, and no task has most of them."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(F.lit("h").alias("host"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    w = Window.partitionBy("host").orderBy("at", "id")
    k = F.row_number().over(w)
    plain = events.withColumn("_k", k).withColumn("_b", F.unix_micros("at") - F.col("_k") * 3_600_000_000).select("id", (F.max("_b").over(w) + F.col("_k") * 3_600_000_000).alias("slot"))
    got = S.reserve_slots(events, 3600).select("id", F.unix_micros("slot").alias("slot"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    parts = [r["count"] for r in scan.in_blocks(events, ["host"], ["at", "id"], 9).groupBy("_block").count().collect()]
    assert len(parts) > 15 and max(parts) <= 2 * sorted(parts)[len(parts) // 2]


def test_spacing_of_one_zone(spark):
    sends = spark.createDataFrame([("z", i, NOW + dt.timedelta(minutes=i // 3)) for i in range(500)], "zone string, id int, base timestamp")
    out = [(r.base, r.scheduled) for r in views.spaced(sends).orderBy("base", "id").collect()]
    last = None
    for base, at in out:
        gap = (at - max(base, last or base)).total_seconds()
        assert 240 <= gap <= 720
        last = at


def test_budget_gate_of_one_month(spark):
    rows = [(i, NOW + dt.timedelta(seconds=i), 0.02) for i in range(2000)]
    got = R.budget_gate(spark.createDataFrame(rows, "id int, at timestamp, cost double"), "at", "cost", 30.0, "id").collect()
    assert sum(r.fits for r in got) == 1500


def test_pages(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(3000)]
    order = [F.desc("v"), F.col("id")]
    ranked = scan.Ranked(spark.createDataFrame(rows, "id int, v int"), order)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for number, size in ((1, 10), (2, 1000), (300, 10), (150, 7), (301, 10), (1, 5000)):
        assert [tuple(r)[:2] for r in ranked.page(number, size).collect()] == want[(number - 1) * size : number * size]
    page = ranked.page(200, 10)
    assert page.first().total == 3000 and "PartitionFilters: [isnotnull(_range" in page._jdf.queryExecution().toString()
    assert len(set(r[0] for r in ranked.page(200, 10).select(F.input_file_name()).collect())) <= 2
    assert scan.Ranked(spark.createDataFrame([], "id int, v int"), order).page(1, 5).count() == 0


def test_pages_of_uneven_ranges(spark):
    """A small range behind the one where a page begins is not taken for one before it."""
    order = [F.desc("v"), F.col("id")]
    ranked = scan.Ranked(spark.range(100).select("id", (-F.col("id")).alias("v")), order)
    ends, sizes = [10, 60, 62, 65, 100], [10, 50, 2, 3, 35]
    uneven = F.when(F.col("id") < ends[0], 0)
    for i, end in enumerate(ends[1:], 1):
        uneven = uneven.when(F.col("id") < end, i)
    ranked.table, ranked.counts = ranked.table.withColumn("_range", uneven), dict(enumerate(sizes))
    for number, size in ((12, 5), (6, 10), (2, 50), (9, 8), (20, 5), (21, 5)):
        assert [r.id for r in ranked.page(number, size).collect()] == list(range(100))[(number - 1) * size : number * size]


def test_a_month_of_exactly_the_cap_fits(spark, tmp_path):
    """As a sum of doubles in order, 1250 times 1.2 is over 1500."""
    from tessera.plans.relational_queries import month_budget

    rows = [(i, NOW, 1, 1.2) for i in range(1251)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.spent, r.fits) for r in month_budget(spark, str(tmp_path)).collect()}
    assert got[1249] == (1500.0, True) and got[1250] == (1501.2, False) and sum(fits for _, fits in got.values()) == 1250
