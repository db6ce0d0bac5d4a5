import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.sketches import daily_sketches, united


def test_days_are_added_without_their_rows(spark, tmp_path):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_790_899_200) + (F.col("id") % 7) * 86_400).alias("at"), F.when(F.col("id") % 11 > 0, F.col("id") % 20_011).alias("user"), (F.col("id") % 2).alias("kind"))
    path = str(tmp_path / "days")
    for day in range(7):  # a day at a time, each from its own rows
        one = rows.filter(F.dayofmonth("at") == (dt.date(2026, 10, 2) + dt.timedelta(day)).day)
        daily_sketches(one, "at", ["kind"], "user").write.mode("append").parquet(path)
    got = {r.kind: r.n for r in united(spark.read.parquet(path), F.lit(1), ["kind"]).collect()}
    want = {r.kind: r.n for r in rows.groupBy("kind").agg(F.countDistinct("user").alias("n")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.02 * want[k] for k in want)
