"""Distinct counts that can be added up: a stored sketch a day and group, so a week is the union of its days and a new day reads no old rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a sketch are 2 to this power: an error of about 0.8 % of the count.
BITS = 14


def daily_sketches(rows: DataFrame, time: str, by: list[str], key: str, bits: int = BITS) -> DataFrame:
    """(day, by, sketch) of distinct keys; nulls count for nothing. A day's rows are sketched before the exchange."""
    return rows.groupBy(F.to_date(time).alias("day"), *by).agg(F.hll_sketch_agg(F.col(key), bits).alias("sketch"))


def united(days: DataFrame, period: Column, by: list[str], name: str = "n") -> DataFrame:
    """daily_sketches() of any days -> (period, by, n): distinct keys of each period, without the rows."""
    return days.groupBy(period.alias("period"), *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
