"""Every query against its SQL in DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else str(pd.Timestamp(v)) if hasattr(v, "year") else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0


def test_rare_tokens_have_a_preference_weight(spark):
    every, frequent = ({r.token: r.weight for r in catalogue.QUERIES[name](spark, SF).collect()} for name in ("preference_logodds_all", "preference_logodds"))
    assert frequent.items() < every.items()
