"""Every query of the catalog against DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from sluice.plans import catalog

SF = os.environ.get("SLUICE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    assert name in catalog.ORACLE_SQL
    want = duck.execute(catalog.ORACLE_SQL[name]).to_arrow_table().to_pandas()
    have = got.toArrow().to_pandas()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)


def test_backfill_takes_every_order(spark, tmp_path):
    keys = [0, 5, 999_999, 1_000_000, 1_000_999, 2_500_001, 6_000_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/some/orders.parquet")
    got = sorted(map(tuple, catalog.backfill(spark, f"{tmp_path}/some").collect()))
    assert got == [(a, a + 1000, n) for a, n in ((0, 2), (999_000, 1), (1_000_000, 2), (2_500_000, 1), (6_000_000_000, 1))]
    spark.createDataFrame([], "o_orderkey long").write.parquet(f"{tmp_path}/none/orders.parquet")
    assert catalog.backfill(spark, f"{tmp_path}/none").count() == 0
