"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from aqengine.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"cluster_sweep", "tune_gbt", "forecast_gbt", "isolation_forest", "isolation_top"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    registry.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
