"""Queries against their SQL on events that the given tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from aqengine.plans import registry

from .test_queries import TABLES, normal


def _against_sql(spark, sf_dir, folder, events, name):
    """``name`` and its SQL on the tables of ``sf_dir`` with other events."""
    con = duckdb.connect()
    for t in TABLES:
        rows = events if t == "events" else spark.read.parquet(f"{sf_dir}/{t}.parquet")
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert len(got) and normal(got) == normal(want)


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def test_readings_of_zero_are_kept(spark, sf_dir, tmp_path, events):
    _against_sql(spark, sf_dir, tmp_path, events.withColumn("value", F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value"))), "defaulted_rows")


def test_alerts_of_one_second_are_stored_once(spark, sf_dir, tmp_path, events):
    later = events.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.date_trunc("second", "ts") + F.expr("INTERVAL 0.000007 SECOND"))
    _against_sql(spark, sf_dir, tmp_path, events.unionByName(later), "alerts_appended")
