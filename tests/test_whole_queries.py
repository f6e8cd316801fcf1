"""Registered queries do the whole job: all users, all sites."""

import random

import duckdb
import pytest

from aqengine import fixtures as fx
from aqengine.operators import joins
from aqengine.plans import registry

from .test_queries import TABLES, normal


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_near_me_is_for_all_users(spark, duck, sf_dir):
    got = registry.QUERIES["near_me"](spark, sf_dir).toPandas()
    assert set(got["id"]) == {r.id for r in fx.subscribers(spark, sf_dir).select("id").collect()}
    sql = registry.ORACLES["near_me"]
    assert normal(got) == normal(duck.execute(sql.replace(" WHERE id % 7 = 0", "")).df())
    if "WHERE id % 7 = 0" in sql:
        assert normal(got[got["id"] % 7 == 0]) == normal(duck.execute(sql).df())


def test_pivot_sensors_has_a_column_for_each_site(spark, sf_dir):
    rows = [(r.SiteID, f"{r.timestamp:%Y-%m-%d %H:%M:%S}", round(r.PM25, 5)) for r in fx.series(spark, sf_dir).collect()]
    got = registry.QUERIES["pivot_sensors"](spark, sf_dir).collect()
    assert set(got[0].asDict()) == {"timestamp"} | {s for s, _, _ in rows}
    assert len(got) == len({t for _, t, _ in rows})
    cells = [(s, r["timestamp"], round(v, 5)) for r in got for s, v in r.asDict().items() if s != "timestamp" and v is not None]
    assert sorted(cells) == sorted(rows)


def test_sweeps_and_boosted_trees_take_the_survey_s_settings(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from aqengine.operators import cluster, forecast

    made, larger = [], sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have no rows before the cutoff

    class Trees:
        def __init__(self, maxIter, maxDepth, stepSize, **_):
            made.append((maxIter, maxDepth, stepSize))

        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(forecast, "GBTRegressor", Trees)
    registry.QUERIES["forecast_gbt"](spark, larger)
    assert made == [(80, 4, 0.05)]
    made.clear()
    registry.QUERIES["tune_gbt"](spark, larger)
    assert len(made) == 9 and len(set(made)) == 3
    assert all(t in (50, 100, 150) and d in (3, 5, 7) and r in (0.01, 0.05, 0.1) for t, d, r in made)
    sweeps = {}
    monkeypatch.setattr(cluster, "dbscan", lambda df, key, cols, eps, min_pts: sweeps.setdefault(eps, df.limit(0).select(F.lit(0).alias("cluster"))))
    registry.QUERIES["dbscan_sweep"](spark, sf_dir)
    assert sorted(sweeps) == [0.5, 1.0, 1.5, 2.0]
    assert sorted(r.k for r in registry.QUERIES["cluster_sweep"](spark, sf_dir).collect()) == [2, 3, 4, 5, 6]


def test_percentiles_by_narrowing(spark, monkeypatch):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from aqengine.operators import aggregate

    r = random.Random(0)
    monkeypatch.setattr(aggregate, "FEW", 50)
    for values in ([r.gauss(0, 1) for _ in range(3000)], [r.randrange(3) for _ in range(3000)], [7.0] * 500, [1.0], [1.0] * 400 + [2.0] * 400):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        shares = [0.0, 0.25, 0.5, 0.75, 1.0]
        assert np.allclose(aggregate.percentiles(df, "x", shares, 50), np.percentile(values, [100 * s for s in shares]))
    assert aggregate.percentiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]
    assert aggregate.quartiles(spark.range(1001).select(F.col("id").alias("x")), "x").first().q3 == 750


def test_far_users_meet_their_nearest_cities(spark, monkeypatch):
    import random

    from aqengine.operators import joins

    r = random.Random(1)
    cities = [(f"c{i}", "S", r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(40)]
    loc = spark.createDataFrame(cities, "city string, state string, longitude double, latitude double")
    users = spark.createDataFrame([(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(60)], "id long, longitude double, latitude double")
    rows = spark.createDataFrame([(c, s, "O3", i) for i, (c, s, _, _) in enumerate(cities)], "city string, state string, pollutant string, time int")
    for k in (3, 50):
        got = {}
        for x in joins.nearest_for_users(rows, loc, users, k).collect():
            got.setdefault(x.id, []).append((x["rank"], x.city))
        for u in users.collect():
            want = sorted((((u.longitude - lon) ** 2 + (u.latitude - lat) ** 2) ** 0.5, c) for c, _, lon, lat in cities)[:k]
            assert [c for _, c in sorted(got[u.id])] == [c for _, c in want]


def test_nearest_places_down_a_quadtree(spark):
    r = random.Random(3)
    dense = [(10 + r.random() * 1e-3, 50 + r.random() * 1e-3) for _ in range(400)]
    sparse = [(r.uniform(-170, 170), r.uniform(-80, 80)) for _ in range(60)]
    points = dense + sparse + [(20.0, 20.0)] * 30  # a third and more in one place, and many at one point
    places = [(f"c{i:03}", "s", x, y) for i, (x, y) in enumerate(points)] + [("none", "s", None, 1.0), ("nan", "s", float("nan"), 1.0)]
    users = [(i, *r.choice(points)) for i in range(40)] + [(100 + i, r.uniform(-300, 300), r.uniform(-90, 90)) for i in range(40)] + [(200, 10.002, 50.0005), (201, 9.99, 50.0)]
    got = {}
    near = joins.nearest_places(spark.createDataFrame(users, "id long, longitude double, latitude double"), spark.createDataFrame(places, "city string, state string, c_lon double, c_lat double"), 5, leaf=4)
    for x in near.collect():
        got.setdefault(x.id, []).append((x.distance, x.city))
    for i, lon, lat in users:
        want = sorted((((lon - x) ** 2 + (lat - y) ** 2) ** 0.5, c) for c, _, x, y in places if x is not None and x == x)[:5]
        have = sorted(got[i])
        assert [c for _, c in have] == [c for _, c in want] or all(abs(a[0] - b[0]) < 1e-12 for a, b in zip(have, want, strict=True))


def test_a_quadtree_splits_dense_places(spark):
    r = random.Random(4)
    points = [(f"c{i}", 10 + r.random() * (1e-2 if i % 3 else 1.0), 50 + r.random() * (1e-2 if i % 3 else 1.0)) for i in range(3000)]
    df = spark.createDataFrame(points, "city string, c_lon double, c_lat double")
    tree, held = joins.quadtree(df, (10.0, 50.0, 1.0), 32)
    leaves = tree.filter("leaf").collect()
    assert sum(x.n for x in leaves) == held.count() == 3000 and max(x.n for x in leaves) <= 32 and held.select("city").distinct().count() == 3000


def test_nearest_places_of_none(spark):
    users = spark.createDataFrame([(1, 0.0, 0.0)], "id long, longitude double, latitude double")
    places = spark.createDataFrame([("a", "s", 1.0, 1.0)], "city string, state string, c_lon double, c_lat double")
    assert [x.city for x in joins.nearest_places(users, places, 5).collect()] == ["a"]
    assert joins.nearest_places(users, places.limit(0), 5).collect() == [] and joins.nearest_places(users.limit(0), places, 5).collect() == []


@pytest.mark.parametrize("name", ["alert_recipients", "alert_outbox"])
def test_nothing_is_worked_out_for_each_recipient_of_each_alert(spark, sf_dir, name):
    """The last join makes a row for each alert and subscriber; texts, times and distances are ready before."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    after = plan.split("Join Inner")[0]
    assert not any(f in after.lower() for f in ("format_string", "date_format", "round("))
    assert "RepartitionByExpression" in plan


def test_users_meet_lists_of_places(spark):
    """A user and the places of a leaf are one row, so rows of users times places are neither dealt nor sorted; a leaf at the least level may hold any number of places."""
    r = random.Random(5)
    places = [(f"c{i}", "S", 1.0 + r.random() / 1e7, 1.0 + r.random() / 1e7) for i in range(150)] + [("far", "S", 9.0, 9.0)]
    users = [(i, 1.0 + r.random() / 1e7, 1.0) for i in range(20)]
    near = joins.nearest_places(spark.createDataFrame(users, "id long, longitude double, latitude double"), spark.createDataFrame(places, "city string, state string, c_lon double, c_lat double"), 3)
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, c) for i, x, y in users for _, c in sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, c) for c, _, a, b in places)[:3]}
    assert {(p.id, p.city) for p in near.collect()} == want
