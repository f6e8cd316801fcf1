from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aqengine import fixtures as fx
from aqengine.operators import clean, cluster, forecast, iforest, joins, parse
from aqengine.plans import client, serving
from aqengine.sources import buckets, feeds, sinks


def test_archive_by_date_and_hour(spark, sf_dir, tmp_path):
    m = fx.measurements(spark, sf_dir)
    sinks.write_archive(m, f"{tmp_path}/a")
    back = feeds.read_archive(spark, f"{tmp_path}/a")
    lo, hi = F.lit("2024-01-05 06:00:00").cast("timestamp"), F.lit("2024-01-06 07:00:00").cast("timestamp")
    part = feeds.between(back, lo, hi)
    assert back.count() == m.count() and part.count() == m.filter((F.col("time") >= lo) & (F.col("time") < hi)).count() > 0
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_upsert_keeps_the_latest_and_repeats_safely(spark, sf_dir, tmp_path):
    m = fx.measurements(spark, sf_dir)
    parts = [m.filter(F.col("event_id") % 3 == i) for i in range(3)]
    for v, part in [*enumerate(parts), (2, parts[2])]:
        sinks.upsert_latest(part, f"{tmp_path}/latest", v, ties=("event_id",))
    got = sinks.read_latest(spark, f"{tmp_path}/latest")
    want = joins.latest_per_key(m, sinks.LATEST_KEY, "time", "event_id")
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, sf_dir, tmp_path):
    m, path = fx.measurements(spark, sf_dir), f"{tmp_path}/b"
    one = F.col("city") == m.select("city").orderBy("city").first()[0]
    state = lambda: buckets._manifest(spark, path, None)
    buckets.upsert_bucketed(m.filter("event_id % 2 = 0"), path, 0, ties=("event_id",))
    before = state()
    for _ in range(2):  # the second write replaces the first
        buckets.upsert_bucketed(m.filter(one), path, 1, ties=("event_id",))
    after, touched = state(), {r[0] for r in m.filter(one).select(F.pmod(F.xxhash64(*sinks.LATEST_KEY), F.lit(buckets.BUCKETS))).distinct().collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and 0 < len(touched) < len(after)
    want = joins.latest_per_key(m.filter(one | (F.col("event_id") % 2 == 0)), sinks.LATEST_KEY, "time", "event_id")
    assert sorted(buckets.read_bucketed(spark, path).select(want.columns).collect()) == sorted(want.collect())
    assert buckets.read_bucketed(spark, path, before=1).count() == joins.latest_per_key(m.filter("event_id % 2 = 0"), sinks.LATEST_KEY, "time", "event_id").count()
    for v in range(2, 6):
        buckets.upsert_bucketed(m.filter(one), path, v, ties=("event_id",))
    assert len(sinks.versions(spark, f"{path}/manifest")) == sinks.KEPT and not (tmp_path / f"b/data/v=1/bucket={min(touched)}").exists()
    assert sorted(buckets.read_bucketed(spark, path).select(want.columns).collect()) == sorted(want.collect()) and buckets.read_bucketed(spark, f"{tmp_path}/none") is None


def test_fan_out_and_alerts(spark, sf_dir, tmp_path):
    m = fx.measurements(spark, sf_dir)
    for _ in range(2):
        sinks.fan_out(m, 0, f"{tmp_path}/f")
    n = {k: spark.read.parquet(f"{tmp_path}/f/{k}").count() for k in ("all", "o3", "pm25", "pm10", "high")}
    assert n["all"] == m.count() == n["o3"] + n["pm25"] + n["pm10"] and n["high"] == m.filter("aqi >= 100").count()
    alerts = parse.high(m).select("time", "city", "state", "pollutant", "aqi")
    for v, part in ((0, alerts), (1, alerts), (1, alerts)):
        sinks.append_alerts(part, v, f"{tmp_path}/alerts")
    stored = spark.read.parquet(f"{tmp_path}/alerts")
    assert stored.count() == alerts.dropDuplicates(["time", "city", "state", "pollutant"]).count() and "created_at" in stored.columns
    stream = spark.readStream.schema(m.schema).parquet(f"{tmp_path}/f/all")
    sinks.each_batch(stream, lambda b, v: sinks.fan_out(b, v, f"{tmp_path}/g"), f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/g/high").count() == n["high"]


def test_feed_stream_from_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"payload": {"content": "<b>Location:</b> X, CA<br/>Last Update: 04 Mar 2025 10:00:00 UTC<br/>Good - 5 AQI - Ozone<br/>"}}\nbad\n')
    q = parse.parse_feed(feeds.read_feed(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("feed_items").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.city, r.aqi, r.pollutant) for r in spark.table("feed_items").collect()] == [("X", 5, "O3")]


def test_routes_csv_and_dimensions(spark, sf_dir, tmp_path):
    df = spark.createDataFrame([("avg-city-hour", 1), ("alerts", 2)], "topic string, x int")
    sinks.route(df, f"{tmp_path}/r")
    assert {r.table for r in spark.read.parquet(f"{tmp_path}/r").select("table").collect()} == {"avg_city_hour", "alerts"}
    s = fx.series(spark, sf_dir)
    sinks.export_csv(s.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), f"{tmp_path}/csv")
    assert sorted(feeds.read_series_csv(spark, f"{tmp_path}/csv").collect()) == sorted(s.collect())
    (tmp_path / "loc.json").write_text('{"city": "A", "state": "CA", "longitude": "1.5", "latitude": 2}\n{"city": "A", "state": "CA", "longitude": 9, "latitude": 9}\n{"city": "B", "state": "CA", "longitude": "?", "latitude": 3}\n')
    loc = feeds.load_city_locations(spark, f"{tmp_path}/loc.json")
    assert sorted((r.city, r.longitude, r.latitude) for r in loc.collect()) == [("A", 1.5, 2.0), ("B", None, 3.0)]
    assert [r.city for r in feeds.load_city_locations(spark, f"{tmp_path}/loc.json", loc.filter("city = 'A'")).collect()] == ["B"]
    pd.DataFrame({"t": pd.to_datetime(["2025-01-01 00:00:00.123456789"]), "x": [1]}).to_parquet(f"{tmp_path}/ns.parquet", version="2.6", coerce_timestamps=None)
    assert feeds.normalise_timestamps(spark, f"{tmp_path}/ns.parquet", ["t"]).first().t.microsecond == 123456


def test_cleaning(spark):
    a = spark.createDataFrame([("1", "2024-01-01 00:00:00", "CA", "OZONE", v) for v in ("5", "n/a", "-1", "501", "5")] + [("1", None, "CA", "OZONE", "3"), ("2", "2024-01-01 00:00:00", "ZZ", "OZONE", "3"), ("2", "2024-01-01 00:00:00", "CA", "CO", "3"), ("3", "2024-01-01 00:00:00", "CA", "PM10", "640")], "SiteID string, t string, StateCode string, Parameter string, Value string").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    known = clean.known_parameters(clean.known_states(a))
    assert sorted(r.Value for r in clean.plausible(clean.numeric(known)).collect()) == [5.0, 5.0, 640.0]
    assert clean.deduplicated(known).count() == 3
    assert clean.sample_by_hash(a, ["SiteID"], 1000).count() == a.count() and clean.sample_by_hash(a, ["SiteID"], 0).count() == 0
    assert clean.impute_zero(spark.createDataFrame([(None,)], "x double"), ["x"]).first().x == 0
    approx = clean.impute_median(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double"), ["x"], 0.01)
    assert sorted(r.x for r in approx.collect()) == [1.0, 2.0, 2.0, 3.0]


@pytest.mark.parametrize(("d", "eps"), [(2, 0.5), (5, 0.8)])
def test_dbscan_against_a_plain_one(spark, d, eps):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 0.3, (60, d)), rng.normal(4, 0.3, (60, d)), rng.uniform(-3, 8, (30, d)), [[0.0] * d] * 6, rng.normal(2, 0.02, (200, d))])
    names = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", names, eps, 5).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(30):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    want = {i: int(label[i]) if core[i] else int(min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i in range(len(x))}
    assert got == want and -1 in want.values()


def test_silhouettes_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(0, 1, (90, 3)), np.r_[np.zeros(40), np.ones(49), 2].astype(int)
    x[k == 1] += 2
    df = spark.createDataFrame([(int(c), *map(float, row)) for c, row in zip(k, x, strict=True)], "cluster int, a double, b double, c double")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = np.zeros(len(x))
    for i in range(len(x) - 1):
        inner, other = d[i, k == k[i]].sum() / ((k == k[i]).sum() - 1), min(d[i, k == j].mean() for j in set(k) - {k[i]})
        s[i] = (other - inner) / max(other, inner)
    got = {r["cluster"]: (r["size"], r["silhouette"]) for r in cluster.silhouettes(df, ["a", "b", "c"]).collect()}
    assert all(got[j][0] == (k == j).sum() and abs(got[j][1] - s[k == j].mean()) < 1e-9 for j in range(3))


def test_tuning_judges_every_fold(spark):
    t0 = datetime(2024, 1, 1)
    s = spark.createDataFrame([(f"s{j}", t0 + timedelta(hours=i), float(20 + 10 * ((i + 7 * j) % 24 > 11) + j)) for j in range(2) for i in range(400)], "SiteID string, timestamp timestamp, PM25 double")
    grid = {"trees": [2, 20], "depth": [1, 3], "rate": [0.3]}
    tuned = {(r["trees"], r["depth"]): r["rmse"] for r in forecast.tune_gbt(s, F.lit(t0 + timedelta(hours=350)), draws=4, grid=grid).collect()}
    assert len(tuned) == 4 and tuned[20, 3] <= tuned[20, 1] < tuned[2, 1]  # the step at noon needs two cuts
    rows = forecast.tuned_forecast(s, F.lit(t0 + timedelta(hours=350)), draws=2, folds=2, grid={"trees": [2, 20], "depth": [2], "rate": [0.3]}).collect()
    test = [r for r in rows if r["Forecast_Type"] == "Test"]
    assert len(test) == 100 and {r["Forecast_Type"] for r in rows} == {"Train", "Test", "Next"} and sum(abs(r["Predicted_PM25"] - r["Actual_PM25"]) for r in test) < 100
    none = forecast.tune_gbt(s.limit(0), F.lit(t0), draws=2, grid=grid).collect()
    assert len(none) == 2 and all(r["rmse"] is None for r in none)


def test_tuning_learns_from_cells_as_from_all_rows(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator

    rng, t0, sizes = np.random.default_rng(7), datetime(2024, 1, 1), []
    level = rng.integers(1, 6, (2, 400)).cumsum(1) % 20

    class Trees(forecast.GBTRegressor):
        def fit(self, df):
            sizes.append(df.count())
            return super().fit(df)

    def tuned(sites):
        s = spark.createDataFrame([(f"s{j}", t0 + timedelta(hours=i), float(level[j % 2, i])) for j in range(sites) for i in range(400)], "SiteID string, timestamp timestamp, PM25 double")
        sizes.clear()
        (row,) = forecast.tune_gbt(s, F.lit(t0 + timedelta(hours=350)), draws=1, folds=1, grid={"trees": [2], "depth": [2], "rate": [0.5]}).collect()
        return s, row["rmse"], sizes[:]

    monkeypatch.setattr(forecast, "GBTRegressor", Trees)
    s, once, few = tuned(2)
    _, often, many = tuned(10)
    assert few == many and abs(once - often) < 1e-9  # five times the rows, in the same cells
    f, xs = forecast.features(s)
    rows = forecast._assembled(forecast.usable(f, xs, F.lit(t0 + timedelta(hours=350)), "hourly").filter("Forecast_Type = 'Train'"), xs)
    end, last = rows.select(F.unix_seconds("timestamp").cast("double").alias("t")).approxQuantile("t", [0.5, 1.0], 0.001)
    at = F.unix_seconds("timestamp")
    model = monkeypatch.undo() or forecast.GBTRegressor(labelCol="PM25", maxIter=2, maxDepth=2, stepSize=0.5, seed=42).fit(rows.filter(at <= end))
    assert abs(RegressionEvaluator(labelCol="PM25").evaluate(model.transform(rows.filter((at > end) & (at <= last)))) - once) < 1e-6


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (1500, 3)), rng.normal(0, 1, (10, 3)) + 9])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    forest = iforest.isolation_forest_fit(df, ["a", "b", "c"], ["id"], trees=50)
    assert forest.count() == 50 and all(r.n <= iforest.SAMPLE for r in forest.collect())
    top = iforest.isolation_forest_score(df, forest, ["a", "b", "c"]).orderBy(F.desc("score")).limit(10).collect()
    assert {r.id for r in top} == set(range(1500, 1510)) and all(0.5 < r.score < 1 for r in top)


def test_radius_join_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    loc = spark.createDataFrame([(f"c{i}", "S", float(rng.uniform(-120, -110)), float(rng.uniform(-80, 80))) for i in range(60)], "city string, state string, longitude double, latitude double")
    subs = spark.createDataFrame([(i, f"e{i}", float(rng.uniform(-120, -110)), float(rng.uniform(-80, 80)), i % 3 > 0) for i in range(400)], "id long, email string, longitude double, latitude double, active boolean")
    alerts = loc.select("city", "state", F.lit("O3").alias("pollutant"), F.lit(120).alias("aqi"))
    from aqengine.functions.geo import geo_distance_m, haversine_m

    for radius in (50_000.0, 400_000.0):
        got = {(r.id, r.city) for r in joins.alert_recipients(alerts, loc, subs, radius).collect()}
        pairs = subs.filter("active").crossJoin(loc.select("city", F.col("longitude").alias("x"), F.col("latitude").alias("y")))
        d = pairs.withColumn("d", geo_distance_m(F.col("longitude"), F.col("latitude"), F.col("x"), F.col("y"))).withColumn("h", haversine_m(F.col("longitude"), F.col("latitude"), F.col("x"), F.col("y")))
        assert got == {(r.id, r.city) for r in d.filter(F.col("d") <= radius).collect()}
        assert d.filter("abs(d - h) > 0.006 * d + 1").count() == 0
    assert got


def test_serving_edges(spark, sf_dir):
    m, loc = fx.measurements(spark, sf_dir), fx.city_location(spark, sf_dir)
    alerts = parse.high(m)
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    assert serving.local_alerts(alerts, loc, None, now).count() == 0
    empty = m.limit(0)
    assert serving.dashboard_summary(empty, empty, now).first().average_aqi == 0
    assert serving.trends(empty).count() == 0
    assert client.map_centre(loc.limit(0)).first().latitude == client.CENTRE[0]
    assert client.heat_points(joins.with_location(empty, loc)).count() == 0
    assert client.filtered(m).count() == m.count()


def test_fits_of_a_sweep_read_few_parts(spark, monkeypatch):
    """Each round of a fit is a job over all parts of the features, so a small table must not lie in many."""
    parts = []

    class Spy(cluster.KMeans):
        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(cluster, "KMeans", Spy)
    rows = spark.range(90).select(*[(F.col("id") % 3 * 10 + F.rand(i) / 10).alias(c) for i, c in enumerate("ab")]).repartition(64)
    got = cluster.sweep_clusters(cluster.assemble(rows, ["a", "b"]), (2, 3)).collect()
    assert parts == [1, 1] and [r.k for r in got if r.best] == [3] and got[1].kmeans > 0.99


def test_trees_are_walked_in_steps(spark):
    """Rows in leaves stay there, whatever their values, so that scores are those of a walk that stops."""
    x = np.random.default_rng(3).normal(size=(300, 3))
    column, cut, left, size = (np.array(a) for a in iforest._grow(x, np.random.default_rng(1), 8))
    c, t, go, _, depth = iforest._looped(column, cut, left, size)
    for row in [*x, np.array([np.inf] * 3), np.array([-np.inf] * 3), np.array([np.nan] * 3)]:
        at, to = 0, 0
        while column[at] >= 0:
            at = left[at] + int(row[column[at]] >= cut[at])
        for _ in range(depth):
            to = go[to] + int(row[c[to]] >= t[to])
        assert at == to


def test_rows_are_scored_once(spark, sf_dir, monkeypatch):
    """Neither the quartiles nor the flags score rows again."""
    from aqengine.plans import registry

    plan = registry.QUERIES["isolation_forest"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["dbscan_sweep", "dbscan_profiles"])
def test_density_clusters_read_events_once(spark, sf_dir, name):
    from aqengine.plans import registry

    assert not any("events" in f for f in registry.QUERIES[name](spark, sf_dir).inputFiles())


def test_cells_whose_facing_rows_do_not_meet(spark):
    """Three groups of rows: the first two are joined only by rows at the rims of their cells, not by those nearest to the other's middle; the third is apart."""
    cell = 1 / 2**0.5
    left = [(i, 0.6, 0.35 + i / 1000) for i in range(6)] + [(6, 0.55, 0.01)]
    right = [(10 + i, 1.75 + i / 1000, 0.35) for i in range(6)] + [(16, 1.5, 0.01)]
    rows = [*left, *right, *[(20 + i, 9.0 + i / 100, 9.0) for i in range(6)]]
    assert cell < 1.5 < 3 * cell
    got = dict(cluster.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 1.0, 5).collect())
    near = {i: {j for j, a, b in rows if (a - x) ** 2 + (b - y) ** 2 <= 1.0} for i, x, y in rows}
    core, label = {i for i in near if len(near[i]) >= 5}, {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            label[j] = i
            todo += [q for q in near[j] & core if q not in label]
    assert got == {i: label.get(i, min((label[j] for j in near[i] & core), default=-1)) for i in near}
