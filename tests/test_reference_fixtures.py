"""The fixtures of FIXTURES.md, on tables and on streams."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from aqengine import fixtures as fx
from aqengine.functions.aqi import BANDS, CONCENTRATIONS, aqi_band, aqi_to_concentration, severity
from aqengine.operators import aggregate, forecast, parse, series, stateful, topk, windows
from aqengine.sources import feeds, sinks
from aqengine.streaming import state
from aqengine.streaming import topk as stream_topk
from aqengine.streaming import windows as stream_windows

T0 = datetime(2025, 1, 1)
M = "event_id long, time timestamp, city string, state string, pollutant string, aqi int"


def rows(spark, readings, city="San Francisco", pollutant="PM2.5"):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=i), city, "CA", pollutant, a) for i, a in enumerate(readings)], M)


SPIKE = [40 + (i % 3 - 1) * 2 for i in range(20)] + [150]
TREND = [50] * 20 + [70, 85, 95, 98, 99]


def test_spike_is_one_anomaly(spark):
    scored = stateful.ema_zscore(rows(spark, SPIKE))
    a = stateful.anomaly_alerts(scored).collect()
    assert len(a) == 1 and a[0].aqi == 150 and abs(a[0].z_score - 68.7022) < 1e-4 and abs(a[0].expected_aqi - 50.706) < 1e-3
    assert stateful.forecast_alerts(scored).count() == 0


def test_trend_is_forecast(spark):
    scored = stateful.ema_zscore(rows(spark, TREND)).orderBy("event_id").collect()
    assert [round(r.predicted, 2) for r in scored[20:]] == [58.80, 71.48, 84.54, 94.63, 101.67]
    assert [round(r.trend, 2) for r in scored[20:]] == [0.80, 1.88, 2.90, 3.55, 3.87]
    assert [r.event_id for r in scored if r.is_forecast_alert] == [24]
    assert [(r.event_id, round(r.z, 2)) for r in scored if r.is_anomaly] == [(21, 5.50), (22, 3.48)] and scored[20].z == 0


def test_fold_goes_on_from_states(spark):
    whole = {r.event_id: r for r in stateful.ema_zscore(rows(spark, TREND)).collect()}
    m = rows(spark, TREND)
    first = stateful.ema_zscore(m.filter("event_id < 12"))
    rest = stateful.ema_zscore(m.filter("event_id >= 12"), start=stateful.last_states(first))
    assert all(r == whole[r.event_id] for part in (first, rest) for r in part.collect())


def test_topk(spark):
    ten = [(i, T0, f"City_{i}", "State", "O3", 10 * i) for i in range(1, 11)]
    assert topk.global_topk(spark.createDataFrame(ten, M)).count() == 10
    top = {r.station: r.aqi for r in topk.global_topk(spark.createDataFrame([*ten, (11, T0, "City_11_CRITIQUE", "State", "O3", 999)], M)).collect()}
    assert len(top) == 10 and top["City_11_CRITIQUE - State"] == 999.0 and "City_1 - State" not in top and "City_2 - State" in top
    kept = {}
    for name, aqi in [*((f"City_{i}", 10.0 * i) for i in range(1, 11)), ("new", 999.0)]:
        topk.retain(kept, name, aqi, 10)
    assert len(kept) == 10 and "City_1" not in kept


MAX = [("Narragansett", 32, 0), ("Narragansett", 33, 60), ("West Greenwich", 31, 120), ("Narragansett", 32, 71 * 60)]


def files(path, parts):
    """One JSON file for each part, with times that tell their order."""
    os.makedirs(path, exist_ok=True)
    for i, part in enumerate(parts):
        with open(f"{path}/{i:03d}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in part)
        os.utime(f"{path}/{i:03d}.json", (time.time() - 1000 + i, time.time() - 1000 + i))


def run(df, path, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def test_maxima_close_with_the_window(spark, tmp_path):
    parts = [[{"event_id": i, "time": (T0 + timedelta(seconds=s)).isoformat() + "Z", "city": c, "state": "RI", "pollutant": "O3", "aqi": a}] for i, (c, a, s) in enumerate(MAX)]
    files(f"{tmp_path}/in", parts)
    m = feeds.read_measurements_stream(spark, f"{tmp_path}/in", schema=M, max_files=1)
    got = run(stream_windows.maxima(m), f"{tmp_path}/city").collect()
    assert sorted((r.city, r.aqi, r.time_start) for r in got) == [("Narragansett", 33, T0), ("West Greenwich", 31, T0)]
    got = run(stream_windows.maxima(m, by_city=False), f"{tmp_path}/state").collect()
    assert [(r.state, r.aqi) for r in got] == [("RI", 33)]


def test_streams_equal_tables(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [{"event_id": i, "time": (T0 + timedelta(minutes=3 * i)).isoformat() + "Z", "city": f"c{rng.integers(3)}", "state": "CA", "pollutant": ["O3", "PM2.5"][rng.integers(2)], "aqi": int(rng.integers(1, 200))} for i in range(600)]
    files(f"{tmp_path}/in", [data[i : i + 100] for i in range(0, 600, 100)])
    m = feeds.read_measurements_stream(spark, f"{tmp_path}/in", schema=M, max_files=1)
    table = spark.read.schema(M).json(f"{tmp_path}/in")
    end = T0 + timedelta(minutes=3 * 599) - timedelta(minutes=1)
    for name in ("avg_city_hour", "avg_state_8_hour"):
        closed = windows.average(table, name).filter(F.col("time_end") <= F.lit(end))
        assert sorted(run(stream_windows.averages(m, name), f"{tmp_path}/{name}").collect()) == sorted(closed.collect())
    both = [sorted((r.event_id, r["count"], r.is_anomaly, r.is_forecast_alert, round(r.ema, 9), round(r.z, 9), round(r.predicted, 9)) for r in df.collect()) for df in (run(state.ema_zscore_stream(m), f"{tmp_path}/ema"), stateful.ema_zscore(table))]
    assert both[0] == both[1] and len(both[0]) == 600
    cat = lambda df: df.withColumn("category", aqi_band("aqi"))
    both = [sorted((r.event_id, r.category) for r in df.collect()) for df in (run(state.dedup_alerts_stream(cat(m)), f"{tmp_path}/dedup"), stateful.dedup_alerts(cat(table)))]
    assert both[0] == both[1] and 0 < len(both[0]) < 600
    forgetful = run(state.dedup_alerts_stream(cat(m), grace="10 minutes"), f"{tmp_path}/forget")
    assert sorted((r.event_id, r.category) for r in forgetful.collect()) == both[1]


def test_appended_aggregates(spark, sf_dir, tmp_path):
    fx.measurements(spark, sf_dir).write.parquet(f"{tmp_path}/in")
    m = spark.readStream.schema(fx.measurements(spark, sf_dir).schema).parquet(f"{tmp_path}/in")
    sinks.append_aggregate(stream_windows.maxima(m), str(tmp_path), "max-city-hour", f"{tmp_path}/c", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/max_city_hour").count() > 0


def test_continuous_topk(spark, tmp_path):
    ten = [(i, T0, f"City_{i}", "S", "O3", 10 * i) for i in range(1, 12)]
    stream_topk.update_topk(spark.createDataFrame(ten, M), 0, str(tmp_path))
    assert [r.aqi for r in stream_topk.current_topk(spark, str(tmp_path)).orderBy("rank").collect()] == [10.0 * i for i in range(11, 1, -1)]
    drop = spark.createDataFrame([(99, T0 + timedelta(hours=1), "City_11", "S", "O3", 1)], M)
    for _ in range(2):  # a repeated batch changes nothing
        stream_topk.update_topk(drop, 1, str(tmp_path))
    top = stream_topk.current_topk(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.aqi for r in top] == [10.0 * i for i in range(10, 0, -1)]  # City_1, once pushed out, is back


def ramp(spark, n, value=float, skip=()):
    return spark.createDataFrame([("S1", T0 + timedelta(hours=i), value(i + 1)) for i in range(n) if i not in skip], "SiteID string, timestamp timestamp, PM25 double")


def test_series_features(spark):
    got = series.add_lags(ramp(spark, 300)).orderBy("timestamp").collect()
    assert got[5].PM25 == 6 and got[5].lag_1 == 5 and got[0].lag_1 is None
    shuffled = ramp(spark, 300).orderBy(F.rand(1))
    assert series.add_lags(shuffled).orderBy("timestamp").collect() == got
    c = series.calendar(ramp(spark, 300)).orderBy("timestamp").collect()
    assert [round(c[h].hour_sin, 9) + 0.0 for h in (0, 6, 12, 18)] == [0, 1, 0, -1]
    cut = F.lit(T0 + timedelta(hours=250))
    assert forecast.forecast_linear(ramp(spark, 10), cut).count() == 0
    assert [r.status for r in forecast.site_status(ramp(spark, 10), cut).collect()] == ["too few rows"]
    assert dict(forecast.forecast_linear(ramp(spark, 10), cut).dtypes)["Predicted_PM25"] == "double"
    holes = ramp(spark, 30).withColumn("PM25", F.when(F.hour("timestamp") != 9, F.col("PM25")))
    assert series.add_lags(holes, (1,)).orderBy("timestamp").collect()[10].lag_1 is None
    assert series.gaps(ramp(spark, 30, skip=(9,))).collect()[0].seconds_since == 7200


def test_linear_forecast_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    y = 50 + np.cumsum(rng.standard_normal(400))
    s = spark.createDataFrame([("S1", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(y)], "SiteID string, timestamp timestamp, PM25 double")
    cut = T0 + timedelta(hours=300)
    got = {r.timestamp: r for r in forecast.forecast_linear(s, F.lit(cut)).collect()}
    t = [T0 + timedelta(hours=i) for i in range(401)]
    h, d = np.array([x.hour for x in t]), np.array([x.weekday() for x in t])
    cal = np.stack([np.sin(2 * np.pi * h / 24), np.cos(2 * np.pi * h / 24), np.sin(2 * np.pi * d / 7), np.cos(2 * np.pi * d / 7)], 1)
    x = np.array([[1, y[i - 1], y[i - 2], y[i - 3], y[i - 24], *cal[i]] for i in range(24, 401)])
    beta = np.linalg.lstsq(x[:276], y[24:300], rcond=None)[0]
    for i in range(24, 401):
        r = got[t[i]]
        assert abs(r.Predicted_PM25 - x[i - 24] @ beta) < 1e-5
        assert r.Forecast_Type == ("Train" if i < 300 else "Test" if i < 400 else "Next") and (r.Actual_PM25 is None) == (i == 400)
    m = aggregate.forecast_metrics(forecast.forecast_linear(s, F.lit(cut))).collect()
    assert {r.Forecast_Type for r in m} == {"Train", "Test"} and all(r.R2 > 0.5 for r in m)


@pytest.mark.parametrize("pollutant", list(CONCENTRATIONS))
def test_concentrations_meet_the_breakpoints(spark, pollutant):
    every = spark.range(-5, 600).select(F.col("id").cast("int").alias("aqi"), F.lit(pollutant).alias("p"))
    got = {r.aqi: r.c for r in every.select("aqi", aqi_to_concentration("aqi", "p").alias("c")).collect()}
    for (lo, hi), (a, b) in zip(BANDS, CONCENTRATIONS[pollutant], strict=True):
        assert abs(got[lo] - a) < 1e-9 and abs(got[hi] - b) < 1e-9
    assert all(got[i] < got[i + 1] for i in range(500)) and got[-5] == got[0] and got[599] == got[500]


def test_bands_and_severity(spark):
    df = spark.createDataFrame([(x,) for x in (0, 50, 51, 100, 101, 150, 151, 200, 201, 300, 301, 700, None)], "aqi int")
    got = df.select(aqi_band("aqi").alias("b"), severity("aqi").alias("s")).collect()
    assert [r.b for r in got] == ["Good"] * 2 + ["Moderate"] * 2 + ["Unhealthy for sensitive groups"] * 2 + ["Unhealthy"] * 2 + ["Very Unhealthy"] * 2 + ["Hazardous"] * 2 + [None]
    assert [r.s for r in got] == ["LOW"] * 2 + ["MEDIUM"] * 4 + ["HIGH"] * 2 + ["CRITICAL"] * 4 + ["LOW"]


HEAD = "<b>Location:</b> San José, CA<br/><b>Last Update:</b> "


def test_feed_items(spark):
    item = lambda when, *readings: f"<b>Location:</b>  St. Mary's (East), CA<br/>\nLast Update: {when}<br/>\n" + "<br/>\n".join(readings)
    ozone, fine, odd = "Good  -  45 AQI - Ozone", "Unhealthy for Sensitive Groups - 120 AQI - Particle Pollution (2.5 microns)", "Good - 5 AQI - Particle Pollution (7 microns)"
    items = [
        (1, item("Tue, 04 Mar 2025 10:00:00 EST", ozone, fine)),
        (2, item("Tue 04 Mar 2025 02:30:00 PM UTC", "Moderate - 60 AQI - Particle Pollution (10 microns)")),
        (3, item("04 Mar 2025 10:00:00 UTC", ozone, odd)),
        (4, item("some day", ozone)),
        (5, "Last Update: 04 Mar 2025 10:00:00 UTC<br/>" + ozone),
        (6, item("04 Mar 2025 10:00:00 UTC", "Good - 0 AQI - Ozone", fine)),
        (7, None),
        (8, item("04 Mar 2025 10:00:00 UTC", "Good - 99999999999 AQI - Ozone")),
    ]
    feed = spark.createDataFrame(items, "id int, content string")
    got = [(r.id, r.time, r.city, r.state, r.pollutant, r.aqi, r.category, r.band) for r in parse.parse_feed(feed, "id").orderBy("id", "aqi").collect()]
    place = ("St. Mary's (East)", "CA")
    assert got == [
        (1, datetime(2025, 3, 4, 15), *place, "O3", 45, "Good", "Good"),
        (1, datetime(2025, 3, 4, 15), *place, "PM2.5", 120, "Groups", "Unhealthy for sensitive groups"),
        (2, datetime(2025, 3, 4, 14, 30), *place, "PM10", 60, "Moderate", "Moderate"),
        (6, datetime(2025, 3, 4, 10), *place, "PM2.5", 120, "Groups", "Unhealthy for sensitive groups"),
    ]
    assert {r.id: r.rejected for r in parse.quarantine(feed).collect()} == {3: "bad reading", 4: "no time", 7: "no content", 8: "bad reading"}
    raw = spark.createDataFrame([('{"payload": {"content": "x"}}',), ("not json",), (None,)], "value string")
    assert [r.content for r in parse.decode(raw).collect()] == ["x", None, None]
    assert timezone and HEAD


def test_average_lies_between_the_windows_ends(spark):
    m = rows(spark, SPIKE + TREND)
    for name, (keys, size, hop) in windows.AVERAGES.items():
        a = windows.average(m, name)
        w = m.groupBy(F.window("time", size, hop).alias("w"), *keys).agg(F.min("aqi").alias("lo"), F.max("aqi").alias("hi"), F.avg("aqi").alias("mean"))
        both = a.join(w.select(F.col("w.start").alias("time_start"), *keys, "lo", "hi", "mean"), ["time_start", *keys])
        assert both.count() == a.count() == w.count() and both.filter("aqi < lo or aqi > hi or abs(aqi - mean) > 1e-9").count() == 0
        assert sorted(windows.all_averages(m)[name].collect()) == sorted(a.collect())
    assert {r.pollutant for r in windows.average(m, "avg_city_hour", compat=True).collect()} == {"PM25"}
