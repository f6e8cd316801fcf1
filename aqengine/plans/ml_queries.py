"""Clustering, outlier and forecast queries. What SQL can check has SQL; the rest is tested in tests/."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..interim import written
from ..operators import aggregate, clean, cluster, forecast, iforest, series
from ..operators.topk import top_anomalies
from .air_queries import _CLEANED, _SERIES, CUTOFF, _cleaned, plain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _cutoff():
    return F.lit(CUTOFF).cast("timestamp")


def _profiles(spark, sf_dir) -> DataFrame:
    return cluster.assemble(aggregate.site_profile(_cleaned(spark, sf_dir)), cluster.PROFILE, center=False)


def _anomaly_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    a = _cleaned(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    wide = aggregate.pivot_pollutants(a).fillna(0.0, ["OZONE", "PM10", "PM2_5"])
    cols = ["OZONE", "PM10", "PM2_5"]
    return cluster.anomaly_features(wide, cols), [*cols, *[f"{c}_delta" for c in cols], "hour_sin", "hour_cos"]


def _scored(spark, sf_dir) -> DataFrame:
    """Hourly rows with their isolation score. The rows are written once, as they are counted, drawn from and scored."""
    rows, cols = _anomaly_rows(spark, sf_dir)
    rows = written(rows.select("SiteID", "timestamp", *cols), "rows")
    return iforest.isolation_forest_score(rows, iforest.isolation_forest_fit(rows, cols, ["SiteID", "timestamp"]), cols).select("SiteID", "timestamp", "score")


@query()
def cluster_sweep(spark, sf_dir):
    return cluster.sweep_clusters(_profiles(spark, sf_dir))


@query()
def sensor_clusters(spark, sf_dir):
    return cluster.final_clusters(_profiles(spark, sf_dir), 4).select("SiteID", "cluster", "PM25_mean", "OZONE_mean")


def _readings(spark, sf_dir) -> DataFrame:
    """Hourly levels by site, gaps filled with medians, as weighted features."""
    wide = aggregate.pivot_pollutants(_cleaned(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp")))
    return cluster.weighted_features(clean.impute_median(wide, LEVELS), LEVELS)


LEVELS = ["OZONE", "PM10", "PM2_5"]
_WIDE = f"""{_CLEANED}, wide AS (
  SELECT SiteID, date_trunc('hour', "timestamp") AS h, max(Value) FILTER (Parameter = 'OZONE') AS OZONE, max(Value) FILTER (Parameter = 'PM10') AS PM10, max(Value) FILTER (Parameter = 'PM2.5') AS PM2_5 FROM cleaned GROUP BY ALL
), mid AS (SELECT median(OZONE) AS o, median(PM10) AS p, median(PM2_5) AS q FROM wide
), filled AS (SELECT SiteID, h, coalesce(OZONE, o) AS OZONE, coalesce(PM10, p) AS PM10, coalesce(PM2_5, q) AS PM2_5 FROM wide, mid
), scaled AS (
  SELECT SiteID, h, (OZONE - avg(OZONE) OVER ()) / stddev_samp(OZONE) OVER () AS z_OZONE, (PM10 - avg(PM10) OVER ()) / stddev_samp(PM10) OVER () AS z_PM10, (PM2_5 - avg(PM2_5) OVER ()) / stddev_samp(PM2_5) OVER () AS z_PM2_5,
    0.2::DOUBLE * sin(2 * pi() * hour(h) / 24) AS hour_sin, 0.2::DOUBLE * cos(2 * pi() * hour(h) / 24) AS hour_cos FROM filled
)"""


@query(f"""{_WIDE} SELECT SiteID, strftime(h, '%Y-%m-%d %H:%M:%S') AS "timestamp", {", ".join(f"floor({c} * 1000000 + 0.5000371::DOUBLE) / 1000000 AS {c}" for c in ("z_OZONE", "z_PM10", "z_PM2_5", "hour_sin", "hour_cos"))} FROM scaled""")
def weighted_features(spark, sf_dir):
    """Levels on a common scale, and hours that count a fifth."""
    return plain(_readings(spark, sf_dir).select("SiteID", "timestamp", "z_OZONE", "z_PM10", "z_PM2_5", "hour_sin", "hour_cos"), steady=True)


@query(f"""{_WIDE}, f AS (SELECT CASE WHEN z_PM2_5 > 0.5 THEN 2 WHEN z_OZONE > 0.5 THEN 1 ELSE 0 END AS cluster, [z_OZONE, z_PM10, z_PM2_5, hour_sin, hour_cos] AS x, row_number() OVER () AS i FROM scaled
), m AS (SELECT cluster, count(*) AS n, sum(list_inner_product(x, x)) AS q, [sum(x[1]), sum(x[2]), sum(x[3]), sum(x[4]), sum(x[5])] AS s FROM f GROUP BY cluster
), d AS (SELECT f.i, f.cluster, m.cluster AS other, m.n, list_inner_product(x, x) + m.q / m.n - 2 * list_inner_product(x, m.s) / m.n AS d FROM f, m
), s AS (SELECT cluster, i, max(n) FILTER (cluster = other) AS n, max(d * n / (n - 1)) FILTER (cluster = other) AS a, min(d) FILTER (cluster <> other) AS b FROM d GROUP BY cluster, i)
SELECT cluster, count(*) AS size, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s GROUP BY cluster""")
def level_silhouettes(spark, sf_dir):
    """How well three given bands of readings are apart: much fine dust, else much ozone, else the rest."""
    band = F.when(F.col("z_PM2_5") > 0.5, 2).when(F.col("z_OZONE") > 0.5, 1).otherwise(0)
    return plain(cluster.silhouettes(_readings(spark, sf_dir).withColumn("cluster", band), ["z_OZONE", "z_PM10", "z_PM2_5", "hour_sin", "hour_cos"]))


@query()
def cluster_bias(spark, sf_dir):
    """Differences between the clusters of readings, of the number of clusters from 2 to 7 that fits best."""
    rows = written(_readings(spark, sf_dir), "readings")
    found = cluster.final_clusters(rows, cluster.best_k(rows))
    stats = aggregate.cluster_statistics(found, LEVELS)
    return aggregate.cluster_bias(stats, ["mean_PM2_5", "mean_hour"])


@query()
def sensor_components(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    p = cluster.assemble(aggregate.site_profile(_cleaned(spark, sf_dir)), cluster.PROFILE, components=2)
    return p.select("SiteID", vector_to_array("features").alias("components"))


@query()
def isolation_forest(spark, sf_dir):
    scored = written(_scored(spark, sf_dir), "scored")
    return aggregate.flag_iqr(scored, "score", error=0.001).select("SiteID", "timestamp", "score", "is_anomaly")


@query()
def isolation_top(spark, sf_dir):
    return top_anomalies(_scored(spark, sf_dir))


def _spots(spark, sf_dir) -> DataFrame:
    """Each site's mean and largest value on whole tens."""
    p = aggregate.site_profile(_cleaned(spark, sf_dir))
    return p.select(F.col("SiteID").cast("long").alias("id"), (F.round("PM25_mean", -1) / 10).alias("x"), (F.round("OZONE_mean", -1) / 10).alias("y"))


@query(f"""{_CLEANED.replace("WITH", "WITH RECURSIVE", 1)}, p AS (
  SELECT CAST(SiteID AS BIGINT) AS id, round(coalesce(round(round(avg(Value) FILTER (Parameter = 'PM2.5'), 8), 2), 0), -1) / 10 AS x, round(coalesce(round(round(avg(Value) FILTER (Parameter = 'OZONE'), 8), 2), 0), -1) / 10 AS y FROM cleaned GROUP BY SiteID
), near AS (SELECT a.id AS p, b.id AS q FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0
), core AS (SELECT p FROM near GROUP BY p HAVING count(*) >= 5
), links AS (SELECT n.p, n.q FROM near n JOIN core a ON a.p = n.p JOIN core b ON b.p = n.q
), reach AS (SELECT p, p AS q FROM core UNION SELECT r.p, l.q FROM reach r JOIN links l ON l.p = r.q
), label AS (SELECT p, min(q) AS label FROM reach GROUP BY p
), other AS (SELECT n.p, min(l.label) AS label FROM near n JOIN label l ON l.p = n.q GROUP BY n.p)
SELECT id, coalesce(label.label, other.label, -1) AS cluster FROM p LEFT JOIN label ON label.p = id LEFT JOIN other ON other.p = id""")
def dbscan(spark, sf_dir):
    return cluster.dbscan(_spots(spark, sf_dir), "id", ["x", "y"], 1.0, 5)


@query(f"""{_CLEANED.replace("WITH", "WITH RECURSIVE", 1)}, raw AS (
  SELECT CAST(SiteID AS BIGINT) AS id, coalesce(round(round(avg(Value) FILTER (Parameter = 'PM2.5'), 8), 2), 0) AS a, coalesce(round(max(Value) FILTER (Parameter = 'PM2.5'), 2), 0) AS b, coalesce(round(round(stddev_samp(Value) FILTER (Parameter = 'PM2.5'), 8), 2), 0) AS c,
    coalesce(round(round(avg(Value) FILTER (Parameter = 'OZONE'), 8), 2), 0) AS d, coalesce(round(max(Value) FILTER (Parameter = 'OZONE'), 2), 0) AS e FROM cleaned GROUP BY SiteID
), p AS (SELECT id, {", ".join(f"round({x} / stddev_samp({x}) OVER (), 6) AS {x}" for x in "abcde")} FROM raw
), near AS (SELECT p.id AS p, q.id AS q FROM p, p q WHERE {" + ".join(f"(p.{x} - q.{x}) * (p.{x} - q.{x})" for x in "abcde")} <= 1.0
), core AS (SELECT p FROM near GROUP BY p HAVING count(*) >= 5
), links AS (SELECT n.p, n.q FROM near n JOIN core a ON a.p = n.p JOIN core b ON b.p = n.q
), reach AS (SELECT p, p AS q FROM core UNION SELECT r.p, l.q FROM reach r JOIN links l ON l.p = r.q
), label AS (SELECT p, min(q) AS label FROM reach GROUP BY p
), other AS (SELECT n.p, min(l.label) AS label FROM near n JOIN label l ON l.p = n.q GROUP BY n.p)
SELECT id, coalesce(label.label, other.label, -1) AS cluster FROM p LEFT JOIN label ON label.p = id LEFT JOIN other ON other.p = id""")
def dbscan_profiles(spark, sf_dir):
    """Density clusters of sites by their five profile columns on a common scale."""
    p = cluster.scaled_profiles(written(aggregate.site_profile(_cleaned(spark, sf_dir)).select("SiteID", *cluster.PROFILE), "profiles"))
    return cluster.dbscan(p.withColumn("id", F.col("SiteID").cast("long")), "id", cluster.PROFILE, 1.0, 5)


@query()
def dbscan_sweep(spark, sf_dir):
    return cluster.dbscan_sweep(_spots(spark, sf_dir), "id", ["x", "y"])


@query()
def forecast_linear(spark, sf_dir):
    return plain(forecast.forecast_linear(fx.series(spark, sf_dir), _cutoff()))


_USABLE = f"""{_SERIES}, l AS (SELECT SiteID, "timestamp" AS t, PM25, lag(PM25, 24) OVER (PARTITION BY SiteID ORDER BY series."timestamp") AS far, count(*) OVER (PARTITION BY SiteID) AS n FROM series),
usable AS (SELECT SiteID, t, PM25, count(*) FILTER (t < TIMESTAMP '{CUTOFF}') OVER (PARTITION BY SiteID) AS train, count(*) FILTER (t >= TIMESTAMP '{CUTOFF}') OVER (PARTITION BY SiteID) AS test FROM l WHERE far IS NOT NULL AND n >= 200
  QUALIFY train >= 150 AND test > 0)"""


@query(f"""{_USABLE} SELECT SiteID, count(*) FILTER (t < TIMESTAMP '{CUTOFF}') AS train, count(*) FILTER (t >= TIMESTAMP '{CUTOFF}') AS test, 1::BIGINT AS next, true AS centred, true AS orthogonal FROM usable GROUP BY SiteID""")
def forecast_linear_fit(spark, sf_dir):
    """Each site's rows by kind, the next one included; and what least squares promise of the training residuals: a sum of nothing, and none with a lag."""
    s = fx.series(spark, sf_dir)
    rows = forecast.forecast_linear(s, _cutoff()).join(series.add_lags(s, (1,)).select("SiteID", "timestamp", "lag_1"), ["SiteID", "timestamp"], "left")
    n = lambda kind: F.count_if(F.col("Forecast_Type") == kind)
    rest = F.when(F.col("Forecast_Type") == "Train", F.col("Actual_PM25") - F.col("Predicted_PM25"))
    return rows.groupBy("SiteID").agg(n("Train").alias("train"), n("Test").alias("test"), n("Next").alias("next"), (F.abs(F.avg(rest)) < 1e-6).alias("centred"), (F.abs(F.avg(rest * F.col("lag_1"))) < 1e-4).alias("orthogonal"))


@query(f"""{_USABLE}, d AS (SELECT *, row_number() OVER (PARTITION BY SiteID ORDER BY t DESC) AS r FROM usable)
SELECT SiteID, strftime(max(t) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "timestamp", round(max(PM25) FILTER (r = 1), 6) AS lag_1, round(max(PM25) FILTER (r = 2), 6) AS lag_2, round(max(PM25) FILTER (r = 3), 6) AS lag_3, round(max(PM25) FILTER (r = 24), 6) AS lag_24 FROM d GROUP BY SiteID""")
def forecast_next_rows(spark, sf_dir):
    f, xs = forecast.features(fx.series(spark, sf_dir))
    return plain(forecast.next_rows(forecast.usable(f, xs, _cutoff(), "hourly")).select("SiteID", "timestamp", "lag_1", "lag_2", "lag_3", "lag_24"))


@query()
def forecast_linear_metrics(spark, sf_dir):
    return aggregate.forecast_metrics(forecast.forecast_linear(fx.series(spark, sf_dir), _cutoff()))


@query(f"""{_SERIES}, t AS (SELECT SiteID, PM25 AS y, lag(PM25) OVER (PARTITION BY SiteID ORDER BY series."timestamp") AS x, "timestamp" FROM series)
SELECT SiteID, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM t WHERE x IS NOT NULL AND "timestamp" < TIMESTAMP '{CUTOFF}' GROUP BY SiteID HAVING count(*) >= 30""")
def lag_regression(spark, sf_dir):
    f = series.add_lags(fx.series(spark, sf_dir), (1,)).filter(F.col("lag_1").isNotNull() & (F.col("timestamp") < _cutoff()))
    beta = forecast.solve(forecast.normal_equations(f, ["lag_1"]), 2).filter("n >= 30")
    return plain(beta.select("SiteID", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope")))


@query(f"""{_SERIES}, w AS (SELECT SiteID, "timestamp", lag(PM25, 24) OVER (PARTITION BY SiteID ORDER BY series."timestamp") AS far FROM series),
g AS (SELECT SiteID, count(*) AS rows, count(*) FILTER (far IS NOT NULL AND "timestamp" < TIMESTAMP '{CUTOFF}') AS train, count(*) FILTER (far IS NOT NULL AND "timestamp" >= TIMESTAMP '{CUTOFF}') AS test FROM w GROUP BY SiteID)
SELECT SiteID, rows, CASE WHEN rows < 200 THEN 'too few rows' WHEN train < 150 THEN 'too few training rows' WHEN test = 0 THEN 'no test rows' ELSE 'ok' END AS status FROM g""")
def site_status(spark, sf_dir):
    return forecast.site_status(fx.series(spark, sf_dir), _cutoff())


@query()
def forecast_gbt(spark, sf_dir):
    return aggregate.forecast_metrics(forecast.forecast_gbt(fx.series(spark, sf_dir), _cutoff()))


@query()
def tune_gbt(spark, sf_dir):
    return forecast.tune_gbt(fx.series(spark, sf_dir), _cutoff())


@query(f"""{_SERIES}, t AS (SELECT SiteID, series."timestamp" AS t, PM25 AS y, lag(PM25) OVER (PARTITION BY SiteID ORDER BY series."timestamp") AS x FROM series),
w AS (SELECT SiteID, t, y, x, count(*) OVER b AS n, regr_slope(y, x) OVER b AS slope, regr_intercept(y, x) OVER b AS intercept FROM t WHERE x IS NOT NULL WINDOW b AS (PARTITION BY SiteID ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT SiteID, strftime(t, '%Y-%m-%d %H:%M:%S') AS "timestamp", round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(intercept + slope * x, 4) AS predicted FROM w WHERE t >= TIMESTAMP '{CUTOFF}' AND n >= 30""")
def walk_forward_fit(spark, sf_dir):
    """A one-lag model for each hour of the test time, refitted on all hours before it."""
    w = forecast.walk_forward_fit(fx.series(spark, sf_dir), _cutoff())
    return plain(w.select("SiteID", "timestamp", F.round(F.col("beta")[1], 5).alias("slope"), F.round(F.col("beta")[0], 4).alias("intercept"), F.round("predicted", 4).alias("predicted")))


@query(f"""{_SERIES}, marked AS (SELECT *, percent_rank() OVER (PARTITION BY SiteID ORDER BY series."timestamp") < 0.8 AS train FROM series),
f AS (SELECT SiteID, min(PM25) AS lo, max(PM25) AS hi FROM marked WHERE train GROUP BY SiteID),
x AS (SELECT SiteID, train, marked."timestamp", CASE WHEN hi = lo THEN 0 ELSE (PM25 - lo) / (hi - lo) END AS v FROM marked JOIN f USING (SiteID)),
s AS (SELECT SiteID, train, x."timestamp", v, count(*) OVER (PARTITION BY SiteID ORDER BY x."timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n, sum(v) OVER (PARTITION BY SiteID ORDER BY x."timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS total FROM x)
SELECT SiteID, CASE WHEN train THEN 'Train' ELSE 'Test' END AS split, strftime(s."timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", round(v, 6) AS target, round(total, 4) AS total FROM s WHERE n = 24""")
def sequence_dataset(spark, sf_dir):
    d = series.sequence_dataset(fx.series(spark, sf_dir))
    total = F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 4)
    return plain(d.select("SiteID", "split", "timestamp", "target", total.alias("total")))
