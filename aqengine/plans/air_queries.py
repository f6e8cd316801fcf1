"""Queries over feeds, windows, archives and series, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.aqi import aqi_band, severity
from ..operators import aggregate, clean, joins, parse, series, sets, stateful, topk, windows
from ..schemas import STATE_CODES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss", "'%Y-%m-%d %H:%M:%S'"
CUTOFF = "2024-01-24 00:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def stamp(c: str | Column) -> Column:
    return F.date_format(c, STAMP)


def plain(df: DataFrame, steady: bool = False) -> DataFrame:
    """Times as text and fractions to six digits, so that two engines' results can be compared. ``steady`` puts the border between
    two results beside the half, where values that are sums of decimal fractions often lie."""
    short = (lambda c: F.floor(F.col(c) * 1000000 + 0.5000371) / 1000000) if steady else (lambda c: F.round(c, 6))
    return df.select(*[stamp(c).alias(c) if t.startswith("timestamp") else short(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def sql_steady(x: str) -> str:
    return f"floor({x} * 1000000 + 0.5000371::DOUBLE) / 1000000"


def sql_stamp(x: str) -> str:
    return f"strftime({x}, {SQL_STAMP})"


# Windows -------------------------------------------------------------------------------------------------------------


def _average_sql(keys: tuple[str, ...], size: int, hop: int) -> str:
    cols = ", ".join(keys)
    return f"""{fx.with_views("measurements")}, hops AS (
  SELECT {cols}, aqi, (epoch_us(time) // {hop}000000 - k) * {hop} AS s FROM measurements, range({size // hop}) r(k)
)
SELECT {sql_stamp("make_timestamp(s * 1000000)")} AS time_start, {sql_stamp(f"make_timestamp((s + {size}) * 1000000)")} AS time_end, {cols}, round(avg(aqi), 6) AS aqi
FROM hops GROUP BY s, {cols}"""


def _add_averages() -> None:
    for name, (keys, size, hop) in windows.AVERAGES.items():
        QUERIES[name] = lambda spark, sf_dir, name=name: plain(windows.average(fx.measurements(spark, sf_dir), name))
        ORACLES[name] = _average_sql(keys, windows.seconds(size), windows.seconds(hop))


_add_averages()


def _maximum_sql(keys: tuple[str, ...]) -> str:
    cols = ", ".join(keys)
    return f"""{fx.with_views("measurements")}
SELECT {sql_stamp("h")} AS time_start, {sql_stamp("h + INTERVAL 1 HOUR")} AS time_end, {cols}, aqi FROM (
  SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS h, {cols}, greatest(0, max(aqi)) AS aqi FROM measurements GROUP BY ALL)"""


@query(_maximum_sql(windows.CITY))
def max_city_hour(spark, sf_dir):
    return plain(windows.max_city_hour(fx.measurements(spark, sf_dir)))


@query(_maximum_sql(windows.STATE))
def max_state_hour(spark, sf_dir):
    return plain(windows.max_state_hour(fx.measurements(spark, sf_dir)))


@query(
    f"""{fx.with_views("measurements")}, hops AS (
  SELECT name, CASE WHEN name LIKE '%city%' THEN city END AS city, state, pollutant, aqi, CAST(hop AS BIGINT) * (epoch_us(time) // (CAST(hop AS BIGINT) * 1000000) - k) AS s
  FROM measurements, (VALUES {", ".join(f"('{n}', {windows.seconds(s)}, {windows.seconds(h)})" for n, (_, s, h) in windows.AVERAGES.items())}) v(name, size, hop), range(4) r(k)
  WHERE k < size // hop
)
SELECT name, count(*) AS n_windows, round(avg(aqi), 6) AS mean_aqi FROM (SELECT name, city, state, pollutant, s, avg(aqi) AS aqi FROM hops GROUP BY ALL) GROUP BY name"""
)
def all_averages(spark, sf_dir):
    every = windows.all_averages(fx.measurements(spark, sf_dir))
    return plain(sets.union_all(*[df.groupBy(F.lit(n).alias("name")).agg(F.count("*").alias("n_windows"), F.avg("aqi").alias("mean_aqi")) for n, df in every.items()]))


# Feed ----------------------------------------------------------------------------------------------------------------


def _concentration_sql() -> str:
    from ..functions.aqi import BANDS, CONCENTRATIONS

    cases = [f"WHEN pollutant = '{p}' AND aqi BETWEEN {lo} AND {hi} THEN ({b} - {a})::DOUBLE / ({hi} - {lo}) * (aqi - {lo}) + {a}" for p, ends in CONCENTRATIONS.items() for (lo, hi), (a, b) in zip(BANDS, ends, strict=True)]
    return f"round(CASE {' '.join(cases)} END, 6)"


_BAND_SQL = "CASE WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for sensitive groups' WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"
_SEVERITY_SQL = "CASE WHEN aqi > 200 THEN 'CRITICAL' WHEN aqi > 150 THEN 'HIGH' WHEN aqi <= 50 THEN 'LOW' ELSE 'MEDIUM' END"


@query(f"""{fx.with_views("measurements")}
SELECT event_id, {sql_stamp("date_trunc('second', time)")} AS time, city, state, pollutant, aqi, string_split({_BAND_SQL}, ' ')[-1] AS category, {_concentration_sql()} AS concentration, {_BAND_SQL} AS band FROM measurements""")
def parse_feed(spark, sf_dir):
    return plain(parse.parse_feed(fx.feed(spark, sf_dir), "event_id"))


@query("""SELECT CASE WHEN event_id % 11 = 0 THEN 'no time' WHEN event_id % 13 = 0 THEN 'bad reading' ELSE 'no content' END AS rejected, count(*) AS n
FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 GROUP BY ALL""")
def feed_quarantine(spark, sf_dir):
    e = F.col("event_id")
    spoilt = F.when(e % 11 == 0, F.regexp_replace("content", "Last Update: [^<]+", "")).when(e % 13 == 0, F.regexp_replace("content", r" AQI - [^<]+", " AQI - Particle Pollution (7 microns)")).when(e % 17 == 0, None).otherwise(F.col("content"))
    return parse.quarantine(fx.feed(spark, sf_dir).withColumn("content", spoilt)).groupBy("rejected").agg(F.count("*").alias("n"))


@query(f"""{fx.with_views("measurements")} SELECT DISTINCT pollutant, aqi, {_concentration_sql()} AS concentration FROM measurements""")
def aqi_concentration(spark, sf_dir):
    return plain(fx.measurements(spark, sf_dir).select("pollutant", "aqi", "concentration").distinct())


@query(f"""{fx.with_views("measurements")} SELECT pollutant, {_BAND_SQL} AS band, {_SEVERITY_SQL} AS severity, count(*) AS n FROM measurements GROUP BY ALL""")
def aqi_bands(spark, sf_dir):
    return fx.measurements(spark, sf_dir).groupBy("pollutant", aqi_band("aqi").alias("band"), severity("aqi").alias("severity")).agg(F.count("*").alias("n"))


@query(f"""{fx.with_views("measurements")} SELECT name, count(*) AS n, CAST(sum(aqi) AS BIGINT) AS total FROM (
  SELECT 'O3' AS name, aqi FROM measurements WHERE pollutant = 'O3' UNION ALL SELECT 'PM2.5', aqi FROM measurements WHERE pollutant = 'PM2.5'
  UNION ALL SELECT 'PM10', aqi FROM measurements WHERE pollutant = 'PM10' UNION ALL SELECT 'high', aqi FROM measurements WHERE aqi >= 100) GROUP BY name""")
def branches(spark, sf_dir):
    m = fx.measurements(spark, sf_dir)
    parts = [parse.branch(m, p).select(F.lit(p).alias("name"), "aqi") for p in ("O3", "PM2.5", "PM10")] + [parse.high(m).select(F.lit("high").alias("name"), "aqi")]
    return sets.union_all(*parts).groupBy("name").agg(F.count("*").alias("n"), F.sum("aqi").alias("total"))


# Archive -------------------------------------------------------------------------------------------------------------

_KNOWN = ", ".join(f"'{s}'" for s in STATE_CODES)
_CLEANED = f"""{fx.with_views("archive")}, known AS (
  SELECT SiteID, "timestamp", Parameter, Unit, StateCode, CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 = 0 THEN '-1' WHEN event_id % 83 = 0 THEN '9999' ELSE CAST(Value AS VARCHAR) END AS Text, Value, event_id
  FROM archive WHERE StateCode IN ({_KNOWN}) AND Parameter IN ('OZONE', 'PM2.5', 'PM10')
), one AS (
  SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY SiteID, "timestamp", Parameter ORDER BY event_id) = 1
), cleaned AS (
  SELECT * FROM one WHERE Value IS NOT NULL AND Value >= 0 AND Value <= CASE Parameter WHEN 'PM10' THEN 650 ELSE 500 END AND "timestamp" IS NOT NULL
)"""


def _archive(spark, sf_dir) -> DataFrame:
    """Known rows of the archive, the first event of each key."""
    return clean.deduplicated(clean.known_parameters(clean.known_states(fx.archive(spark, sf_dir))), order=("event_id",))


def _cleaned(spark, sf_dir) -> DataFrame:
    return clean.plausible(clean.numeric(_archive(spark, sf_dir)))


@query(f"""{_CLEANED} SELECT SiteID, {sql_stamp('"timestamp"')} AS "timestamp", StateCode, Parameter, Unit, round(Value, 6) AS Value FROM cleaned""")
def clean_archive(spark, sf_dir):
    return plain(_cleaned(spark, sf_dir).select("SiteID", "timestamp", "StateCode", "Parameter", "Unit", "Value"))


@query(f"""{_CLEANED} SELECT Parameter, count(Value) AS count, count(*) - count(Value) AS nulls, round(min(Value), 2) AS min, round(max(Value), 2) AS max, round(round(avg(Value), 8), 2) AS mean, round(round(stddev_samp(Value), 8), 2) AS stddev FROM one GROUP BY Parameter""")
def quality_profile(spark, sf_dir):
    return clean.quality_profile(clean.numeric(_archive(spark, sf_dir)))


@query(f"""{_CLEANED} SELECT SiteID, {sql_stamp('"timestamp"')} AS "timestamp", round(max(Value) FILTER (Parameter = 'OZONE'), 6) AS OZONE, round(max(Value) FILTER (Parameter = 'PM10'), 6) AS PM10, round(max(Value) FILTER (Parameter = 'PM2.5'), 6) AS PM2_5 FROM cleaned GROUP BY SiteID, cleaned."timestamp" """)
def pivot_pollutants(spark, sf_dir):
    return plain(aggregate.pivot_pollutants(_cleaned(spark, sf_dir)))


@query(f"""{_CLEANED}, wide AS (
  SELECT SiteID, date_trunc('hour', "timestamp") AS h, max(Value) FILTER (Parameter = 'OZONE') AS OZONE, max(Value) FILTER (Parameter = 'PM10') AS PM10, max(Value) FILTER (Parameter = 'PM2.5') AS PM2_5 FROM cleaned GROUP BY ALL
), mid AS (SELECT median(OZONE) AS o, median(PM10) AS p, median(PM2_5) AS q FROM wide)
SELECT SiteID, {sql_stamp("h")} AS "timestamp", round(coalesce(OZONE, o), 6) AS OZONE, round(coalesce(PM10, p), 6) AS PM10, round(coalesce(PM2_5, q), 6) AS PM2_5 FROM wide, mid""")
def impute_median(spark, sf_dir):
    a = _cleaned(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return plain(clean.impute_median(aggregate.pivot_pollutants(a), ["OZONE", "PM10", "PM2_5"]))


@query(f"""{_CLEANED}, wide AS (
  SELECT SiteID, "timestamp", max(Value) FILTER (Parameter = 'OZONE') AS OZONE FROM cleaned GROUP BY ALL
)
SELECT SiteID, {sql_stamp('"timestamp"')} AS "timestamp", round(coalesce(last_value(OZONE IGNORE NULLS) OVER (PARTITION BY SiteID ORDER BY wide."timestamp" ROWS UNBOUNDED PRECEDING), first_value(OZONE IGNORE NULLS) OVER (PARTITION BY SiteID ORDER BY wide."timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS OZONE FROM wide""")
def fill_gaps(spark, sf_dir):
    return plain(clean.fill_gaps(aggregate.pivot_pollutants(_cleaned(spark, sf_dir)), "OZONE").select("SiteID", "timestamp", "OZONE"))


@query(f"""{_CLEANED} SELECT SiteID, coalesce(round(round(avg(Value) FILTER (Parameter = 'PM2.5'), 8), 2), 0) AS PM25_mean, coalesce(round(max(Value) FILTER (Parameter = 'PM2.5'), 2), 0) AS PM25_max, coalesce(round(round(stddev_samp(Value) FILTER (Parameter = 'PM2.5'), 8), 2), 0) AS PM25_std,
  coalesce(round(round(avg(Value) FILTER (Parameter = 'OZONE'), 8), 2), 0) AS OZONE_mean, coalesce(round(max(Value) FILTER (Parameter = 'OZONE'), 2), 0) AS OZONE_max FROM cleaned GROUP BY SiteID""")
def site_profile(spark, sf_dir):
    return aggregate.site_profile(_cleaned(spark, sf_dir)).drop("PM25_max_log", "PM25_std_log", "OZONE_max_log")


@query(f"""{_CLEANED} SELECT * FROM (SELECT 'Parameter' AS field, Parameter AS value, count(*) AS count FROM cleaned GROUP BY ALL UNION ALL SELECT 'Unit', Unit, count(*) FROM cleaned GROUP BY ALL
  UNION ALL (SELECT 'StateCode', StateCode, count(*) AS n FROM cleaned GROUP BY ALL ORDER BY n DESC, StateCode LIMIT 10))""")
def eda_counts(spark, sf_dir):
    a = _cleaned(spark, sf_dir)
    return sets.union_all(*[aggregate.counts(a, c, n).select(F.lit(c).alias("field"), "value", "count") for c, n in (("Parameter", None), ("Unit", None), ("StateCode", 10))])


@query(f"""{_CLEANED} SELECT count(*) AS rows, count(DISTINCT SiteID) AS sites, {sql_stamp('min("timestamp")')} AS first, {sql_stamp('max("timestamp")')} AS last FROM cleaned""")
def archive_overview(spark, sf_dir):
    return plain(aggregate.overview(_cleaned(spark, sf_dir)))


@query(f"""{_CLEANED} SELECT 'Value' AS "column", count(Value) AS count, round(avg(Value), 6) AS mean, round(stddev_samp(Value), 6) AS stddev, round(min(Value), 6) AS min, round(max(Value), 6) AS max FROM cleaned""")
def describe_values(spark, sf_dir):
    return plain(aggregate.describe(_cleaned(spark, sf_dir), ["Value"]))


@query(f"""{_CLEANED} SELECT SiteID, count(*) AS count FROM cleaned GROUP BY SiteID ORDER BY count DESC, SiteID LIMIT 20""")
def top_sensors(spark, sf_dir):
    return topk.top_sensors(_cleaned(spark, sf_dir))


@query(f"""{_CLEANED} SELECT SiteID, count(*) AS count FROM cleaned GROUP BY SiteID ORDER BY count DESC, SiteID LIMIT 1""")
def busiest_site(spark, sf_dir):
    return topk.busiest_site(_cleaned(spark, sf_dir))


@query(f"""{_CLEANED} SELECT SiteID, {sql_stamp('"timestamp"')} AS "timestamp", Parameter, round(Value, 6) AS Value FROM cleaned WHERE SiteID IN (SELECT SiteID FROM cleaned GROUP BY SiteID ORDER BY count(*) DESC, SiteID LIMIT 20)""")
def top_sensor_rows(spark, sf_dir):
    return plain(joins.of_top_sensors(_cleaned(spark, sf_dir)).select("SiteID", "timestamp", "Parameter", "Value"))


@query(f"""{_CLEANED}, q AS (SELECT quantile_cont(Value, 0.25) AS q1, quantile_cont(Value, 0.75) AS q3 FROM cleaned)
SELECT SiteID, Parameter, round(Value, 6) AS Value, CAST(Value > q3 + 0.5 * (q3 - q1) AS INT) AS is_anomaly FROM cleaned, q""")
def flag_iqr(spark, sf_dir):
    return plain(aggregate.flag_iqr(_cleaned(spark, sf_dir), "Value", 0.5).select("SiteID", "Parameter", "Value", "is_anomaly"))


@query(f"""{_CLEANED}, q AS (SELECT quantile_cont(Value, 0.25) AS q1, quantile_cont(Value, 0.75) AS q3 FROM cleaned)
SELECT CAST(sum(CAST(Value > q3 + 0.5 * (q3 - q1) AS INT)) AS BIGINT) AS anomalies, count(*) AS total, round(100 * avg(CAST(Value > q3 + 0.5 * (q3 - q1) AS INT)), 2) AS percent FROM cleaned, q""")
def anomaly_share(spark, sf_dir):
    return aggregate.anomaly_share(aggregate.flag_iqr(_cleaned(spark, sf_dir), "Value", 0.5))


@query(f"""{_CLEANED}, e AS (SELECT min(Value) AS lo, max(Value) AS hi FROM cleaned)
SELECT CAST(bin AS INT) AS bin, round(lo + bin * ((hi - lo) / 50), 6) AS low, count(*) AS count FROM (SELECT lo, hi, least(49, floor((Value - lo) / ((hi - lo) / 50))) AS bin FROM cleaned, e) GROUP BY bin, lo, hi""")
def score_histogram(spark, sf_dir):
    return plain(aggregate.histogram(_cleaned(spark, sf_dir), "Value"))


# Series --------------------------------------------------------------------------------------------------------------

_SERIES = fx.with_views("series")
_W = 'OVER (PARTITION BY SiteID ORDER BY series."timestamp")'
_TS = f"""SiteID, {sql_stamp('"timestamp"')} AS "timestamp" """


@query(f"""{_SERIES} SELECT SiteID, strftime("timestamp", '%Y-%m-%d') AS "Date", round(avg(PM25), 6) AS PM25 FROM series GROUP BY ALL""")
def daily_mean(spark, sf_dir):
    d = aggregate.daily_mean(fx.series(spark, sf_dir))
    return plain(d.withColumn("Date", F.date_format("Date", "yyyy-MM-dd")))


@query(f"""{_SERIES} SELECT {_TS}, round(PM25, 6) AS PM25, round(lag(PM25) {_W}, 6) AS PM25_lag1, round(PM25 - lag(PM25) {_W}, 6) AS PM25_delta FROM series""")
def lags_deltas(spark, sf_dir):
    return plain(series.lags_deltas(fx.series(spark, sf_dir), ["PM25"]))


@query(f"""{_SERIES} SELECT {_TS}, round(PM25, 6) AS PM25, {", ".join(f"round(lag(PM25, {k}) {_W}, 6) AS lag_{k}" for k in (1, 2, 3, 24))},
  round(sin(((dayofweek("timestamp") + 6) % 7) * 2 * pi() / 7), 6) AS dow_sin, round(cos(((dayofweek("timestamp") + 6) % 7) * 2 * pi() / 7), 6) AS dow_cos,
  round(sin(hour("timestamp") * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour("timestamp") * 2 * pi() / 24), 6) AS hour_cos FROM series""")
def forecast_features(spark, sf_dir):
    f = plain(series.calendar(series.add_lags(fx.series(spark, sf_dir))))
    return f.withColumns({c: F.col(c) + F.lit(0.0) for c in ("dow_sin", "dow_cos", "hour_sin", "hour_cos")})


@query(f"""{_SERIES} SELECT {_TS}, round(PM25, 6) AS "Actual_PM25", round(lag(PM25) {_W}, 6) AS "Naive_PM25" FROM series""")
def naive_baseline(spark, sf_dir):
    return plain(series.naive_baseline(fx.series(spark, sf_dir).withColumnRenamed("PM25", "Actual_PM25")))


@query(f"""{_SERIES}, x AS (SELECT SiteID, "timestamp", PM25, list(PM25) OVER (PARTITION BY SiteID ORDER BY series."timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS s FROM series)
SELECT {_TS}, round(PM25, 6) AS target, round(list_sum(s), 6) AS total, round(s[1], 6) AS first, round(s[24], 6) AS last FROM x WHERE len(s) = 24""")
def make_sequences(spark, sf_dir):
    q = series.make_sequences(fx.series(spark, sf_dir))
    return plain(q.select("SiteID", "timestamp", "target", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("sequence", 1).alias("first"), F.element_at("sequence", 24).alias("last")))


@query(f"""{_SERIES}, l AS (SELECT SiteID, "timestamp", PM25, lag(PM25, 1) {_W} AS a, lag(PM25, 24) {_W} AS b FROM series), m AS (
  SELECT 'lag_1' AS Model_Name, PM25 AS y, a AS p, "timestamp" FROM l UNION ALL SELECT 'lag_24', PM25, b, "timestamp" FROM l)
SELECT Model_Name, 'Test' AS "Forecast_Type", count(*) AS n, round(avg(abs(y - p)), 2) AS "MAE", round(sqrt(avg((y - p) * (y - p))), 2) AS "RMSE", round(pow(corr(y, p), 2), 4) AS "R2" FROM m WHERE p IS NOT NULL AND "timestamp" >= TIMESTAMP '{CUTOFF}' GROUP BY Model_Name""")
def walk_forward(spark, sf_dir):
    return aggregate.forecast_metrics(series.walk_forward(fx.series(spark, sf_dir), F.lit(CUTOFF).cast("timestamp")))


@query(f"""{_SERIES}, l AS (SELECT PM25 AS y, lag(PM25) {_W} AS p FROM series)
SELECT round(avg(abs(y - p)), 6) AS "MAE", round(avg((y - p) * (y - p)), 6) AS "MSE", round(sqrt(avg((y - p) * (y - p))), 6) AS "RMSE", round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS "R2" FROM l WHERE p IS NOT NULL""")
def regression_metrics(spark, sf_dir):
    return plain(aggregate.regression_metrics(series.naive_baseline(fx.series(spark, sf_dir), "PM25"), "PM25", "Naive_PM25"))


@query(f"""{_SERIES}, l AS (SELECT SiteID, "timestamp", PM25, lag(PM25, 1) {_W} AS a, lag(PM25, 24) {_W} AS b FROM series)
SELECT {_TS}, round(PM25, 6) AS "Actual_PM25", round(a, 6) AS lag_1, round(b, 6) AS lag_24 FROM l WHERE "timestamp" >= TIMESTAMP '{CUTOFF}'""")
def pivot_models(spark, sf_dir):
    return plain(aggregate.pivot_models(series.walk_forward(fx.series(spark, sf_dir), F.lit(CUTOFF).cast("timestamp")), ["lag_1", "lag_24"]))


@query()
def pivot_sensors(spark, sf_dir):
    """A column for each site there is, so SQL without a pivot can't say it; ``sensors_by_time`` holds the same means as a map, which it can."""
    s = fx.series(spark, sf_dir)
    sites = sorted(r["SiteID"] for r in s.select("SiteID").distinct().collect())  # these become the columns
    p = aggregate.pivot_sensors(s, sites)
    return p.select(stamp("timestamp").alias("timestamp"), *[F.round(f"`{x}`", 6).alias(x) for x in sites])


@query(f"""{_SERIES}, m AS (SELECT series."timestamp" AS t, SiteID, round(avg(PM25), 6) AS v FROM series GROUP BY ALL)
SELECT {sql_stamp("t")} AS "timestamp", count(*) AS sites, string_agg(SiteID, ',' ORDER BY SiteID) AS names, round(sum(v), 4) AS total FROM m GROUP BY t""")
def sensors_by_time(spark, sf_dir):
    """Means of all sites at a time as a map, however many sites there are."""
    m = aggregate.sensors_by_time(fx.series(spark, sf_dir))
    total = F.aggregate(F.map_values("means"), F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return m.select(stamp("timestamp").alias("timestamp"), F.size("means").cast("long").alias("sites"), F.array_join(F.array_sort(F.map_keys("means")), ",").alias("names"), F.round(total, 4).alias("total"))


@query(f"""{_SERIES}, f AS (SELECT SiteID, min(PM25) AS lo, max(PM25) AS hi FROM series GROUP BY SiteID)
SELECT {_TS}, round(PM25, 6) AS PM25, round(CASE WHEN hi = lo THEN 0 ELSE (PM25 - lo) / (hi - lo) END, 6) AS "PM25_scaled" FROM series JOIN f USING (SiteID)""")
def minmax_scale(spark, sf_dir):
    s = fx.series(spark, sf_dir)
    return plain(series.minmax_scale(s, series.minmax_fit(s)))


@query(f"""{_SERIES}, l AS (SELECT SiteID, "timestamp", epoch(series."timestamp") - epoch(lag(series."timestamp") {_W}) AS s FROM series)
SELECT {_TS}, CAST(s AS BIGINT) AS seconds_since FROM l WHERE s > 3600""")
def series_gaps(spark, sf_dir):
    return plain(series.gaps(fx.series(spark, sf_dir)))


# States, alerts ------------------------------------------------------------------------------------------------------


def _folded(spark, sf_dir) -> DataFrame:
    return stateful.ema_zscore(fx.measurements(spark, sf_dir))


_FOLD = f"""{fx.with_views("measurements").replace("WITH", "WITH RECURSIVE", 1)}, o AS (
  SELECT city, state, pollutant, time, event_id, CAST(aqi AS DOUBLE) AS x, row_number() OVER (PARTITION BY city, state, pollutant ORDER BY time, event_id) AS n FROM measurements
), f AS (
  SELECT city, state, pollutant, time, event_id, x, n, x AS ema, 0.0::DOUBLE AS v, x AS e1, x AS e2, 0.0::DOUBLE AS z FROM o WHERE n = 1
  UNION ALL
  SELECT o.city, o.state, o.pollutant, o.time, o.event_id, o.x, o.n, f.ema + 0.1::DOUBLE * (o.x - f.ema), 0.9::DOUBLE * (f.v + 0.1::DOUBLE * (o.x - f.ema) * (o.x - f.ema)),
    0.2::DOUBLE * o.x + 0.8::DOUBLE * f.e1, 0.2::DOUBLE * (0.2::DOUBLE * o.x + 0.8::DOUBLE * f.e1) + 0.8::DOUBLE * f.e2, CASE WHEN f.v > 0 THEN abs(o.x - f.ema) / sqrt(f.v) ELSE 0 END
  FROM f JOIN o ON o.city = f.city AND o.state = f.state AND o.pollutant = f.pollutant AND o.n = f.n + 1
), r AS (
  SELECT *, CASE WHEN n > 20 THEN 0.25 * (e1 - e2) ELSE 0 END AS trend, CASE WHEN n > 20 THEN 2 * e1 - e2 + 0.5 * (e1 - e2) ELSE 0 END AS predicted FROM f
)"""


@query(f"""{_FOLD} SELECT event_id, city, state, pollutant, x AS aqi, n AS count, {sql_steady("ema")} AS ema, {sql_steady("v")} AS emvar, {sql_steady("z")} AS z, {sql_steady("trend")} AS trend, {sql_steady("predicted")} AS predicted FROM r""")
def ema_zscore(spark, sf_dir):
    return plain(_folded(spark, sf_dir).select("event_id", "city", "state", "pollutant", "aqi", "count", "ema", "emvar", "z", "trend", "predicted"), steady=True)


@query(f"""{_FOLD} SELECT {sql_stamp("time")} AS time, city, state, pollutant, x AS aqi, {sql_steady("ema")} AS expected_aqi, {sql_steady("z")} AS z_score FROM r WHERE n > 20 AND z > 3""")
def anomaly_alerts(spark, sf_dir):
    return plain(stateful.anomaly_alerts(_folded(spark, sf_dir)), steady=True)


@query(f"""{_FOLD} SELECT {sql_stamp("time")} AS time, city, state, pollutant, x AS current_aqi, {sql_steady("predicted")} AS predicted_aqi, {sql_steady("trend")} AS trend, 2 AS forecast_steps FROM r WHERE n > 20 AND x < 100 AND predicted >= 100""")
def forecast_alerts(spark, sf_dir):
    return plain(stateful.forecast_alerts(_folded(spark, sf_dir)), steady=True)


_DEDUP = f"""{fx.with_views("measurements").replace("WITH", "WITH RECURSIVE", 1)}, o AS (
  SELECT city, state, pollutant, category, time, event_id, aqi, row_number() OVER (PARTITION BY city, state, pollutant, category ORDER BY time, event_id) AS n
  FROM (SELECT *, {_BAND_SQL} AS category FROM measurements WHERE aqi >= 100)
), f AS (
  SELECT *, time AS last, true AS sent FROM o WHERE n = 1
  UNION ALL
  SELECT o.*, CASE WHEN o.time - f.last >= INTERVAL 6 HOUR THEN o.time ELSE f.last END, o.time - f.last >= INTERVAL 6 HOUR
  FROM f JOIN o ON o.city = f.city AND o.state = f.state AND o.pollutant = f.pollutant AND o.category = f.category AND o.n = f.n + 1
)"""


def alerts(spark, sf_dir) -> DataFrame:
    """High measurements, as alerts."""
    return parse.high(fx.measurements(spark, sf_dir)).select("event_id", "time", "city", "state", "pollutant", "aqi", "category", "concentration")


@query(f"""{_DEDUP} SELECT city, state, pollutant, category, {sql_stamp("time")} AS time, event_id, aqi FROM f WHERE sent""")
def dedup_alerts(spark, sf_dir):
    return plain(stateful.dedup_alerts(alerts(spark, sf_dir), 6 * 3600))


# Top-k and sets ------------------------------------------------------------------------------------------------------

_LAST_STATION = f"""{fx.with_views("measurements")}, last AS (
  SELECT concat(city, ' - ', state) AS station, pollutant, CAST(aqi AS DOUBLE) AS aqi FROM measurements QUALIFY row_number() OVER (PARTITION BY city, state ORDER BY time DESC, event_id DESC) = 1)"""


@query(f"""{_LAST_STATION} SELECT station, pollutant, aqi, CAST(row_number() OVER (ORDER BY aqi DESC, station, pollutant) AS INT) AS rank FROM last ORDER BY rank LIMIT 10""")
def global_topk(spark, sf_dir):
    return topk.global_topk(fx.measurements(spark, sf_dir))


@query(f"""{_LAST_STATION} SELECT station, pollutant, aqi FROM last ORDER BY aqi DESC, station LIMIT 5""")
def topk_snapshot(spark, sf_dir):
    top = topk.global_topk(fx.measurements(spark, sf_dir))
    snapshot = top.agg(F.map_from_entries(F.collect_list(F.struct("station", F.struct("pollutant", "aqi")))).alias("topReadings"))  # 10 rows
    return topk.topk_rows(snapshot, 5)


@query(f"""{fx.with_views("measurements")} SELECT city, state, pollutant, {sql_stamp("time")} AS time, event_id, aqi FROM measurements QUALIFY row_number() OVER (PARTITION BY city, state, pollutant ORDER BY time DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    m = fx.measurements(spark, sf_dir).select("city", "state", "pollutant", "time", "event_id", "aqi")
    return plain(joins.latest_per_key(m, ["city", "state", "pollutant"], "time", "event_id"))


@query(f"""{fx.with_views("measurements")} SELECT event_id, {sql_stamp("time")} AS time, city, aqi FROM measurements ORDER BY measurements.time DESC, event_id DESC LIMIT 100""")
def latest_rows(spark, sf_dir):
    return plain(topk.latest(fx.measurements(spark, sf_dir), 100).select("event_id", "time", "city", "aqi"))


@query(f"""{fx.with_views("measurements")} SELECT event_id, {sql_stamp("time")} AS time, city, aqi FROM measurements WHERE aqi >= 100 ORDER BY measurements.time DESC, event_id DESC LIMIT 20 OFFSET 40""")
def alert_page(spark, sf_dir):
    return plain(topk.page(alerts(spark, sf_dir), 2, 20, F.desc("time"), F.desc("event_id")).select("event_id", "time", "city", "aqi"))


@query(f"""{fx.with_views("measurements")} SELECT DISTINCT city, state FROM measurements""")
def distinct_locations(spark, sf_dir):
    return sets.distinct_sorted(fx.measurements(spark, sf_dir), "city", "state")


@query(f"""{fx.with_views("measurements")} SELECT part, count(*) AS n, count(category) AS with_category FROM (
  SELECT 'early' AS part, NULL AS category FROM measurements WHERE time < TIMESTAMP '2024-01-15 00:00:00' UNION ALL SELECT 'late', city FROM measurements WHERE time >= TIMESTAMP '2024-01-15 00:00:00') GROUP BY part""")
def union_archives(spark, sf_dir):
    m = fx.measurements(spark, sf_dir)
    split = F.lit("2024-01-15 00:00:00").cast("timestamp")
    both = sets.union_all(m.filter(F.col("time") < split).select(F.lit("early").alias("part"), "aqi"), m.filter(F.col("time") >= split).select(F.lit("late").alias("part"), "aqi", "category"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count("category").alias("with_category"))
