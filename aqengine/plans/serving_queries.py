"""Queries of the serving layer and the client, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.geo import geo_distance_m
from ..operators import joins, stateful, topk, windows
from . import client, serving
from .air_queries import _BAND_SQL, _DEDUP, _SEVERITY_SQL, _average_sql, _concentration_sql, alerts, plain, sql_stamp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-29 12:00:00"
#: A point between cities, and users.
LON, LAT, RADIUS = -118.85, 32.65, 50_000.0


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def now():
    return F.lit(AS_OF).cast("timestamp")


_M = fx.with_views("measurements", "city_location")
_SUBS = fx.with_views("measurements", "city_location", "subscribers")
_LATEST = "latest AS (SELECT * FROM measurements QUALIFY row_number() OVER (PARTITION BY city, state, pollutant ORDER BY time DESC, event_id DESC) = 1)"


def _lambert(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same closed form in SQL."""
    f = "(1 / 298.257223563::DOUBLE)"
    b1, b2 = (f"atan((1 - {f}) * tan(radians({x})))" for x in (lat1, lat2))
    half = f"(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    s = f"(2 * asin(least(1.0::DOUBLE, sqrt({half}))))"
    p, q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    return f"""CASE WHEN {half} <= 0 THEN 0.0::DOUBLE ELSE 6378137.0::DOUBLE * ({s} - {f} / 2 * (({s} - sin({s})) * pow(sin({p}) * cos({q}), 2) / pow(cos({s} / 2), 2) + ({s} + sin({s})) * pow(cos({p}) * sin({q}), 2) / pow(sin({s} / 2), 2))) END"""


def _planar(lon: str, lat: str) -> str:
    return f"sqrt(pow(longitude - ({lon}), 2) + pow(latitude - ({lat}), 2))"


def _measurements(spark, sf_dir) -> DataFrame:
    return fx.measurements(spark, sf_dir).select("event_id", "time", "city", "state", "pollutant", "aqi")


@query(f"""{_M} SELECT a.city AS city_a, b.city AS city_b, round({_lambert("a.longitude", "a.latitude", "b.longitude", "b.latitude")}, 3) AS metres FROM city_location a JOIN city_location b ON a.state = b.state""")
def geo_distance(spark, sf_dir):
    loc = fx.city_location(spark, sf_dir)
    a, b = loc.select("state", F.col("city").alias("city_a"), F.col("longitude").alias("x"), F.col("latitude").alias("y")), loc.withColumnRenamed("city", "city_b")
    return a.join(b, "state").select("city_a", "city_b", F.round(geo_distance_m(F.col("x"), F.col("y"), F.col("longitude"), F.col("latitude")), 3).alias("metres"))


@query(f"""{_M}, {_LATEST} SELECT city, state, pollutant, {sql_stamp("time")} AS time, aqi, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM latest JOIN city_location USING (city, state)""")
def latest_geo(spark, sf_dir):
    return plain(serving.latest_with_location(_measurements(spark, sf_dir), fx.city_location(spark, sf_dir)).drop("event_id"))


@query(f"""{_M} SELECT event_id, city, state, pollutant, aqi, round({_lambert(str(LON), str(LAT), "longitude", "latitude")}, 3) AS distance_m FROM measurements JOIN city_location USING (city, state)
WHERE aqi >= 100 AND time >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND {_lambert(str(LON), str(LAT), "longitude", "latitude")} <= {RADIUS}""")
def alerts_near(spark, sf_dir):
    near = serving.local_alerts(alerts(spark, sf_dir), fx.city_location(spark, sf_dir), (LON, LAT), now(), 48, RADIUS)
    return near.select("event_id", "city", "state", "pollutant", "aqi", F.round("distance_m", 3).alias("distance_m"))


@query(f"""{_DEDUP}, city_location AS ({fx.SQL["city_location"]}), subscribers AS ({fx.SQL["subscribers"]}), pairs AS (
  SELECT id, email, c.city, c.state, {_lambert("s.longitude", "s.latitude", "c.longitude", "c.latitude")} AS d FROM subscribers s JOIN city_location c ON s.active AND abs(s.latitude - c.latitude) < 1
)
SELECT event_id, id, email, city, state, round(d, 3) AS distance_m FROM f JOIN pairs USING (city, state) WHERE sent AND d <= 20000""")
def alert_recipients(spark, sf_dir):
    sent = stateful.dedup_alerts(alerts(spark, sf_dir), 6 * 3600)
    got = joins.alert_recipients(sent.select("event_id", "city", "state"), fx.city_location(spark, sf_dir), fx.subscribers(spark, sf_dir), 20_000, digits=3)
    return got.select("event_id", "id", "email", "city", "state", "distance_m")


@query(f"""{_DEDUP}, city_location AS ({fx.SQL["city_location"]}), subscribers AS ({fx.SQL["subscribers"]}), pairs AS (
  SELECT id, email, c.city, c.state, {_lambert("s.longitude", "s.latitude", "c.longitude", "c.latitude")} AS d FROM subscribers s JOIN city_location c ON s.active AND abs(s.latitude - c.latitude) < 1
)
SELECT id, email, {sql_stamp("time")} AS time, concat('Air quality alert for ', city, ', ', state, ': ', pollutant, ' index ', aqi, ' at ', {sql_stamp("time")}, ' UTC') AS message FROM f JOIN pairs USING (city, state) WHERE sent AND d <= 10000""")
def alert_outbox(spark, sf_dir):
    sent = stateful.dedup_alerts(alerts(spark, sf_dir), 6 * 3600)
    texts = plain(joins.with_message(sent).select("city", "state", "time", "message"))
    return joins.outbox(joins.alert_recipients(texts, fx.city_location(spark, sf_dir), fx.subscribers(spark, sf_dir), 10_000))


@query(f"""{_M}, {_LATEST} SELECT city, state, pollutant, aqi, round({_planar(str(LON), str(LAT))}, 6) AS distance FROM latest JOIN city_location USING (city, state) ORDER BY {_planar(str(LON), str(LAT))}, city, state, pollutant LIMIT 5""")
def nearest_measurements(spark, sf_dir):
    last = joins.latest_per_key(_measurements(spark, sf_dir), ["city", "state", "pollutant"], "time", "event_id")
    return plain(joins.nearest(last, fx.city_location(spark, sf_dir), LON, LAT).select("city", "state", "pollutant", "aqi", "distance"))


_AVG = f"""{_M}, hops AS (SELECT city, state, pollutant, aqi, (epoch_us(time) // 900000000 - k) * 900 AS s FROM measurements, range(4) r(k)),
avg_city_hour AS (SELECT s, city, state, pollutant, avg(aqi) AS aqi FROM hops GROUP BY ALL)"""


@query(f"""{_AVG}, newest AS (SELECT * FROM avg_city_hour WHERE s = (SELECT max(s) FROM avg_city_hour))
SELECT city, state, pollutant, round(aqi, 6) AS aqi, round({_planar(str(LON), str(LAT))}, 6) AS distance FROM newest JOIN city_location USING (city, state) ORDER BY {_planar(str(LON), str(LAT))}, city, state, pollutant LIMIT 5""")
def nearest_averages(spark, sf_dir):
    avg = windows.average(fx.measurements(spark, sf_dir), "avg_city_hour")
    newest = avg.join(F.broadcast(avg.agg(F.max("time_start").alias("time_start"))), "time_start")  # one row
    return plain(joins.nearest(newest, fx.city_location(spark, sf_dir), LON, LAT).select("city", "state", "pollutant", "aqi", "distance"))


@query(f"""{_SUBS}, {_LATEST}, u AS (SELECT id, CASE WHEN id % 10 <> 0 THEN longitude END AS ulon, CASE WHEN id % 10 <> 0 THEN latitude END AS ulat FROM subscribers),
near AS (
  SELECT id, city, state, pollutant, aqi, {_planar("ulon", "ulat")} AS distance FROM u, latest JOIN city_location USING (city, state) WHERE ulon IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, city, state, pollutant) <= 5
), late AS (SELECT * FROM latest ORDER BY time DESC, city, state, pollutant LIMIT 5)
SELECT id, city, state, pollutant, aqi, round(distance, 6) AS distance FROM near UNION ALL SELECT id, city, state, pollutant, aqi, NULL FROM u, late WHERE ulon IS NULL""")
def near_me(spark, sf_dir):
    users = fx.subscribers(spark, sf_dir)
    users = users.withColumns({c: F.when(F.col("id") % 10 != 0, F.col(c)) for c in ("longitude", "latitude")})
    return plain(serving.near_me(_measurements(spark, sf_dir), fx.city_location(spark, sf_dir), users).select("id", "city", "state", "pollutant", "aqi", "distance"))


@query(f"""{_AVG}, two AS (SELECT *, row_number() OVER (PARTITION BY city, state, pollutant ORDER BY s DESC) AS r FROM avg_city_hour)
SELECT city, state, pollutant, round(max(aqi) FILTER (r = 1), 6) AS current, round(max(aqi) FILTER (r = 2), 6) AS previous FROM two WHERE r <= 2 GROUP BY ALL""")
def last_two_averages(spark, sf_dir):
    return plain(joins.last_two(windows.average(fx.measurements(spark, sf_dir), "avg_city_hour")))


@query(f"""{_AVG}, two AS (SELECT *, row_number() OVER (PARTITION BY city, state, pollutant ORDER BY s DESC) AS r FROM avg_city_hour),
p AS (SELECT city, state, pollutant, max(aqi) FILTER (r = 1) AS c, max(aqi) FILTER (r = 2) AS q FROM two WHERE r <= 2 GROUP BY ALL),
n AS (SELECT * FROM measurements ORDER BY time DESC, event_id DESC LIMIT 3)
SELECT CAST(row_number() OVER (ORDER BY n.time DESC, event_id DESC) AS INT) AS id, city, state, pollutant, CASE WHEN c > coalesce(q, c) THEN 'INCREASING' WHEN c < coalesce(q, c) THEN 'DECREASING' ELSE 'STABLE' END AS direction,
  round(CASE WHEN coalesce(q, c) = 0 THEN 0 ELSE (c - coalesce(q, c)) / coalesce(q, c) * 100 END, 6) AS change_percentage, round(c, 6) AS current_value, round(coalesce(q, c), 6) AS previous_value, {sql_stamp("n.time")} AS time FROM n JOIN p USING (city, state, pollutant)""")
def trends(spark, sf_dir):
    return plain(serving.trends(_measurements(spark, sf_dir)))


@query(f"""{_M} SELECT count(*) AS total_measurements, count(DISTINCT city) AS total_cities, CAST(floor(avg(aqi) FILTER (time > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) + 0.5) AS BIGINT) AS average_aqi,
  count(*) FILTER (aqi >= 100 AND time > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS alerts FROM measurements""")
def dashboard_summary(spark, sf_dir):
    return serving.dashboard_summary(fx.measurements(spark, sf_dir), alerts(spark, sf_dir), now())


def _lookback(name: str, keys: tuple[str, ...], size: int, hop: int, back: str, make, where: str = "true") -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(make(fx.measurements(spark, sf_dir)))
    ORACLES[name] = f"SELECT * FROM ({_average_sql(keys, size, hop)}) WHERE time_start > {sql_stamp(f"TIMESTAMP '{AS_OF}' - INTERVAL {back}")} AND {where}"


_lookback("city_hours_since", windows.CITY, 3600, 900, "24 HOUR", lambda m: serving.city_hours(m, now()))
_lookback("state_hours_since", windows.STATE, 3600, 900, "24 HOUR", lambda m: serving.state_hours(m, now()))
_lookback("city_8_hours_since", windows.CITY, 28800, 7200, "7 DAY", lambda m: serving.city_8_hours(m, now()))
_lookback("city_days_since", windows.CITY, 86400, 28800, "30 DAY", lambda m: serving.city_days(m, now()))
_lookback("one_city_since", windows.CITY, 3600, 900, "240 HOUR", lambda m: serving.of_city(serving.city_hours(m, now(), 240), "cITY ba"), "lower(city) = 'city ba'")
_lookback("one_state_since", windows.STATE, 3600, 900, "240 HOUR", lambda m: serving.of_state(serving.state_hours(m, now(), 240), "ca"), "state = 'CA'")


@query(f"""{_M} SELECT {sql_stamp("h")} AS time_start, {sql_stamp("h + INTERVAL 1 HOUR")} AS time_end, city, state, pollutant, aqi FROM (
  SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS h, city, state, pollutant, greatest(0, max(aqi)) AS aqi FROM measurements GROUP BY ALL) WHERE h > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR""")
def city_maxima_since(spark, sf_dir):
    return plain(serving.city_maxima(fx.measurements(spark, sf_dir), now()))


@query(f"""{_M} SELECT event_id, {sql_stamp("time")} AS time, city, state, pollutant, aqi FROM measurements WHERE aqi >= 100 AND time > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND state = 'NY'""")
def alerts_since(spark, sf_dir):
    return plain(serving.alerts_since(alerts(spark, sf_dir), now(), 168, state="ny").select("event_id", "time", "city", "state", "pollutant", "aqi"))


@query(f"""{_M} SELECT event_id, {sql_stamp("time")} AS time, city, state, pollutant, aqi FROM measurements WHERE time > TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND city = 'City CA' AND state = 'TX'""")
def measurements_since(spark, sf_dir):
    return plain(serving.measurements_since(_measurements(spark, sf_dir), now(), 72, "city ca", "tx"))


@query(f"""{_M} SELECT city, state, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM city_location""")
def city_locations(spark, sf_dir):
    return plain(fx.city_location(spark, sf_dir))


@query(f"""{_M} SELECT DISTINCT city FROM measurements""")
def distinct_cities(spark, sf_dir):
    return serving.cities(fx.measurements(spark, sf_dir))


@query(f"""{_M} SELECT DISTINCT state FROM measurements""")
def distinct_states(spark, sf_dir):
    return serving.states(fx.measurements(spark, sf_dir))


@query(f"""{_M} SELECT CAST(floor(avg(aqi) + 0.5) AS BIGINT) AS average_aqi, count(*) AS sensors, count(*) FILTER (aqi > 100) AS alerts, max(aqi) AS max_aqi FROM measurements WHERE city = 'City BA'""")
def local_stats(spark, sf_dir):
    return client.local_stats(client.filtered(fx.measurements(spark, sf_dir), "City BA"))


@query(f"""{_M} SELECT state, round(avg(aqi), 6) AS avg_aqi, count(*) AS count FROM measurements GROUP BY state""")
def state_choropleth(spark, sf_dir):
    return plain(client.state_choropleth(fx.measurements(spark, sf_dir)))


@query(f"""{_M}, {_LATEST} SELECT city, state, pollutant, round(greatest(aqi / (SELECT max(aqi) FROM latest)::DOUBLE, 0.05), 6) AS intensity FROM latest""")
def heat_points(spark, sf_dir):
    last = serving.latest_with_location(_measurements(spark, sf_dir), fx.city_location(spark, sf_dir))
    return plain(client.heat_points(last).select("city", "state", "pollutant", "intensity"))


@query(f"""{_M} SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM city_location""")
def map_centre(spark, sf_dir):
    return plain(client.map_centre(fx.city_location(spark, sf_dir)))


@query(f"""{_M} SELECT {_BAND_SQL} AS band, {_SEVERITY_SQL} AS severity, count(*) AS count, floor(avg(aqi) * 100 + 0.5) / 100 AS avg_aqi FROM measurements GROUP BY ALL""")
def band_summary(spark, sf_dir):
    return client.bands(fx.measurements(spark, sf_dir))


@query(f"""{_M} SELECT event_id, city, state, pollutant, aqi, {_SEVERITY_SQL} AS alert_level, printf('High concentration of %s (%.1f ug/m3).', pollutant, CAST({_concentration_sql()} AS DOUBLE)) AS message, {sql_stamp("time")} AS time FROM measurements WHERE aqi >= 100""")
def alert_rows(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumn("concentration", F.round("concentration", 6))
    return plain(client.alert_rows(a))


@query(f"""{_M}, last AS (SELECT concat(city, ' - ', state) AS station, pollutant, CAST(aqi AS DOUBLE) AS aqi FROM measurements QUALIFY row_number() OVER (PARTITION BY city, state ORDER BY time DESC, event_id DESC) = 1)
SELECT station, aqi, round(least(aqi / 300 * 100, 100), 6) AS percentage FROM last ORDER BY aqi DESC, station, pollutant LIMIT 10""")
def topk_bars(spark, sf_dir):
    return plain(client.topk_bars(topk.global_topk(fx.measurements(spark, sf_dir))).select("station", "aqi", "percentage"))


@query(f"""{_M} SELECT city, state FROM city_location WHERE contains(lower(concat_ws(' ', city, state)), 'a n') ORDER BY city, state LIMIT 10""")
def search_cities(spark, sf_dir):
    return client.search_cities(fx.city_location(spark, sf_dir), "A n").select("city", "state")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Unknown location' ELSE event_type END AS location, coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE 'PM10' END, ''), 'O3') AS pollutant, round(CASE WHEN event_id % 4 = 0 THEN user_id ELSE value END, 6) AS value, 'AQI' AS unit FROM events""")
def defaulted_rows(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = e.select("event_id", F.col("ts").cast("timestamp").alias("time"), F.when(i % 3 != 0, F.col("event_type")).alias("city"), F.when(i % 5 == 0, "").otherwise("PM10").alias("pollutant"), F.when(i % 4 != 0, F.col("value")).alias("value"), F.col("user_id").cast("double").alias("aqi"))
    return plain(client.defaulted(raw).select("event_id", "location", "pollutant", "value", "unit"))


@query("""SELECT n_name AS state_name, CAST(NULL AS VARCHAR) AS state_code FROM nation UNION ALL SELECT 'New York', 'NY' UNION ALL SELECT 'Ohio', 'OH'""")
def state_codes(spark, sf_dir):
    nations = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("state_name"))
    known = fx.table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "New York").otherwise("Ohio").alias("state_name"))
    return client.state_codes(nations.unionByName(known))
