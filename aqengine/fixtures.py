"""Air-quality tables derived by Spark from the given ones, so that every operator has data that grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.aqi import aqi_band, aqi_to_concentration

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATES = ("CA", "NY", "TX", "FL", "WA", "OR", "AZ", "NV", "CO", "UT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _station(n: Column) -> tuple[Column, Column]:
    letter = lambda i: F.substring(F.lit(LETTERS), (i + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("City "), letter(n % 26), letter(F.floor(n / 26))), F.element_at(F.array(*map(F.lit, STATES)), (n % 10 + 1).cast("int"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, time, city, state, pollutant, aqi, concentration, category of each event."""
    city, state = _station(F.col("user_id") % 60)
    pollutant = F.when(F.col("event_type").isin("click", "signup"), "O3").when(F.col("event_type").isin("view", "error"), "PM2.5").otherwise("PM10")
    aqi = F.least(F.lit(500), F.greatest(F.lit(1), F.ceil("value"))).cast("int")
    m = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("time"), city.alias("city"), state.alias("state"), pollutant.alias("pollutant"), aqi.alias("aqi"))
    return m.select("*", aqi_to_concentration("aqi", "pollutant").alias("concentration"), aqi_band("aqi").alias("category"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, content: the text of a feed item for each measurement."""
    name = F.when(F.col("pollutant") == "O3", "Ozone").when(F.col("pollutant") == "PM2.5", "Particle Pollution (2.5 microns)").otherwise("Particle Pollution (10 microns)")
    text = F.concat(
        F.lit("<b>Location:</b> "), "city", F.lit(", "), "state", F.lit("<br/>\n<b>Current Air Quality:</b> Last Update: "),
        F.date_format("time", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" UTC<br/>\n"), F.element_at(F.split("category", " "), -1), F.lit(" - "), F.col("aqi").cast("string"), F.lit(" AQI - "), name, F.lit("<br/>\n"),
    )
    return measurements(spark, sf_dir).select("event_id", text.alias("content"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hourly rows with planted faults: bad numbers, missing times, foreign states, repeated rows."""
    e = F.col("event_id")
    m = measurements(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    value = F.when(e % 97 == 0, "n/a").when(e % 89 == 0, "-1").when(e % 83 == 0, "9999").otherwise(F.col("value").cast("string"))
    rows = m.select(
        "event_id", F.when(e % 79 != 0, F.col("time")).alias("timestamp"), F.date_format("time", "yyyy-MM-dd").alias("Date"), F.date_format("time", "HH:mm").alias("Time"),
        F.col("user_id").cast("string").alias("SiteID"), F.concat(F.lit("Site "), F.col("user_id")).alias("SiteName"), F.when(e % 71 == 0, "ZZ").otherwise(F.col("state")).alias("StateCode"),
        F.col("city").alias("CountyName"), F.col("city").alias("ReportingAreaName"), (32 + F.floor((F.col("user_id") % 60) / 10) * 0.3).alias("Latitude"), (-120 + (F.col("user_id") % 60 % 10) * 0.4).alias("Longitude"),
        F.when(F.col("pollutant") == "O3", "OZONE").otherwise(F.col("pollutant")).alias("Parameter"), value.alias("Value"),
        F.when(F.col("pollutant") == "O3", "PPB").otherwise("UG/M3").alias("Unit"), F.lit("Agency").alias("AgencyName"),
    )
    twice = F.when(F.col("event_id") % 50 == 0, 2).otherwise(1)
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), twice))).drop("_i")


def city_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id") % 60
    city, state = _station(n)
    return table(spark, sf_dir, "events").select(n.alias("n")).distinct().withColumnRenamed("n", "user_id").select(city.alias("city"), state.alias("state"), (F.lit(-120) + (n % 10) * F.lit(0.4)).alias("longitude"), (F.lit(32) + F.floor(n / 10) * F.lit(0.3)).alias("latitude"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat("c_name", F.lit("@example.org")).alias("email"), (F.lit(-120) + (k * 7 % 400) / F.lit(100.0)).alias("longitude"), (F.lit(32) + (k * 13 % 180) / F.lit(100.0)).alias("latitude"), (k % 5 != 0).alias("active")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly PM2.5 series: SiteID (a state's sensors by 150 users), timestamp, PM25 (mean of the hour)."""
    m = measurements(spark, sf_dir).filter("pollutant = 'PM2.5'")
    return m.groupBy(F.concat_ws("-", "state", F.floor(F.col("user_id") / 150).cast("string")).alias("SiteID"), F.date_trunc("hour", "time").alias("timestamp")).agg(F.avg("aqi").alias("PM25"))


def _sql_station(n: str) -> str:
    return f"concat('City ', substr('{LETTERS}', CAST(({n}) % 26 + 1 AS INT), 1), substr('{LETTERS}', CAST(floor(({n}) / 26) + 1 AS INT), 1)) AS city, {list(STATES)}[CAST(({n}) % 10 + 1 AS INT)] AS state"


#: The same views in DuckDB's SQL; each may use those before it.
SQL = {
    "measurements": f"""SELECT event_id, user_id, value, ts AS time, {_sql_station("user_id % 60")},
  CASE WHEN event_type IN ('click', 'signup') THEN 'O3' WHEN event_type IN ('view', 'error') THEN 'PM2.5' ELSE 'PM10' END AS pollutant,
  CAST(least(500, greatest(1, ceil(value))) AS INT) AS aqi FROM events""",
    "archive": """SELECT event_id, CASE WHEN event_id % 79 <> 0 THEN time END AS "timestamp", CAST(user_id AS VARCHAR) AS SiteID,
  CASE WHEN event_id % 71 = 0 THEN 'ZZ' ELSE state END AS StateCode, CASE WHEN pollutant = 'O3' THEN 'OZONE' ELSE pollutant END AS Parameter,
  CASE WHEN pollutant = 'O3' THEN 'PPB' ELSE 'UG/M3' END AS Unit,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -1 WHEN event_id % 83 = 0 THEN 9999 ELSE value END AS Value
FROM measurements, range(2) r(i) WHERE i = 0 OR event_id % 50 = 0""",
    "city_location": f"""SELECT {_sql_station("n")}, -120 + (n % 10) * 0.4::DOUBLE AS longitude, 32 + floor(n / 10) * 0.3::DOUBLE AS latitude FROM (SELECT DISTINCT user_id % 60 AS n FROM events)""",
    "subscribers": """SELECT c_custkey AS id, concat(c_name, '@example.org') AS email, -120 + (c_custkey * 7 % 400) / 100.0::DOUBLE AS longitude, 32 + (c_custkey * 13 % 180) / 100.0::DOUBLE AS latitude, c_custkey % 5 <> 0 AS active FROM customer""",
    "series": """SELECT concat_ws('-', state, CAST(user_id // 150 AS VARCHAR)) AS SiteID, CAST(date_trunc('hour', time) AS TIMESTAMP) AS "timestamp", avg(aqi) AS PM25 FROM measurements WHERE pollutant = 'PM2.5' GROUP BY ALL""",
}


def with_views(*names: str) -> str:
    """The head of a DuckDB query that uses these views."""
    needs = {"archive": ["measurements"], "series": ["measurements"]}
    every = dict.fromkeys(x for n in names for x in [*needs.get(n, []), n])
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in every)
