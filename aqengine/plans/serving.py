"""What the serving layer asks, as functions of tables; ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, topk, windows
from ..operators.sets import distinct_sorted


def since(df: DataFrame, as_of: Column, hours: int = 0, days: int = 0, time: str = "time_start") -> DataFrame:
    """Rows later than so long before ``as_of``, newest first."""
    return df.filter(F.col(time) > as_of - F.make_dt_interval(F.lit(days), F.lit(hours))).orderBy(F.desc(time))


def latest_with_location(m: DataFrame, loc: DataFrame, limit: int | None = None) -> DataFrame:
    return joins.latest_geo(m, loc, limit)


def city_hours(m: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return since(windows.average(m, "avg_city_hour"), as_of, hours)


def state_hours(m: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return since(windows.average(m, "avg_state_hour"), as_of, hours)


def city_8_hours(m: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return since(windows.average(m, "avg_city_8_hour"), as_of, days=days)


def city_days(m: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return since(windows.average(m, "avg_city_day"), as_of, days=days)


def city_maxima(m: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return since(windows.max_city_hour(m), as_of, hours)


def of_city(df: DataFrame, city: str) -> DataFrame:
    return df.filter(F.lower("city") == city.lower())


def of_state(df: DataFrame, state: str) -> DataFrame:
    return df.filter(F.lower("state") == state.lower())


def cities(m: DataFrame) -> DataFrame:
    return distinct_sorted(m, "city")


def states(m: DataFrame) -> DataFrame:
    return distinct_sorted(m, "state")


def local_alerts(alerts: DataFrame, loc: DataFrame, user: tuple[float, float] | None, as_of: Column, hours: int = 24, radius_m: float = 50_000) -> DataFrame:
    """Alerts near a user (longitude, latitude), newest first; none for a user without a place."""
    lon, lat = user or (0.0, 0.0)
    near = joins.alerts_near(alerts, loc, lon, lat, radius_m, as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return (near if user else near.limit(0)).orderBy(F.desc("time"))


def alerts_since(alerts: DataFrame, as_of: Column, hours: int = 168, city: str | None = None, state: str | None = None) -> DataFrame:
    """Alerts of the last hours, of a city or state if given, newest first."""
    rows = alerts if city is None else of_city(alerts, city)
    return since(rows if state is None else of_state(rows, state), as_of, hours, time="time")


def dashboard_summary(m: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows, distinct city names, mean index and number of alerts of the last hours: one row."""
    late = F.col("time") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    mean = F.avg(F.when(late, F.col("aqi")))
    left = m.agg(F.count("*").alias("total_measurements"), F.countDistinct("city").alias("total_cities"), F.coalesce(F.floor(mean + 0.5), F.lit(0)).alias("average_aqi"))
    return left.join(F.broadcast(alerts.agg(F.count_if(late).alias("alerts"))))  # one row each


def trends(m: DataFrame, n: int = 3) -> DataFrame:
    """For the n newest measurements: last hourly average of the city and pollutant against the one before."""
    new = m.orderBy(F.desc("time"), F.desc("event_id")).limit(n).select("event_id", "time", "city", "state", "pollutant", "aqi")
    own = m.join(F.broadcast(new.select("city", "state", "pollutant").distinct()), ["city", "state", "pollutant"], "left_semi")  # n rows
    two = joins.last_two(windows.average(own, "avg_city_hour"))
    t = new.join(two, ["city", "state", "pollutant"], "left").withColumn("current", F.coalesce("current", F.col("aqi").cast("double")))
    t = t.withColumn("previous", F.coalesce("previous", "current")).withColumn("change", F.col("current") - F.col("previous"))
    percent = F.when(F.col("previous") == 0, 0.0).otherwise(F.try_divide(F.col("change"), F.col("previous")) * 100)
    direction = F.when(F.col("change") > 0, "INCREASING").when(F.col("change") < 0, "DECREASING").otherwise("STABLE")
    number = F.row_number().over(Window.orderBy(F.desc("time"), F.desc("event_id")))  # n rows
    return t.select(number.alias("id"), "city", "state", "pollutant", direction.alias("direction"), percent.alias("change_percentage"), F.col("current").alias("current_value"), F.col("previous").alias("previous_value"), "time")


def near_me(m: DataFrame, loc: DataFrame, users: DataFrame, k: int = 5) -> DataFrame:
    """For each user the k nearest of the latest measurements, or without a place the k latest."""
    return joins.nearest_for_users(joins.latest_per_key(m, ["city", "state", "pollutant"], "time", "event_id"), loc, users, k)


def global_topk(m: DataFrame, limit: int = 10) -> DataFrame:
    return topk.global_topk(m, limit)


def measurements_since(m: DataFrame, as_of: Column, hours: int, city: str | None = None, state: str | None = None) -> DataFrame:
    rows = m if city is None else of_city(m, city)
    return since(rows if state is None else of_state(rows, state), as_of, hours, time="time")
