"""Top-k lists, pages and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import station
from .joins import latest_per_key


def latest_stations(m: DataFrame, by_pollutant: bool = False) -> DataFrame:
    """The last reading of each station, or of each station and pollutant."""
    s = m.select(station().alias("station"), "pollutant", F.col("aqi").cast("double").alias("aqi"), "time", "event_id")
    return latest_per_key(s, ["station", "pollutant"] if by_pollutant else ["station"], "time", "event_id")


def global_topk(m: DataFrame, k: int = 10, by_pollutant: bool = False) -> DataFrame:
    """The k stations with the highest last reading: rank, station, pollutant, aqi. Each task keeps k, so no shuffle grows with k's rest."""
    top = latest_stations(m, by_pollutant).orderBy(F.desc("aqi"), "station", "pollutant").limit(k)
    return ranked(top.select("station", "pollutant", "aqi"), [F.desc("aqi"), F.col("station"), F.col("pollutant")])


def ranked(few: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of an already limited list with their rank."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def retain(kept: dict[str, float], name: str, aqi: float, k: int) -> None:
    """Keeps a list of which only k entries are remembered: a reading replaces its station's; past k the smallest goes for good."""
    kept.pop(name, None)
    kept[name] = aqi
    if len(kept) > k:
        del kept[min(kept, key=lambda s: (kept[s], s))]


def topk_rows(snapshots: DataFrame, limit: int = 0, entries: str = "topReadings") -> DataFrame:
    """A map column of readings as rows, highest first; a limit of 0 or less means all."""
    rows = snapshots.select(F.explode(entries).alias("station", "r")).select("station", "r.pollutant", "r.aqi").orderBy(F.desc("aqi"), "station")
    return rows if limit <= 0 else rows.limit(limit)


def top_sensors(a: DataFrame, k: int = 20) -> DataFrame:
    return a.groupBy("SiteID").count().orderBy(F.desc("count"), "SiteID").limit(k)


def busiest_site(a: DataFrame) -> DataFrame:
    return top_sensors(a, 1)


def top_anomalies(df: DataFrame, score: str = "score", k: int = 10, ties: tuple[str, ...] = ("SiteID", "timestamp")) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


def latest(m: DataFrame, n: int) -> DataFrame:
    return m.orderBy(F.desc("time"), F.desc("event_id")).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 0) of the rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)
