"""The latest value of each station and the k highest of them, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import station
from ..operators.topk import ranked
from ..sources.sinks import read_latest, upsert_latest


def update_topk(batch: DataFrame, version: int, path: str, k: int = 10) -> None:
    """For ``foreachBatch``: merges the batch into the latest values under ``path``/latest, and writes the k highest to ``path``/topk.

    The list is taken from all stations' latest values, so a station that falls out comes back as soon as others fall.
    """
    rows = batch.select(station().alias("station"), "pollutant", F.col("aqi").cast("double").alias("aqi"), "time", "event_id")
    upsert_latest(rows, f"{path}/latest", version, ["station"], "time", ("event_id",))
    top = read_latest(batch.sparkSession, f"{path}/latest", version + 1).orderBy(F.desc("aqi"), "station").limit(k)
    ranked(top, [F.desc("aqi"), F.col("station")]).write.mode("overwrite").parquet(f"{path}/topk/v={version}")


def current_topk(spark: SparkSession, path: str) -> DataFrame | None:
    return read_latest(spark, f"{path}/topk")
