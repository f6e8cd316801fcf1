"""Hopping averages and tumbling maxima; the functions work on batch tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITY, STATE = ("city", "state", "pollutant"), ("state", "pollutant")
#: Name, keys, length and hop of each average.
AVERAGES = {
    "avg_city_hour": (CITY, "1 hour", "15 minutes"),
    "avg_state_hour": (STATE, "1 hour", "15 minutes"),
    "avg_city_8_hour": (CITY, "8 hours", "2 hours"),
    "avg_state_8_hour": (STATE, "8 hours", "2 hours"),
    "avg_city_day": (CITY, "24 hours", "8 hours"),
    "avg_state_day": (STATE, "24 hours", "8 hours"),
}
_SECONDS = {"minutes": 60, "minute": 60, "hours": 3600, "hour": 3600}


def seconds(length: str) -> int:
    n, unit = length.split()
    return int(n) * _SECONDS[unit]


def _ends(w: Column, *cols: Column | str) -> list[Column | str]:
    return [w["start"].alias("time_start"), w["end"].alias("time_end"), *cols]


def hopping_average(m: DataFrame, keys: tuple[str, ...], size: str, hop: str, time: str = "time", compat: bool = False) -> DataFrame:
    """Mean index of each key in windows of ``size`` every ``hop``, aligned to the epoch.

    On a table, sums and counts are first taken by hop-wide buckets, and only these few rows are dealt to the size / hop windows
    that hold them; on a stream the rows are, since Spark allows one aggregation with a watermark. ``compat`` labels PM2.5 as PM25.
    """
    if m.isStreaming:
        w = m.groupBy(F.window(time, size, hop).alias("w"), *keys).agg(F.avg("aqi").alias("aqi"))
    else:
        bucket = F.window(time, hop)
        b = m.groupBy(bucket.alias("b"), *keys).agg(F.sum("aqi").alias("s"), F.count("aqi").alias("n"))
        step, hops = seconds(hop), seconds(size) // seconds(hop)
        back = F.explode(F.sequence(F.lit(0), F.lit(hops - 1)))
        start = F.unix_seconds(F.col("b.start")) - F.col("i") * step
        b = b.withColumn("i", back).withColumn("w", F.struct(F.timestamp_seconds(start).alias("start"), F.timestamp_seconds(start + seconds(size)).alias("end")))
        w = b.groupBy("w", *keys).agg((F.sum("s") / F.sum("n")).alias("aqi"))
    out = w.select(*_ends(F.col("w"), *keys, "aqi"))
    return out.replace("PM2.5", "PM25", "pollutant") if compat else out


def average(m: DataFrame, name: str, pollutant: str | None = None, **how) -> DataFrame:
    """One of the six averages by its name, of all pollutants or one."""
    keys, size, hop = AVERAGES[name]
    return hopping_average(m if pollutant is None else m.filter(F.col("pollutant") == pollutant), keys, size, hop, **how)


def all_averages(m: DataFrame) -> dict[str, DataFrame]:
    """All six from one pass: 15-minute sums by city, from which every other key and window follows."""
    base = m.groupBy(F.window("time", "15 minutes").alias("b"), *CITY).agg(F.sum("aqi").alias("s"), F.count("aqi").alias("n"))
    out = {}
    for name, (keys, size, hop) in AVERAGES.items():
        step, hops = seconds(hop), seconds(size) // seconds(hop)
        at = F.floor(F.unix_seconds(F.col("b.start")) / step) * step
        rows = base.withColumn("at", at).groupBy("at", *keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        start = F.col("at") - F.col("i") * step
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hops - 1)))).groupBy(start.alias("start"), *keys).agg((F.sum("s") / F.sum("n")).alias("aqi"))
        out[name] = rows.select(F.timestamp_seconds("start").alias("time_start"), F.timestamp_seconds(F.col("start") + seconds(size)).alias("time_end"), *keys, "aqi")
    return out


def tumbling_maximum(m: DataFrame, keys: tuple[str, ...], size: str = "1 hour", time: str = "time") -> DataFrame:
    """Largest index of each key in each window, 0 at least."""
    w = m.groupBy(F.window(time, size).alias("w"), *keys).agg(F.greatest(F.lit(0), F.max("aqi")).alias("aqi"))
    return w.select(*_ends(F.col("w"), *keys, "aqi"))


def max_city_hour(m: DataFrame, **how) -> DataFrame:
    return tumbling_maximum(m, CITY, **how)


def max_state_hour(m: DataFrame, **how) -> DataFrame:
    return tumbling_maximum(m, STATE, **how)
