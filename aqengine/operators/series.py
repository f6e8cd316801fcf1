"""Lags, sequences, splits and scaling of sensor series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cyclic

DAILY, HOURLY = (1, 2, 3, 7), (1, 2, 3, 24)


def _w(key: str = "SiteID", time: str = "timestamp"):
    return Window.partitionBy(key).orderBy(time)


def add_lags(df: DataFrame, lags: tuple[int, ...] = HOURLY, col: str = "PM25", key: str = "SiteID", time: str = "timestamp") -> DataFrame:
    """Columns lag_k: the value k rows earlier in the key's series."""
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(_w(key, time)) for k in lags})


def lags_deltas(df: DataFrame, cols: list[str], key: str = "SiteID", time: str = "timestamp") -> DataFrame:
    """The row before's value and the difference to it, for each column."""
    df = df.withColumns({f"{c}_lag1": F.lag(c).over(_w(key, time)) for c in cols})
    return df.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_lag1") for c in cols})


def calendar(df: DataFrame, hourly: bool = True, time: str = "timestamp", weight: float = 1.0) -> DataFrame:
    """Sine and cosine of the weekday, and of the hour."""
    names = dict(zip(("dow_sin", "dow_cos"), cyclic(F.weekday(time), 7, weight), strict=True))
    if hourly:
        names |= dict(zip(("hour_sin", "hour_cos"), cyclic(F.hour(time), 24, weight), strict=True))
    return df.withColumns(names)


def naive_baseline(df: DataFrame, col: str = "Actual_PM25", key: str = "SiteID", time: str = "timestamp") -> DataFrame:
    """Predicts the row before's value."""
    return df.withColumn("Naive_PM25", F.lag(col).over(_w(key, time)))


def split_tag(cutoff: Column, time: str = "timestamp") -> Column:
    return F.when(F.col(time) < cutoff, "Train").otherwise("Test")


def make_sequences(df: DataFrame, n: int = 24, col: str = "PM25", key: str = "SiteID", time: str = "timestamp") -> DataFrame:
    """Each row with the n values before it as an array, and itself as the target; rows with fewer are left out."""
    seq = F.collect_list(col).over(_w(key, time).rowsBetween(-n, -1))
    return df.withColumn("sequence", seq).filter(F.size("sequence") == n).withColumnRenamed(col, "target")


def minmax_fit(df: DataFrame, col: str = "PM25", key: str = "SiteID") -> DataFrame:
    return df.groupBy(key).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def minmax_scale(df: DataFrame, fitted: DataFrame, col: str = "PM25", key: str = "SiteID") -> DataFrame:
    """Values on 0..1 of the fitted range of their key; 0 where the range is a point."""
    x = F.coalesce(F.try_divide(F.col(col) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return df.join(fitted, key).withColumn(f"{col}_scaled", x).drop("lo", "hi")


def minmax_unscale(df: DataFrame, fitted: DataFrame, col: str, key: str = "SiteID") -> DataFrame:
    return df.join(fitted, key).withColumn(col, F.col(col) * (F.col("hi") - F.col("lo")) + F.col("lo")).drop("lo", "hi")


def sequence_dataset(df: DataFrame, n: int = 24, train_share: float = 0.8) -> DataFrame:
    """Scaled sequences of each site, the first part of each series tagged Train; the range is that of the Train part."""
    at = F.percent_rank().over(_w())
    tagged = df.withColumn("split", F.when(at < train_share, "Train").otherwise("Test"))
    scaled = minmax_scale(tagged, minmax_fit(tagged.filter("split = 'Train'")))
    return make_sequences(scaled, n, "PM25_scaled").select("SiteID", "timestamp", "split", "sequence", "target")


def walk_forward(df: DataFrame, cutoff: Column, lags: tuple[int, ...] = (1, 24)) -> DataFrame:
    """One-step predictions over the test rows, each from what is known before it: the value so many rows earlier."""
    rows = add_lags(df, lags).filter(F.col("timestamp") >= cutoff)
    shape = F.explode(F.array(*[F.struct(F.lit(f"lag_{k}").alias("Model_Name"), F.col(f"lag_{k}").alias("Predicted_PM25")) for k in lags]))
    return rows.select("SiteID", "timestamp", F.col("PM25").alias("Actual_PM25"), shape.alias("m"), F.lit("Test").alias("Forecast_Type")).select("SiteID", "timestamp", "m.*", "Actual_PM25", "Forecast_Type")


def gaps(df: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Rows that don't follow the one before at the usual step: SiteID, timestamp, seconds since."""
    since = F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(_w()))
    return df.withColumn("seconds_since", since).filter(F.col("seconds_since") > step_seconds).select("SiteID", "timestamp", "seconds_since")
