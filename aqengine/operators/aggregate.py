"""Profiles, pivots, error measures and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm_parameter
from ..interim import dropped, written

#: Values that are sorted at the driver at most.
FEW = 50_000


def pivot_pollutants(a: DataFrame, parameters: tuple[str, ...] = ("OZONE", "PM10", "PM2_5"), keys: tuple[str, ...] = ("SiteID", "timestamp"), value: str = "Value", tie: str = "Value") -> DataFrame:
    """A column for each parameter; of several values at once that with the largest ``tie``. Given parameters spare a pass to find them."""
    p = a.withColumn("Parameter", norm_parameter(F.col("Parameter")))
    return p.groupBy(*keys).pivot("Parameter", list(parameters)).agg(F.max_by(value, tie))


def pivot_sensors(a: DataFrame, sites: list[str], value: str = "PM25") -> DataFrame:
    """A column of means for each sensor, by time."""
    return a.filter(F.col("SiteID").isin(*sites)).groupBy("timestamp").pivot("SiteID", sites).agg(F.avg(value))


def sensors_by_time(a: DataFrame, value: str = "PM25") -> DataFrame:
    """timestamp and a map of each sensor's mean: for more sensors than a table can have columns."""
    means = a.groupBy("timestamp", "SiteID").agg(F.avg(value).alias("v"))
    return means.groupBy("timestamp").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("SiteID", "v")))).alias("means"))


def pivot_models(f: DataFrame, models: list[str]) -> DataFrame:
    """A column of predictions for each model."""
    return f.groupBy("SiteID", "timestamp", "Actual_PM25").pivot("Model_Name", models).agg(F.avg("Predicted_PM25"))


def daily_mean(s: DataFrame) -> DataFrame:
    return s.groupBy("SiteID", F.to_date("timestamp").alias("Date")).agg(F.avg("PM25").alias("PM25"))


def site_profile(a: DataFrame, keys: tuple[str, ...] = ("SiteID",)) -> DataFrame:
    """Mean, largest and deviation of PM2.5, mean and largest ozone of each site; 0 where there is none; and their logarithms.

    Rounded by way of 8 digits, so that the order in which rows are summed does not show."""
    of = lambda p: F.when(F.col("Parameter") == p, F.col("Value"))
    named = {"PM25_mean": F.avg(of("PM2.5")), "PM25_max": F.max(of("PM2.5")), "PM25_std": F.stddev(of("PM2.5")), "OZONE_mean": F.avg(of("OZONE")), "OZONE_max": F.max(of("OZONE"))}
    p = a.groupBy(*keys).agg(*[F.round(F.round(c, 8), 2).alias(n) for n, c in named.items()]).fillna(0.0, list(named))
    return p.withColumns({f"{n}_log": F.log1p(n) for n in ("PM25_max", "PM25_std", "OZONE_max")})


def counts(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Rows by value, the most frequent first, ties by value."""
    c = df.groupBy(F.col(col).alias("value")).count().orderBy(F.desc("count"), "value")
    return c if limit is None else c.limit(limit)


def overview(a: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct sites, first and last time."""
    sites = F.approx_count_distinct("SiteID") if approximate else F.countDistinct("SiteID")
    return a.agg(F.count("*").alias("rows"), sites.alias("sites"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, least and largest of each column, a row for each."""
    shape = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{s}").alias(s) for s in ("count", "mean", "stddev", "min", "max")]) for c in cols]))
    stats = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("count", F.count), ("mean", F.avg), ("stddev", F.stddev), ("min", F.min), ("max", F.max))]
    return df.agg(*stats).select(shape.alias("s")).select("s.*")


def cluster_statistics(df: DataFrame, cols: list[str], cluster: str = "cluster", time: str | None = "timestamp") -> DataFrame:
    hour = [F.avg(F.hour(time)).alias("mean_hour")] if time else []
    return df.groupBy(cluster).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *hour, F.count("*").alias("size"))


def cluster_bias(stats: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Each cluster's difference to the one before it, in a few columns of ``cluster_statistics`` (a row for each cluster)."""
    w = Window.orderBy(cluster)
    return stats.select(cluster, *[(F.col(c) - F.lag(c).over(w)).alias(f"diff_{c}") for c in cols])


def forecast_metrics(f: DataFrame, by: tuple[str, ...] = ("Model_Name", "Forecast_Type")) -> DataFrame:
    """Mean absolute error and root mean squared error (2 digits) and squared correlation (4 digits) of rows with both values."""
    a, p = F.col("Actual_PM25"), F.col("Predicted_PM25")
    return f.filter(a.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(a - p)), 2).alias("MAE"), F.round(F.sqrt(F.avg((a - p) * (a - p))), 2).alias("RMSE"), F.round(F.pow(F.corr(a, p), 2), 4).alias("R2"))


def regression_metrics(f: DataFrame, actual: str = "Actual_PM25", predicted: str = "Predicted_PM25", by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R² = 1 - SSE / SST, in one pass."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    g = f.filter(e.isNotNull()).groupBy(*by).agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"), (F.var_pop(a)).alias("_v"))
    return g.select(*by, "MAE", "MSE", F.sqrt("MSE").alias("RMSE"), (1 - F.try_divide(F.col("MSE"), F.col("_v"))).alias("R2"))


def percentiles(df: DataFrame, col: str, shares: list[float], few: int = FEW) -> list[float | None]:
    """Exact percentiles, between two values in proportion; null values don't count.

    An approximate quantile brackets each rank, and brackets are narrowed until at most ``few`` values, or equal ones alone, are left; only these are sorted
    at the driver. So no task holds all distinct values, and the passes grow with the logarithm of the rows.
    """
    v = written(df.select(F.col(col).cast("double").alias("v")).filter("v is not null"), "values")
    n = v.count()

    def at(rank: int) -> float:
        lo, hi, below, m = None, None, 0, n
        while m > few:
            part = v if lo is None else v.filter(F.col("v").between(lo, hi))
            share, width = (rank - below) / m, 0.01
            new = part.approxQuantile("v", [max(0.0, share - width), min(1.0, share + width)], width / 4)
            if (lo, hi) == tuple(new) or new[0] == new[1]:
                less, same = v.agg(F.count_if(F.col("v") < new[0]), F.count_if(F.col("v") == new[0])).first()
                if less <= rank < less + same:
                    return new[0]
                if (lo, hi) == tuple(new):  # narrow by the value itself
                    new = [lo, v.filter(F.col("v") < hi).agg(F.max("v")).first()[0]] if rank < less else [v.filter(F.col("v") > lo).agg(F.min("v")).first()[0], hi]
            lo, hi = new
            below, m = v.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))).first()
        part = v if lo is None else v.filter(F.col("v").between(lo, hi))
        return sorted(r["v"] for r in part.collect())[rank - below]

    def one(share: float) -> float | None:
        place = share * (n - 1)
        low = int(place)
        a = at(low)
        return a if place == low else a + (place - low) * (at(low + 1) - a)

    out = [one(s) if n else None for s in shares]
    dropped(v)
    return out


def quartiles(df: DataFrame, col: str, error: float | None = None) -> DataFrame:
    """q1, q3 and their distance: exact, or approximate with a relative error (in one pass)."""
    if error is None:
        q = F.array(*[F.lit(x).cast("double") for x in percentiles(df, col, [0.25, 0.75])])
        one = df.sparkSession.range(1).select(q.alias("q"))
    else:
        one = df.agg(F.percentile_approx(col, [0.25, 0.75], int(1 / error)).alias("q"))
    return one.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))


def flag_iqr(df: DataFrame, col: str, factor: float = 2.0, error: float | None = None) -> DataFrame:
    """``df`` with is_anomaly: the value lies more than ``factor`` quartile distances above the third quartile."""
    q = quartiles(df, col, error).select((F.col("q3") + factor * F.col("iqr")).alias("_limit"))
    return df.join(F.broadcast(q)).withColumn("is_anomaly", (F.col(col) > F.col("_limit")).cast("int")).drop("_limit")  # q is one row


def anomaly_share(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return df.agg(F.sum(flag).alias("anomalies"), F.count("*").alias("total"), F.round(100 * F.avg(flag), 2).alias("percent"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Rows in each of ``bins`` equal parts of the column's range: bin, low, count."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width: Column = (F.col("hi") - F.col("lo")) / bins
    rows = df.select(col).filter(F.col(col).isNotNull()).join(F.broadcast(ends))  # ends is one row
    rows = rows.withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("lo"), width)), F.lit(0)).cast("int")))
    return rows.groupBy("bin").agg(F.first(F.col("lo") + F.col("bin") * width).alias("low"), F.count("*").alias("count"))
