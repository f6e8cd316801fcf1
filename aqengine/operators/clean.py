"""Cleaning and imputation of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PARAMETERS, STATE_CODES
from .aggregate import percentiles

#: The highest plausible value of each parameter.
BOUNDS = {"PM2.5": 500.0, "PM10": 650.0, "OZONE": 500.0}
COLUMNS = ("timestamp", "Date", "Time", "SiteID", "SiteName", "StateCode", "CountyName", "ReportingAreaName", "Latitude", "Longitude", "Parameter", "Value", "Unit", "AgencyName")


def known_states(a: DataFrame) -> DataFrame:
    return a.filter(F.col("StateCode").isin(*STATE_CODES))


def known_parameters(a: DataFrame) -> DataFrame:
    return a.filter(F.col("Parameter").isin(*PARAMETERS))


def deduplicated(a: DataFrame, keys: tuple[str, ...] = ("SiteID", "timestamp", "Parameter"), order: tuple[str, ...] = ("Value",)) -> DataFrame:
    """One row for each key, the first in ``order``; with one column to order by, a minimum is taken before the shuffle."""
    rest = [c for c in a.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f")
    return a.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in a.columns])


def numeric(a: DataFrame) -> DataFrame:
    return a.withColumn("Value", F.expr("try_cast(Value AS double)"))


def quality_profile(a: DataFrame) -> DataFrame:
    """Count, missing, least, largest, mean and standard deviation of each parameter's values."""
    v = F.col("Value")
    return a.groupBy("Parameter").agg(F.count("Value").alias("count"), F.count_if(v.isNull() | F.isnan(v)).alias("nulls"), F.round(F.min(v), 2).alias("min"), F.round(F.max(v), 2).alias("max"), F.round(F.round(F.avg(v), 8), 2).alias("mean"), F.round(F.round(F.stddev(v), 8), 2).alias("stddev"))


def plausible(a: DataFrame, bounds: dict[str, float] = BOUNDS) -> DataFrame:
    """Values that are there, not negative, and within their parameter's bound; rows with a time."""
    v, bound = F.col("Value"), F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
    return a.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= F.try_element_at(bound, F.col("Parameter"))) & F.col("timestamp").isNotNull())


def sliced(a: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values (a list: any of them); the filters reach the scan."""
    for column, v in values.items():
        a = a.filter(F.col(column).isin(*v) if isinstance(v, list | tuple) else F.col(column) == v)
    return a


def clean(a: DataFrame) -> DataFrame:
    """The whole job: known states and parameters, no repeated rows, numbers, plausible values, fixed columns."""
    return plausible(numeric(deduplicated(known_parameters(known_states(a))))).select(*COLUMNS)


def impute_median(df: DataFrame, cols: list[str], error: float | None = None) -> DataFrame:
    """Nulls become the column's median: exact, or from an approximate quantile with a relative error."""
    if error is None:
        middle = {c: percentiles(df, c, [0.5])[0] for c in cols}
    else:
        middle = dict(zip(cols, ((q or [None])[0] for q in df.approxQuantile(cols, [0.5], error)), strict=True))
    return df.fillna({c: middle[c] for c in cols if middle[c] is not None})


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


def fill_gaps(df: DataFrame, col: str, key: str = "SiteID", time: str = "timestamp") -> DataFrame:
    """Forward fill along time within a key, then backward fill."""
    upto = lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before, after = (F.last(col, ignorenulls=True).over(upto(o)) for o in (F.asc(time), F.desc(time)))  # running both ways, each frame grows by a row
    return df.withColumn(col, F.coalesce(before, after))


def sample_by_hash(df: DataFrame, keys: list[str], per_mille: int) -> DataFrame:
    """A sample that any rerun repeats: rows whose key's hash falls into the first so many of a thousand parts."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1000)) < per_mille)
