"""One-step forecasts: a linear model for each site from Spark's sums, boosted trees over all sites."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..interim import dropped, sized
from .aggregate import daily_mean
from .series import DAILY, HOURLY, add_lags, calendar, split_tag

#: Least rows of a site, and of its training part.
LEAST = {"daily": (50, 30), "hourly": (200, 150)}


def features(s: DataFrame, grain: str = "hourly") -> tuple[DataFrame, list[str]]:
    """Lags and calendar columns of SiteID, timestamp, PM25 (daily: of daily means), with _rows, the site's number of rows."""
    hourly = grain == "hourly"
    if not hourly:
        s = daily_mean(s).select("SiteID", F.col("Date").cast("timestamp").alias("timestamp"), "PM25")
    lags = HOURLY if hourly else DAILY
    f = calendar(add_lags(s, lags), hourly).withColumn("_rows", F.count("*").over(Window.partitionBy("SiteID")))
    return f, [*[f"lag_{k}" for k in lags], *(["hour_sin", "hour_cos"] if hourly else []), "dow_sin", "dow_cos"]


def usable(f: DataFrame, xs: list[str], cutoff: Column, grain: str) -> DataFrame:
    """Complete rows of sites with enough rows, tagged Train or Test by the cutoff."""
    least, least_train = LEAST[grain]
    f = f.filter(F.col("_rows") >= least).na.drop(subset=[*xs, "PM25"]).withColumn("Forecast_Type", split_tag(cutoff))
    w = Window.partitionBy("SiteID")
    n = lambda t: F.count_if(F.col("Forecast_Type") == t).over(w)
    return f.withColumn("_train", n("Train")).withColumn("_test", n("Test")).filter((F.col("_train") >= least_train) & (F.col("_test") > 0)).drop("_train", "_test", "_rows")


def normal_equations(f: DataFrame, xs: list[str], y: str = "PM25", key: str = "SiteID") -> DataFrame:
    """For each site the sums of products of all pairs of columns (and 1): one row, whatever the site's number of rows."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    pairs = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    return f.groupBy(key).agg(F.array(*pairs).alias("xx"), F.array(*[F.sum(a * F.col(y)) for a in cols]).alias("xy"), F.count("*").alias("n"))


def _solved(size: int):
    """A small least-squares solution for each row of sums."""

    @F.pandas_udf("array<double>")
    def coefficients(xx: pd.Series, xy: pd.Series) -> pd.Series:
        upper = np.triu_indices(size)
        out = []
        for a, b in zip(xx, xy, strict=True):
            m = np.zeros((size, size))
            m[upper] = a
            out.append(np.linalg.lstsq(m + np.triu(m, 1).T, np.asarray(b, float), rcond=1e-10)[0])
        return pd.Series(out)

    return coefficients


def solve(sums: DataFrame, size: int, key: str = "SiteID") -> DataFrame:
    """Coefficients of each site (intercept first)."""
    return sums.select(key, "n", _solved(size)("xx", "xy").alias("beta"))


def predicted(xs: list[str]) -> Column:
    out = F.col("beta")[0]
    for i, x in enumerate(xs, 1):
        out = out + F.col("beta")[i] * F.col(x)
    return out


def next_rows(f: DataFrame, grain: str = "hourly") -> DataFrame:
    """Each site's features one step after its last row."""
    hourly = grain == "hourly"
    lags = HOURLY if hourly else DAILY
    last = f.groupBy("SiteID").agg(F.max_by(F.struct("timestamp", "PM25", *[f"lag_{k}" for k in lags]), "timestamp").alias("l")).select("SiteID", "l.*")
    # The longest lag: the value that many rows before the next one.
    w = Window.partitionBy("SiteID").orderBy(F.desc("timestamp"))
    far = f.select("SiteID", "PM25", F.row_number().over(w).alias("_r")).filter(F.col("_r") == lags[-1]).select("SiteID", F.col("PM25").alias("_far"))
    step = F.expr("INTERVAL 1 HOUR" if hourly else "INTERVAL 1 DAY")
    new = last.join(far, "SiteID", "left").select("SiteID", (F.col("timestamp") + step).alias("timestamp"), F.lit(None).cast("double").alias("PM25"), F.col("PM25").alias("lag_1"), F.col("lag_1").alias("lag_2"), F.col("lag_2").alias("lag_3"), F.coalesce("_far", "PM25").alias(f"lag_{lags[-1]}"))
    return calendar(new, hourly).withColumn("Forecast_Type", F.lit("Next"))


def _shaped(df: DataFrame, model: str) -> DataFrame:
    return df.select("SiteID", "timestamp", F.lit(model).alias("Model_Name"), F.col("PM25").alias("Actual_PM25"), F.col("prediction").alias("Predicted_PM25"), "Forecast_Type")


def forecast_linear(s: DataFrame, cutoff: Column, grain: str = "hourly") -> DataFrame:
    """Train, Test and Next rows of each site under its own linear model.

    Fitting is a sum over rows by site (combined before the shuffle) and a small solution for each site; predicting is a column expression
    after a join by site. Sites with too few rows give none (see ``site_status``).
    """
    f, xs = features(s, grain)
    rows = usable(f, xs, cutoff, grain)
    beta = solve(normal_equations(rows.filter("Forecast_Type = 'Train'"), xs), len(xs) + 1).select("SiteID", "beta")
    every = rows.select("SiteID", "timestamp", "PM25", *xs, "Forecast_Type").unionByName(next_rows(rows, grain).select("SiteID", "timestamp", "PM25", *xs, "Forecast_Type"))
    return _shaped(every.join(beta, "SiteID").withColumn("prediction", predicted(xs)), "LinearRegression")


def site_status(s: DataFrame, cutoff: Column, grain: str = "hourly") -> DataFrame:
    """SiteID, rows, status of each site: ok, or why it has no forecast."""
    f, xs = features(s, grain)
    least, least_train = LEAST[grain]
    whole = F.lit(True)
    for x in xs:
        whole = whole & F.col(x).isNotNull()
    g = f.groupBy("SiteID").agg(F.count("*").alias("rows"), F.count_if(whole & (F.col("timestamp") < cutoff)).alias("train"), F.count_if(whole & (F.col("timestamp") >= cutoff)).alias("test"))
    return g.select("SiteID", "rows", F.when(F.col("rows") < least, "too few rows").when(F.col("train") < least_train, "too few training rows").when(F.col("test") == 0, "no test rows").otherwise("ok").alias("status"))


def _assembled(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="features").transform(df)


#: Rows of a task's share of a table that is read again for each level of each tree.
SHARE = 100_000


def forecast_gbt(s: DataFrame, cutoff: Column, grain: str = "hourly", trees: int = 80, depth: int = 4, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Train, Test and Next rows under one model of boosted trees over all sites."""
    f, xs = features(s, grain)
    rows = usable(f, xs, cutoff, grain)
    cols = ["SiteID", "timestamp", "PM25", *xs, "Forecast_Type"]
    rows = sized(rows.select(*cols), "features", SHARE)
    train = _assembled(rows.filter("Forecast_Type = 'Train'"), xs)
    if train.isEmpty():
        return s.sparkSession.createDataFrame([], "SiteID string, timestamp timestamp, Model_Name string, Actual_PM25 double, Predicted_PM25 double, Forecast_Type string")
    model = GBTRegressor(featuresCol="features", labelCol="PM25", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(train)
    every = rows.select(*cols).unionByName(next_rows(rows, grain).select(*cols))
    return _shaped(model.transform(_assembled(every, xs)), "BoostedTrees")


#: Bins of a feature, as many as Spark's trees have by default; rows of a task's share of a table that several fits read at the same time.
BINS, TUNED = 32, 250_000


def _bounds(rows: DataFrame, xs: list[str]) -> list[list[float]]:
    """For each column the borders of its bins, from all rows: between all its values if these are few, else after quantiles."""
    out = []
    for x, q in zip(xs, rows.approxQuantile(xs, [i / BINS for i in range(1, BINS)], 0.001), strict=True):
        borders = np.nextafter(np.unique(q), np.inf)
        if len(borders) < BINS - 1 and len(few := rows.select(x).distinct().limit(BINS + 1).collect()) <= BINS:
            values = np.unique([r[0] for r in few])
            borders = (values[1:] + values[:-1]) / 2
        out.append([-np.inf, *map(float, borders), np.inf])
    return out


def _cells(rows: DataFrame, xs: list[str], bounds: list[list[float]]) -> DataFrame:
    """Rows in the same bins of all columns as one: features (numbers of the bins), n, PM25 (their mean), rest (their squared distances from it).

    Boosting by squares takes such rows apart nowhere, so its trees are those of all rows, and its error is known from these sums.
    """
    names = [f"{x}_bin" for x in xs]
    binned = Bucketizer(splitsArray=bounds, inputCols=xs, outputCols=names).transform(rows)
    n = F.count("*").cast("double")
    numbers = [F.col(b).cast("int").alias(b) for b in names]  # a cast number is no category any more: bins have an order
    cells = sized(binned.groupBy(*numbers).agg(n.alias("n"), F.avg("PM25").alias("PM25"), (n * F.var_pop("PM25")).alias("rest")), "cells", TUNED)
    return _assembled(cells, names).select("n", "PM25", "rest", "features")


def tune_gbt(s: DataFrame, cutoff: Column, grain: str = "hourly", draws: int = 3, folds: int = 3, seed: int = 42, grid: dict[str, list] | None = None, at_once: int = 8) -> DataFrame:
    """trees, depth, rate, rmse of random draws from a grid; each fold learns from the time before it.

    The features are computed and written once, and each fold's rows once as cells (see ``_cells``), which grow with the rows only until the bins that occur together are filled. A fold's
    bins come from the rows that it learns from. The fits don't depend on one another, so ``at_once`` of them, the longest first, are Spark jobs of this session at the same time: while
    one waits for its driver, others use the cluster. A fold without rows to learn from or to judge by counts for nothing.
    """
    grid = grid or {"trees": [50, 100, 150], "depth": [3, 5, 7], "rate": [0.01, 0.05, 0.1]}
    f, xs = features(s, grain)
    rows = sized(usable(f, xs, cutoff, grain).filter("Forecast_Type = 'Train'").select(F.unix_seconds("timestamp").cast("double").alias("t"), F.col("PM25").cast("double").alias("PM25"), *xs), "tuning", SHARE)
    ends = rows.approxQuantile("t", [i / (folds + 1) for i in range(1, folds + 2)], 0.001)
    picks = [list(product(*grid.values()))[i] for i in np.random.default_rng(seed).permutation(int(np.prod([len(v) for v in grid.values()])))[:draws]]

    @inheritable_thread_target(s.sparkSession)
    def parted(i: int) -> tuple[DataFrame, DataFrame] | None:
        train, test = rows.filter(F.col("t") <= ends[i]), rows.filter((F.col("t") > ends[i]) & (F.col("t") <= ends[i + 1]))
        if train.isEmpty() or test.isEmpty():
            return None
        bounds = _bounds(train, xs)
        return _cells(train, xs, bounds), _cells(test, xs, bounds)

    @inheritable_thread_target(s.sparkSession)
    def error(trees: int, depth: int, rate: float, i: int) -> float:
        train, test = parts[i]
        model = GBTRegressor(featuresCol="features", labelCol="PM25", weightCol="n", maxBins=BINS, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(train)
        off = F.col("PM25") - F.col("prediction")
        return model.transform(test).agg(F.sqrt(F.sum(F.col("n") * off * off + F.col("rest")) / F.sum("n"))).first()[0]

    with ThreadPoolExecutor(at_once) as pool:
        parts = [part.result() for part in [pool.submit(parted, i) for i in range(folds if ends else 0)]]
        due = sorted(((pick, i) for pick in picks for i, part in enumerate(parts) if part), key=lambda k: -k[0][0] * k[0][1] * (k[1] + 1))
        fits = {k: pool.submit(error, *k[0], k[1]) for k in due}
        errors = {k: fit.result() for k, fit in fits.items()}
    mean = lambda pick: (lambda known: float(np.mean(known)) if known else None)([e for i in range(folds) if (e := errors.get((pick, i))) is not None])
    for table in (rows, *[t for part in parts if part for t in part]):
        dropped(table)
    return s.sparkSession.createDataFrame([(trees, depth, float(rate), mean((trees, depth, rate))) for trees, depth, rate in picks], "trees int, depth int, rate double, rmse double")


def tuned_forecast(s: DataFrame, cutoff: Column, grain: str = "hourly", **how) -> DataFrame:
    """Train, Test and Next rows under boosted trees with the settings that ``tune_gbt`` finds best (ties: fewer, flatter trees)."""
    best = min((r for r in tune_gbt(s, cutoff, grain, **how).collect() if r["rmse"] is not None), key=lambda r: (r["rmse"], r["trees"], r["depth"]), default=None)
    return forecast_gbt(s, cutoff, grain, **({"trees": best["trees"], "depth": best["depth"], "rate": best["rate"]} if best else {}))


def walk_forward_fit(s: DataFrame, cutoff: Column, lags: tuple[int, ...] = (1,), least: int = 30) -> DataFrame:
    """SiteID, timestamp, actual, beta (constant first), predicted of each row from the cutoff on: a linear model refitted on all the site's rows before it.

    Sums of products run along each site's rows; a row's model is a small solution from the sums up to the row before it, whole batches of rows at once. Rows with fewer than ``least``
    complete rows before them have none.
    """
    xs = [f"lag_{k}" for k in lags]
    f = add_lags(s, lags).na.drop(subset=[*xs, "PM25"])
    cols, size = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]], len(xs) + 1
    before = Window.partitionBy("SiteID").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    pairs = [F.sum(a * b).over(before) for i, a in enumerate(cols) for b in cols[i:]]
    sums = f.select("SiteID", "timestamp", F.col("PM25").alias("actual"), F.array(*cols).alias("_x"), F.array(*pairs).alias("xx"), F.array(*[F.sum(a * F.col("PM25")).over(before) for a in cols]).alias("xy"), F.count("*").over(before).alias("_n"))
    sums = sums.filter((F.col("timestamp") >= cutoff) & (F.col("_n") >= least))
    fitted = sums.select("SiteID", "timestamp", "actual", "_x", _solved(size)("xx", "xy").alias("beta"))
    return fitted.select("SiteID", "timestamp", "actual", "beta", F.aggregate(F.zip_with("_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("predicted"))
