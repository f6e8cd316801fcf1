"""Isolation forest: each tree grows in its own task from a small hash sample; scoring is a broadcast of the trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE = 200, 256
_EULER = 0.5772156649015329


def mean_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + _EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[int], list[float], list[int], list[float]]:
    """A tree as arrays: column (-1 in a leaf), cut, left child (right is the next), and a leaf's path length."""
    column, cut, left, size = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = (part.min(0), part.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            size[at] = depth + float(mean_depth(len(rows)))
            continue
        c = int(rng.choice(open_))
        cut[at], column[at], left[at] = float(rng.uniform(lo[c], hi[c])), c, len(column)
        for new in (rows[part[:, c] < cut[at]], rows[part[:, c] >= cut[at]]):
            todo.append((len(column), new, depth + 1))
            column.append(-1), cut.append(0.0), left.append(0), size.append(0.0)
    return column, cut, left, size


def isolation_forest_fit(df: DataFrame, cols: list[str], key: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """A row for each tree. Each row of ``df`` goes to a tree with a chance that gives it about ``sample`` rows, of which it takes at most that
    many; so what is shuffled does not grow with the data."""
    n = max(1, df.count())
    share = min(1.0, 1.5 * sample / n)
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One draw decides in how many trees a row is, so rows in none are not multiplied.
    picks = df.select(*key, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("t", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < share)))
    picks = picks.withColumn("o", h(F.col("t") + trees))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        t = int(part["t"].iloc[0])
        x = part.sort_values("o").head(sample)[cols].to_numpy()
        column, cut, left, size = _grow(x, np.random.default_rng(seed * 1000 + t), max(1, int(np.ceil(np.log2(max(2, min(sample, len(x))))))))
        return pd.DataFrame({"tree": [t], "n": [len(x)], "column": [column], "cut": [cut], "left": [left], "size": [size]})

    return picks.groupBy("t").applyInPandas(build, "tree int, n int, column array<int>, cut array<double>, left array<int>, size array<double>")


def _looped(column: np.ndarray, cut: np.ndarray, left: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree whose leaves lead to themselves, so that all rows take the same number of steps, and that number."""
    leaf, depth = column < 0, np.zeros(len(column), int)
    for i in np.flatnonzero(~leaf):  # children come after their parent
        depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
    return np.where(leaf, 0, column), np.where(leaf, np.nan, cut), np.where(leaf, np.arange(len(column)), left), size, int(depth.max())


def isolation_forest_score(df: DataFrame, forest: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with score = 2^(-E[path] / c(n)); higher is more anomalous. The forest is of a fixed size (trees times sample), so it is broadcast."""
    rows = forest.orderBy("tree").collect()
    model = df.sparkSession.sparkContext.broadcast([_looped(*[np.array(r[c]) for c in ("column", "cut", "left", "size")]) for r in rows])
    norm = float(np.mean(mean_depth([r["n"] for r in rows]))) if rows else 1.0

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        x = np.concatenate([p.to_numpy(float) for p in parts])
        n = len(parts[0])
        total, every = np.zeros(n), np.arange(n)
        for column, cut, left, size, depth in model.value:
            at = np.zeros(n, int)
            for _ in range(depth):
                at = left.take(at) + (x.take(column.take(at) * n + every) >= cut.take(at))
            total += size.take(at)
        return pd.Series(np.exp2(-total / max(1, len(model.value)) / max(norm, 1e-9)))

    return df.withColumn("score", score(*[F.col(c).cast("double") for c in cols]))
