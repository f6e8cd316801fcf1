"""Unions and distinct lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*parts: DataFrame) -> DataFrame:
    """Tables one under the other by column name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_sorted(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)
