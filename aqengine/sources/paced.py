"""A stream that comes slice by slice, so that lateness, closing windows and kept state happen between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..interim import shared_path


def slices_of(df: DataFrame, slices: int, held_back: Column | None = None, time: str = "time") -> Column:
    """The slice in which a row arrives: its part of the time there is, from 0, and ``held_back`` slices later, in the last one at most."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    lo, wide = lo or 0, max(1, (hi or 0) - (lo or 0))
    return F.least(F.lit(slices - 1), F.expr(f"({us._jc.toString()} - {lo}L) * {slices} div {wide}L") + (F.lit(0) if held_back is None else held_back)).cast("int")


def paced(df: DataFrame, arrival: Column, slices: int, folder: str, files: int = 1) -> DataFrame:
    """A stream of ``df`` in which a batch reads the rows of one slice. A slice is at most ``files`` files, written after those of the slice before, and files
    are read in the order of writing. The column ``slice`` stays."""
    spark, staged = df.sparkSession, shared_path(df.sparkSession, "slices")
    rows = df.withColumn("slice", arrival)
    rows.write.partitionBy("slice").parquet(staged)
    stored = spark.read.schema(rows.schema).parquet(staged)
    for i in range(slices):
        stored.filter(F.col("slice") == i).coalesce(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
