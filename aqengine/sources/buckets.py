"""A table of the latest row of each key, in buckets of keys: a batch rewrites only those it touches.

``data/v=N/bucket=B`` holds what version N wrote of bucket B; ``manifest/v=N`` is a small file that names the folder of every bucket as version N leaves it. The manifest is written
last, so a version is there as a whole or not at all, and readers of an older one keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..interim import removed
from ..operators.joins import latest_per_key
from .sinks import KEPT, LATEST_KEY, versions

#: Buckets of a table; fixed once it has rows.
BUCKETS = 64


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict[int, str]:
    """The live folder of each bucket, at most BUCKETS of them."""
    found = [f for f in versions(spark, f"{path}/manifest") if before is None or int(f.rpartition("=")[2]) < before]
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").json(found[-1]).collect()} if found else {}


def _read(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*folders) if folders else None


def read_bucketed(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (before a given one), or None."""
    return _read(spark, sorted(_manifest(spark, path, before).values()))


def upsert_bucketed(m: DataFrame, path: str, version: int, keys: list[str] = LATEST_KEY, time: str = "time", ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """Merges rows into the table. A version that is written again replaces itself, and the newest KEPT can still be read; folders that none of these names are deleted."""
    spark, live = m.sparkSession, _manifest(m.sparkSession, path, version)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = m.withColumn("bucket", place)
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    old = _read(spark, [live[b] for b in touched if b in live])
    rows = new if old is None else new.unionByName(old.withColumn("bucket", place), allowMissingColumns=True)
    data = f"{path}/data/v={version}"
    latest_per_key(rows, ["bucket", *keys], time, *ties).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    live |= {b: f"{data}/bucket={b}" for b in touched}
    spark.createDataFrame(sorted(live.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v={version}")
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    kept = versions(spark, f"{path}/manifest")
    named = {folder for f in kept[-KEPT:] for folder in _manifest(spark, path, int(f.rpartition("=")[2]) + 1).values()}
    for f in kept[:-KEPT]:
        for folder in set(_manifest(spark, path, int(f.rpartition("=")[2]) + 1).values()) - named:
            removed(spark, folder)
        removed(spark, f)
