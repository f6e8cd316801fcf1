"""Where streams and tables go. Batch writers of streams are safe to repeat: a batch that is retried replaces its own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..interim import removed
from ..operators.joins import latest_per_key
from ..operators.parse import branch, high

LATEST_KEY = ["state", "city", "pollutant"]
#: Versions of a latest-value table that stay.
KEPT = 3
#: An archive file's rows at most.
ROTATE = 10_000


def write_archive(m: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery | None:
    """Parquet by date and hour (UTC) of the measurement; a stream writes once an hour unless told otherwise."""
    dated = m.withColumn("date", F.to_date("time")).withColumn("hour", F.date_format("time", "HH"))
    if not m.isStreaming:
        dated.write.mode("append").option("maxRecordsPerFile", ROTATE).partitionBy("date", "hour").parquet(path)
        return None
    out = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", ROTATE)
    return out.partitionBy("date", "hour").trigger(**trigger or {"processingTime": "1 hour"}).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of complete versions, the oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [f for f in found if "/v=" in f and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    return sorted(done, key=lambda f: int(f.rpartition("=")[2]))


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a latest-value table (before a given one), or None."""
    found = [f for f in versions(spark, path) if before is None or int(f.rpartition("=")[2]) < before]
    return spark.read.parquet(found[-1]) if found else None


def upsert_latest(m: DataFrame, path: str, version: int, keys: list[str] = LATEST_KEY, time: str = "time", ties: tuple[str, ...] = ()) -> None:
    """Merges rows into a table of the latest row for each key. Each version is a folder of its own, so a failed write leaves the last one
    as it was and a repeated one replaces itself; the newest KEPT stay."""
    old = read_latest(m.sparkSession, path, before=version)
    rows = m if old is None else m.unionByName(old, allowMissingColumns=True)
    latest_per_key(rows, keys, time, *ties).write.mode("overwrite").parquet(f"{path}/v={version}")
    for old_path in versions(m.sparkSession, path)[:-KEPT]:
        removed(m.sparkSession, old_path)


def append_aggregate(df: DataFrame, path: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A windowed aggregate's closed windows, as they close, into a table of its own."""
    return df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/{table_name_of(name)}").option("checkpointLocation", f"{checkpoint}/{name}").queryName(name.replace("-", "_")).trigger(**trigger or {"processingTime": "1 minute"}).start()


def table_name_of(topic: str) -> str:
    return topic.replace("-", "_")


def table_name(topic: Column) -> Column:
    """The table that a topic's rows go to."""
    return F.regexp_replace(topic, "-", "_")


def route(df: DataFrame, path: str, topic: str = "topic") -> None:
    """Rows to folders by their topic's table."""
    df.withColumn("table", table_name(F.col(topic))).write.mode("append").partitionBy("table").parquet(path)


def fan_out(batch: DataFrame, version: int, path: str) -> None:
    """One batch of measurements to five outputs: all, by pollutant, and high ones. For ``foreachBatch``; a repeated batch replaces itself."""
    batch.persist()
    try:
        for name, rows in {"all": batch, "o3": branch(batch, "O3"), "pm25": branch(batch, "PM2.5"), "pm10": branch(batch, "PM10"), "high": high(batch)}.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={version}")
    finally:
        batch.unpersist()


def append_alerts(batch: DataFrame, version: int, path: str, keys: tuple[str, ...] = ("time", "city", "state", "pollutant")) -> None:
    """Alerts whose key isn't stored yet, stamped with the time of writing. They lie by batch and date of the first key, and only the batch's dates are read."""
    spark, day = batch.sparkSession, F.to_date(keys[0])
    new = batch.dropDuplicates(list(keys))
    first, last = batch.agg(F.min(day), F.max(day)).first()
    if first and _exists(spark, path):
        stored = spark.read.parquet(path).filter((F.col("batch") != version) & F.col("date").between(first, last))
        new = new.join(stored.select(*keys), list(keys), "left_anti")
    stamped(new).withColumn("date", day).write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={version}")


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.current_timestamp())


def each_batch(df: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Any number of such consumers may run on one stream, each with its own checkpoint."""
    return df.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
