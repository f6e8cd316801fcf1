"""Streams and tables that jobs read: feed items, measurements, archives, series, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import decode
from ..schemas import MEASUREMENT, SERIES, STATE_LOCATION


def read_feed(spark: SparkSession, at: str, servers: str | None = None, latest: bool = False) -> DataFrame:
    """A stream of feed items (key, content): from a folder of JSON envelopes, one in a line, or with ``servers`` from a topic.

    ``latest`` starts with what arrives from now on (topic) or with the newest files (folder); a checkpoint takes precedence.
    """
    if servers:
        raw = spark.readStream.format("kafka").options(subscribe=at, startingOffsets="latest" if latest else "earliest", **{"kafka.bootstrap.servers": servers}).load()
        raw = raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))
    else:
        raw = spark.readStream.option("latestFirst", str(latest).lower()).text(at).select(F.lit(None).cast("string").alias("key"), "value", F.current_timestamp().alias("ingest_ts"))
    return decode(raw).drop("value")


def read_measurements_stream(spark: SparkSession, path: str, fmt: str = "json", schema: str = MEASUREMENT, max_files: int | None = None) -> DataFrame:
    """A stream of typed measurements from files."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(path)


def from_avro_topic(spark: SparkSession, topic: str, servers: str, avro_schema: str) -> DataFrame:
    """A stream of measurements in Avro from a topic; needs the Kafka and Avro packages on the cluster."""
    from pyspark.sql.avro.functions import from_avro

    raw = spark.readStream.format("kafka").options(subscribe=topic, **{"kafka.bootstrap.servers": servers}).load()
    return raw.select(from_avro("value", avro_schema).alias("m")).select("m.*")


def read_archive(spark: SparkSession, *paths: str) -> DataFrame:
    """One table from any number of archive paths, columns by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def between(archive: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of an archive written by ``sinks.write_archive`` in a range of time: the folders' dates are filtered too, so others aren't listed."""
    return archive.filter(F.col("date").between(F.to_date(start), F.to_date(end)) & (F.col("time") >= start) & (F.col("time") < end))


def read_series_csv(spark: SparkSession, path: str, time: str = "timestamp") -> DataFrame:
    """SiteID, timestamp, PM25 from CSV with a header."""
    raw = spark.read.csv(path, header=True, schema=SERIES.replace("timestamp timestamp", f"{time} string"), enforceSchema=False)
    return raw.select("SiteID", F.try_to_timestamp(F.col(time)).alias("timestamp"), "PM25")


def normalise_timestamps(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """A Parquet table whose nanosecond times become microseconds, as Spark has them."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.timestamp_micros(F.expr(f"`{c}` div 1000")) if kinds[c] == "bigint" else F.col(c).cast("timestamp") for c in cols})


def load_city_locations(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """city, state, longitude, latitude from JSON lines; the first of each city, and only cities that aren't ``known``."""
    j = lambda p: F.get_json_object("value", p)
    rows = spark.read.text(path).select(j("$.city").alias("city"), j("$.state").alias("state"), j("$.longitude").try_cast("double").alias("longitude"), j("$.latitude").try_cast("double").alias("latitude"))
    first = rows.filter("city is not null and state is not null").groupBy("city", "state").agg(F.min(F.struct("longitude", "latitude")).alias("p")).select("city", "state", "p.*")
    return first if known is None else first.join(known.select("city", "state"), ["city", "state"], "left_anti")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """state, state_name, multipolygon (as text) from CSV with a header; quotes in quoted values are doubled."""
    return spark.read.csv(path, header=True, escape='"', schema=STATE_LOCATION)
