"""Streams over the given events, run to their end; their tables are compared with what SQL says of the closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.aqi import aqi_band
from ..interim import shared_path
from ..operators import windows as batch_windows
from ..sources.paced import paced, slices_of
from ..streaming import heads, state, windows
from .air_queries import _average_sql, _maximum_sql, plain, sql_stamp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    return shared_path(spark, "stream")


def _events_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Measurements as a stream of files in no order, all of which one batch reads."""
    m = fx.measurements(spark, sf_dir).select("event_id", "time", "city", "state", "pollutant", "aqi")
    m.write.parquet(f"{folder}/in")
    return spark.readStream.schema(m.schema).parquet(f"{folder}/in")


def _run(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is, and reads what it wrote."""
    df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


_CLOSED = "SELECT * FROM ({}) WHERE strptime(time_end, '%Y-%m-%d %H:%M:%S') + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events)"


def stream_avg_city_hour(spark, sf_dir):
    folder = _folder(spark)
    return plain(_run(windows.averages(_events_stream(spark, sf_dir, folder), "avg_city_hour"), folder))


def stream_max_state_hour(spark, sf_dir):
    folder = _folder(spark)
    return plain(_run(windows.maxima(_events_stream(spark, sf_dir, folder), by_city=False), folder))


def stream_ema_zscore(spark, sf_dir):
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    scored = _run(state.ema_zscore_stream(_events_stream(spark, sf_dir, folder)), folder)
    return plain(scored.select("event_id", "city", "state", "pollutant", "aqi", "count", "ema", "emvar", "z", "trend", "predicted"), steady=True)


def stream_dedup_alerts(spark, sf_dir):
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    alerts = _events_stream(spark, sf_dir, folder).filter("aqi >= 100").withColumn("category", aqi_band(F.col("aqi")))
    return plain(_run(state.dedup_alerts_stream(alerts, 6 * 3600), folder))


SLICES = 6
#: How late a reading may be.
LATE = "12 hours"


def _paced_events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Measurements in six batches by time. One of 40 comes a batch late, one of 97 three."""
    m = fx.measurements(spark, sf_dir).select("event_id", "time", "city", "state", "pollutant", "aqi")
    e = F.col("event_id")
    return paced(m, slices_of(m, SLICES, F.when(e % 97 == 0, 3).when(e % 40 == 0, 1).otherwise(0)), SLICES, f"{folder}/in")


def _paced_sql(which: str = "true") -> str:
    """Measurements with the batch they come in; ``late``: up to when rows of that batch are too late, which the batches before the last one tell; and up to when all is closed.
    ``which``: the rows that the stream is of."""
    return f"""arrived AS (
  SELECT *, CAST(least({SLICES - 1}, (epoch_us(time) - lo) * {SLICES} // (hi - lo) + CASE WHEN event_id % 97 = 0 THEN 3 WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS INT) AS slice
  FROM measurements, (SELECT min(epoch_us(time)) AS lo, max(epoch_us(time)) AS hi FROM measurements)
), marks AS (
  SELECT s.slice, coalesce(max(epoch_us(a.time)) FILTER ({which}) // 1000 - 43200000, 0) AS late FROM range({SLICES}) s(slice) LEFT JOIN arrived a ON a.slice <= s.slice - 2 GROUP BY s.slice
), closed AS (SELECT max(epoch_us(time)) FILTER ({which}) // 1000 - 43200000 AS mark FROM measurements
), timely AS (SELECT a.* FROM arrived a JOIN marks USING (slice) WHERE epoch_us(a.time) > late * 1000)"""


def _with_paced(sql: str, which: str = "true") -> str:
    """``sql``, whose first view is measurements, over the readings that weren't too late and that the watermark has passed."""
    head, rest = sql.split(" FROM events)", 1)
    return f"{head} FROM events), {_paced_sql(which)}, passed AS (SELECT timely.* FROM timely, closed WHERE epoch_us(time) <= mark * 1000){rest.replace('measurements', 'passed')}"


def paced_avg_state_day(spark, sf_dir):
    """Windows over several batches: a row too late for a window is left out of it, and each closed window comes once."""
    folder = _folder(spark)
    return plain(_run(windows.averages(_paced_events(spark, sf_dir, folder), "avg_state_day", grace=LATE), folder))


def paced_max_city_hour(spark, sf_dir):
    folder = _folder(spark)
    return plain(_run(windows.maxima(_paced_events(spark, sf_dir, folder), grace=LATE), folder))


def paced_ema_zscore(spark, sf_dir):
    """Readings that come late, but within the grace, are folded where they belong."""
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    scored = _run(state.ema_zscore_stream(_paced_events(spark, sf_dir, folder), LATE), folder)
    return plain(scored.select("event_id", "city", "state", "pollutant", "aqi", "count", "ema", "emvar", "z", "trend", "predicted"), steady=True)


def paced_dedup_alerts(spark, sf_dir):
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    alerts = _paced_events(spark, sf_dir, folder).filter("aqi >= 100").withColumn("category", aqi_band(F.col("aqi")))
    return plain(_run(state.dedup_alerts_stream(alerts, 6 * 3600, LATE, in_order=True), folder))


def paced_topk(spark, sf_dir):
    """The top list after each batch, kept in state; stations fall out and come back."""
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    return _run(heads.topk_stream(_paced_events(spark, sf_dir, folder)), folder)


def paced_retained_topk(spark, sf_dir):
    """The list that remembers ten entries only, after each batch."""
    folder = _folder(spark)
    spark.conf.set(*state.PROVIDER)
    return _run(heads.retained_topk_stream(_paced_events(spark, sf_dir, folder)), folder).select("slice", "rank", "station", "aqi")


def _register() -> None:
    from .air_queries import ORACLES as AIR

    QUERIES.update({f.__name__: f for f in (stream_avg_city_hour, stream_max_state_hour, stream_ema_zscore, stream_dedup_alerts)})
    keys, size, hop = batch_windows.AVERAGES["avg_city_hour"]
    ORACLES["stream_avg_city_hour"] = _CLOSED.format(_average_sql(keys, batch_windows.seconds(size), batch_windows.seconds(hop)))
    ORACLES["stream_max_state_hour"] = _CLOSED.format(_maximum_sql(batch_windows.STATE))
    ORACLES["stream_ema_zscore"] = AIR["ema_zscore"]
    ORACLES["stream_dedup_alerts"] = AIR["dedup_alerts"]
    QUERIES.update({f.__name__: f for f in (paced_avg_state_day, paced_max_city_hour, paced_ema_zscore, paced_dedup_alerts, paced_topk, paced_retained_topk)})
    ORACLES["paced_ema_zscore"] = _with_paced(AIR["ema_zscore"])
    ORACLES["paced_dedup_alerts"] = _with_paced(AIR["dedup_alerts"], "aqi >= 100")
    ORACLES["paced_avg_state_day"] = f"""{fx.with_views("measurements")}, {_paced_sql()}, hops AS (
  SELECT a.state, a.pollutant, a.aqi, (epoch_us(a.time) // 28800000000 - k) * 28800 AS s FROM arrived a JOIN marks USING (slice), range(3) r(k), closed
  WHERE (s + 86400) * 1000 > late AND (s + 86400) * 1000 <= mark
)
SELECT {sql_stamp("make_timestamp(s * 1000000)")} AS time_start, {sql_stamp("make_timestamp((s + 86400) * 1000000)")} AS time_end, state, pollutant, round(avg(aqi), 6) AS aqi FROM hops GROUP BY s, state, pollutant"""
    ORACLES["paced_max_city_hour"] = f"""{fx.with_views("measurements")}, {_paced_sql()}, hours AS (
  SELECT a.city, a.state, a.pollutant, a.aqi, epoch_us(a.time) // 3600000000 * 3600 AS s FROM arrived a JOIN marks USING (slice), closed WHERE (s + 3600) * 1000 > late AND (s + 3600) * 1000 <= mark
)
SELECT {sql_stamp("make_timestamp(s * 1000000)")} AS time_start, {sql_stamp("make_timestamp((s + 3600) * 1000000)")} AS time_end, city, state, pollutant, greatest(0, max(aqi)) AS aqi FROM hours GROUP BY s, city, state, pollutant"""
    ORACLES["paced_topk"] = f"""{fx.with_views("measurements")}, {_paced_sql()}, last AS (
  SELECT n.slice, concat(city, ' - ', state) AS station, pollutant, CAST(aqi AS DOUBLE) AS aqi FROM arrived a JOIN range({SLICES}) n(slice) ON a.slice <= n.slice
  QUALIFY row_number() OVER (PARTITION BY n.slice, city, state ORDER BY time DESC, event_id DESC) = 1
)
SELECT CAST(slice AS INT) AS slice, CAST(row_number() OVER (PARTITION BY slice ORDER BY aqi DESC, station, pollutant) AS INT) AS rank, station, pollutant, aqi FROM last QUALIFY rank <= 10"""


_register()
