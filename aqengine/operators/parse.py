"""Feed items to typed measurements, as column expressions over the feed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import aqi_band, aqi_to_concentration
from ..schemas import ENVELOPE, POLLUTANTS

# The patterns of the feed's text.
LOCATION = r"<b>Location:</b>\s*([A-Za-zÀ-ÿ\s\-,().']+),\s*([A-Z]{2})"
READING = r"([A-Za-z]+)\s*-\s*(\d+) AQI - ([^<\n]+)"
PARTICLES = r"^Particle Pollution \(((\d+)(\.\d+)?) microns\)$"
UPDATED = "Last Update: ([^<]+)"
WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s*"
TIMES = ("dd MMM yyyy HH:mm:ss z", "dd MMM yyyy hh:mm:ss a z")


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with the feed text of a JSON envelope as ``content``; null where the JSON is bad."""
    return raw.withColumn("content", F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"})["payload"]["content"])


def pollutant_name(said: Column) -> Column:
    """Particle Pollution (x microns) is PMx; whatever else is O3."""
    size = F.regexp_extract(_trim(said), PARTICLES, 1)
    return F.when(size != "", F.concat(F.lit("PM"), size)).otherwise("O3")


def readings(found: Column) -> Column:
    """Array of (category, aqi, pollutant) of an item's matches. The category is its last word, as the feed's pattern has it."""
    part = lambda m, i: F.regexp_extract(m, READING, i)
    return F.transform(found, lambda m: F.struct(_trim(part(m, 1)).alias("category"), part(m, 2).try_cast("int").alias("aqi"), pollutant_name(part(m, 3)).alias("pollutant")))


def once(**columns: Column) -> Column:
    """A row's values, computed once: what follows a generator refers to them and doesn't repeat their expressions."""
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _items(feed: DataFrame) -> DataFrame:
    text = F.col("content")
    said = _trim(F.regexp_replace(_trim(F.regexp_extract(text, UPDATED, 1)), WEEKDAY, ""))
    place = F.regexp_extract(text, LOCATION, 0)
    items = feed.select("*", once(place=place, said=F.when(said != "", said), found=F.regexp_extract_all(text, F.lit(READING), F.lit(0))).alias("_raw"))
    time = F.coalesce(*[F.try_to_timestamp("_raw.said", F.lit(p)) for p in TIMES])
    city, state = (F.regexp_extract("_raw.place", LOCATION, i) for i in (1, 2))
    items = items.select(*feed.columns, once(city=_trim(city), state=state, time=time, readings=readings(F.col("_raw.found"))).alias("_item"))
    items = items.select(*feed.columns, "_item.*")
    bad = F.exists("readings", lambda r: ~r["pollutant"].isin(*POLLUTANTS) | r["aqi"].isNull())
    reason = F.when(text.isNull(), "no content").when(F.col("time").isNull(), "no time").when(bad, "bad reading")
    return items.withColumn("rejected", reason)


def parse_feed(feed: DataFrame, *keep: str) -> DataFrame:
    """A measurement for each reading of each item (content): valid ones only, with its concentration and numeric band.

    An item without a time, or with a reading of an unknown particle size or number, is dropped whole (see ``quarantine``); readings of
    index 0 and items without a city are dropped.
    """
    rows = _items(feed).filter(F.col("rejected").isNull()).select(*keep, "time", "city", "state", F.explode("readings").alias("r"))
    rows = rows.select(*keep, "time", "city", "state", "r.pollutant", "r.aqi", "r.category").filter((F.col("aqi") > 0) & (F.col("city") != ""))
    return rows.withColumn("concentration", aqi_to_concentration("aqi", "pollutant")).withColumn("band", aqi_band("aqi"))


def quarantine(feed: DataFrame) -> DataFrame:
    """The items that ``parse_feed`` drops whole, with the reason."""
    return _items(feed).filter(F.col("rejected").isNotNull()).drop("city", "state", "time", "readings")


def branch(m: DataFrame, pollutant: str) -> DataFrame:
    return m.filter(F.col("pollutant") == pollutant)


def high(m: DataFrame, least: int = 100) -> DataFrame:
    return m.filter(F.col("aqi") >= least)
