"""What the client computed from rows, moved into the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import aqi_band, severity
from ..functions.scalar import java_round, state_code

# Names of the states by code.
STATE_NAMES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM",
    "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
#: Fixed value: the map's centre without rows.
CENTRE = (37.0902, -95.7129)


def local_stats(m: DataFrame) -> DataFrame:
    """Rounded mean, rows, rows above 100, largest."""
    return m.agg(F.floor(F.avg("aqi") + 0.5).alias("average_aqi"), F.count("*").alias("sensors"), F.count_if(F.col("aqi") > 100).alias("alerts"), F.max("aqi").alias("max_aqi"))


def state_choropleth(m: DataFrame) -> DataFrame:
    """Mean and count of each state; rows without a state code or with a bad index are left out."""
    code = state_code(F.col("state"), F.col("city"))
    return m.select(code.alias("state"), F.col("aqi").cast("double").alias("aqi")).filter("state is not null and aqi >= 0 and not isnan(aqi)").groupBy("state").agg(F.avg("aqi").alias("avg_aqi"), F.count("*").alias("count"))


def heat_points(located: DataFrame) -> DataFrame:
    """Rows with a place, and their index as a share of the largest: at least 0.05."""
    rows = located.filter("longitude is not null and latitude is not null").withColumn("_raw", F.greatest(F.coalesce("aqi", F.lit(0)), F.lit(0)))
    top = rows.agg(F.greatest(F.coalesce(F.max("_raw"), F.lit(1)), F.lit(1)).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn("intensity", F.greatest(F.col("_raw") / F.col("_top"), F.lit(0.05))).drop("_raw", "_top")  # one row


def map_centre(located: DataFrame) -> DataFrame:
    return located.agg(F.coalesce(F.avg("latitude"), F.lit(CENTRE[0])).alias("latitude"), F.coalesce(F.avg("longitude"), F.lit(CENTRE[1])).alias("longitude"))


def filtered(m: DataFrame, location: str = "all", pollutant: str = "all") -> DataFrame:
    m = m if location == "all" else m.filter(F.col("city") == location)
    return m if pollutant == "all" else m.filter(F.col("pollutant") == pollutant)


def defaulted(raw: DataFrame) -> DataFrame:
    """Timestamp, location, pollutant, value and unit of loose rows; the first column that has something counts. A reading of 0 is something."""
    has = lambda *cols: F.coalesce(*[F.col(c) for c in cols if c in raw.columns])
    value = F.coalesce(*[F.col(c) for c in ("value", "concentration", "aqi") if c in raw.columns], F.lit(0.0))
    word = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols if c in raw.columns])
    return raw.withColumns({"timestamp": has("timestamp", "time", "created_at"), "location": F.coalesce(word("location", "city"), F.lit("Unknown location")), "pollutant": F.coalesce(word("pollutant"), F.lit("O3")), "value": value, "unit": F.coalesce(word("unit"), F.lit("AQI")) if "unit" in raw.columns else F.lit("AQI")})


def state_codes(df: DataFrame, name: str = "state_name") -> DataFrame:
    """``df`` with the code of its state's name; null if it is none."""
    pairs = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    return df.withColumn("state_code", F.try_element_at(pairs, F.col(name)))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts as they are shown."""
    text = F.format_string("High concentration of %s (%.1f ug/m3).", F.col("pollutant"), F.coalesce("concentration", F.lit(0.0)))
    return alerts.select("event_id", "city", "state", "pollutant", "aqi", severity("aqi").alias("alert_level"), text.alias("message"), "time")


def topk_bars(top: DataFrame) -> DataFrame:
    return top.withColumn("percentage", F.least(F.col("aqi") / 300 * 100, F.lit(100.0)))


def bands(m: DataFrame) -> DataFrame:
    """Rows and mean index by band and severity."""
    return m.groupBy(aqi_band("aqi").alias("band"), severity("aqi").alias("severity")).agg(F.count("*").alias("count"), java_round(F.avg("aqi")).alias("avg_aqi"))


def search_cities(loc: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Cities whose name and state hold the term, whatever its case: the first ten by name."""
    return loc.filter(F.lower(F.concat_ws(" ", "city", "state")).contains(term.lower())).orderBy("city", "state").limit(limit)
