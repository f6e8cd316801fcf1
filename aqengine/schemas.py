"""Schemas of the records that streams, archives and serving tables hold."""

from __future__ import annotations

ENVELOPE = "payload struct<content: string>"
MEASUREMENT = "time timestamp, city string, state string, pollutant string, aqi int, concentration double, category string"
STATION_STATE = "count long, ema double, emvar double, ema1 double, ema2 double"
STATE_LOCATION = "state string, state_name string, multipolygon string"
SERIES = "SiteID string, timestamp timestamp, PM25 double"

# Fixed values.
POLLUTANTS = ("O3", "PM2.5", "PM10")
PARAMETERS = ("OZONE", "PM2.5", "PM10")
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH",
    "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)
