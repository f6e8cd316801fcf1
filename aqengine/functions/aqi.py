"""Index values: concentrations, bands, severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each band the lowest and highest index, and for each pollutant the lowest and highest concentration.
BANDS = ((0, 50), (51, 100), (101, 150), (151, 200), (201, 300), (301, 500))
CONCENTRATIONS = {
    "O3": ((0, 0.054), (0.055, 0.070), (0.071, 0.085), (0.086, 0.105), (0.106, 0.404), (0.405, 0.604)),
    "PM2.5": ((0, 9.0), (9.1, 35.4), (35.5, 55.4), (55.5, 125.4), (125.5, 225.4), (225.5, 325.4)),
    "PM10": ((0, 54), (55, 154), (155, 254), (255, 354), (355, 424), (425, 604)),
}
LABELS = ("Good", "Moderate", "Unhealthy for sensitive groups", "Unhealthy", "Very Unhealthy", "Hazardous")


def _chain(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    out = reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))
    return out if default is None else out.otherwise(default)


def aqi_to_concentration(aqi: Column | str, pollutant: Column | str) -> Column:
    """Concentration on the straight line through the ends of the index's band; the index is held to 0..500. Null for an unknown pollutant."""
    aqi, pollutant = (F.col(c) if isinstance(c, str) else c for c in (aqi, pollutant))
    x = F.least(F.greatest(aqi, F.lit(0)), F.lit(500))
    cases = []
    for name, ends in CONCENTRATIONS.items():
        for (lo, hi), (c0, c1) in zip(BANDS, ends, strict=True):
            cases.append(((pollutant == name) & x.between(lo, hi), F.lit((float(c1) - float(c0)) / (hi - lo)) * (x - lo) + F.lit(float(c0))))
    return F.when(aqi.isNotNull(), _chain(cases))


def aqi_band(aqi: Column | str) -> Column:
    """The band's name; values above 500 count as the last band, negative and null ones have none."""
    x = F.col(aqi) if isinstance(aqi, str) else aqi
    return F.when(x >= 0, _chain([(x <= hi, F.lit(name)) for (_, hi), name in zip(BANDS[:-1], LABELS, strict=False)], F.lit(LABELS[-1])))


def severity(aqi: Column | str) -> Column:
    """CRITICAL above 200, HIGH above 150, LOW up to 50, else MEDIUM; a missing value counts as 0."""
    x = F.coalesce(F.col(aqi) if isinstance(aqi, str) else aqi, F.lit(0))
    return F.when(x > 200, "CRITICAL").when(x > 150, "HIGH").when(x <= 50, "LOW").otherwise("MEDIUM")
