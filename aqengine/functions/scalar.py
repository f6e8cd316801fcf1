"""Small column expressions used throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_round(x: Column, digits: int = 2) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x * 10**digits + F.lit(0.5)) / F.lit(10**digits)


def cyclic(x: Column, period: float, weight: float = 1.0) -> tuple[Column, Column]:
    """Sine and cosine of a value on a cycle."""
    turn = x * F.lit(2 * math.pi / period)
    return F.sin(turn) * weight, F.cos(turn) * weight


def station(city: str = "city", state: str = "state", sep: str = " - ") -> Column:
    return F.concat_ws(sep, city, state)


def unstation(key: Column, sep: str = r" - ") -> tuple[Column, Column]:
    """City and state of a composite key."""
    parts = F.split(key, sep, 2)
    return parts[0], F.get(parts, F.lit(1))


def state_code(state: Column, location: Column) -> Column:
    """A two-letter state, else the two letters behind the location's last comma, in capitals; else null."""
    tail = F.trim(F.element_at(F.split(location, ","), -1))
    return F.when(F.length(state) == 2, F.upper(state)).when(F.length(tail) == 2, F.upper(tail))


def norm_parameter(x: Column) -> Column:
    """PM2.5 as PM2_5: usable as a column's name."""
    return F.regexp_replace(F.upper(x), r"\.", "_")
