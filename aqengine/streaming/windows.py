"""Windowed aggregates of a stream, each window emitted once when it closes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import windows

#: How long a window waits for late rows.
GRACE = "1 minute"


def closing(m: DataFrame, time: str = "time", grace: str = GRACE) -> DataFrame:
    """Rows later than the grace are dropped; a window closes when the newest time is its end and the grace."""
    return m.withWatermark(time, grace)


def averages(m: DataFrame, name: str, time: str = "time", grace: str = GRACE) -> DataFrame:
    keys, size, hop = windows.AVERAGES[name]
    return windows.hopping_average(closing(m, time, grace), keys, size, hop, time)


def maxima(m: DataFrame, by_city: bool = True, time: str = "time", grace: str = GRACE) -> DataFrame:
    return windows.tumbling_maximum(closing(m, time, grace), windows.CITY if by_city else windows.STATE, time=time)
