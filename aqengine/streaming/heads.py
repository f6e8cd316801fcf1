"""The k highest stations of a stream, kept in state: shards of stations keep their own k highest, and one more step merges these."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import station
from ..operators.topk import retain

HEADS = "shard int, slice int, station string, pollutant string, aqi double"
LISTS = "slice int, rank int, station string, pollutant string, aqi double"

Head = tuple[str, str, float]


def order(head: Head) -> tuple[float, str, str]:
    return -head[2], head[0], head[1]


def changed(heads: dict[str, Head], new: dict[str, Head], k: int) -> tuple[dict[str, Head], bool]:
    """The k highest after some stations' values changed, and whether that can't be told from them alone: one fell below what stations outside may have."""
    heads, full = dict(heads), len(heads) >= k
    worst = max(map(order, heads.values())) if full else None
    for name, head in new.items():
        if name in heads or not full or order(head) < worst:
            heads[name] = head
    fell = full and any(name in heads and order(head) > worst for name, head in new.items())
    kept = heapq.nsmallest(k, heads.values(), key=order)
    return {h[0]: h for h in kept}, fell


class ShardHeads(StatefulProcessor):
    """Each station's last reading, and the k highest of them. Only if one of these falls are all stations of the shard looked through; a station that fell out comes back
    when others fall."""

    k = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.all = handle.getMapState("stations", "station string", "pollutant string, aqi double, at long, event_id long")
        self.heads = handle.getListState("heads", "station string, pollutant string, aqi double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        slice_ = 0
        for part in rows:
            at = part["time"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for name, pollutant, aqi, t, e in zip(part["station"], part["pollutant"], part["aqi"].tolist(), at, part["event_id"].tolist(), strict=True):
                if name not in last or (t, e) > last[name][2:]:
                    last[name] = (pollutant, aqi, t, e)
            slice_ = max(slice_, int(part["slice"].max()))
        new = {}
        for name, value in last.items():
            old = tuple(self.all.getValue((name,))) if self.all.containsKey((name,)) else None
            if old is None or value[2:] > old[2:]:
                self.all.updateValue((name,), value)
                new[name] = (name, value[0], value[1])
        heads = {h[0]: tuple(h) for h in self.heads.get()} if self.heads.exists() else {}
        heads, fell = changed(heads, new, self.k)
        if fell:
            every = ((key_[0], v[0], v[1]) for key_, v in self.all.iterator())
            heads = {h[0]: h for h in heapq.nsmallest(self.k, every, key=order)}
        self.heads.put(list(heads.values()))
        yield pd.DataFrame([(key[0], slice_, *h) for h in heads.values()], columns=[c.split()[0] for c in HEADS.split(", ")])

    def close(self) -> None:
        pass


class MergedHeads(StatefulProcessor):
    """The k highest of all shards' k highest; after each batch the whole list."""

    k = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getListState("heads", "shard int, station string, pollutant string, aqi double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(s), n, p, a, int(i)) for part in rows for s, i, n, p, a in part[["shard", "slice", "station", "pollutant", "aqi"]].itertuples(index=False)]
        come = {r[0] for r in new}
        held = [r[:4] for r in new] + [tuple(r) for r in (self.heads.get() if self.heads.exists() else ()) if r[0] not in come]
        self.heads.put(held)
        top = heapq.nsmallest(self.k, (r[1:] for r in held), key=order)
        yield pd.DataFrame([(max(r[4] for r in new), i + 1, *h) for i, h in enumerate(top)], columns=[c.split()[0] for c in LISTS.split(", ")])

    def close(self) -> None:
        pass


class RetainedHeads(StatefulProcessor):
    """The list as it is when only k entries are remembered: what falls out is gone."""

    k = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getListState("heads", "station string, aqi double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {h[0]: h[1] for h in self.heads.get()} if self.heads.exists() else {}
        every = pd.concat([part[["time", "event_id", "station", "aqi", "slice"]] for part in rows]).sort_values(["time", "event_id"])
        for name, aqi in zip(every["station"], every["aqi"].tolist(), strict=True):
            retain(kept, name, aqi, self.k)
        self.heads.put(list(kept.items()))
        top = sorted(kept.items(), key=lambda h: (-h[1], h[0]))
        yield pd.DataFrame([(int(every["slice"].max()), i + 1, name, None, aqi) for i, (name, aqi) in enumerate(top)], columns=[c.split()[0] for c in LISTS.split(", ")])

    def close(self) -> None:
        pass


def _sized(made: StatefulProcessor, k: int) -> StatefulProcessor:
    made.k = k
    return made


def _readings(m: DataFrame) -> DataFrame:
    return m.select(station().alias("station"), "pollutant", F.col("aqi").cast("double").alias("aqi"), "time", "event_id", "slice").filter("aqi is not null and time is not null")


def topk_stream(m: DataFrame, k: int = 10, shards: int = 16) -> DataFrame:
    """slice, rank, station, pollutant, aqi: after each batch the k stations with the highest last reading. ``m`` is a stream of measurements with the ``slice`` that each came in.

    A shard's state is spread by a hash of the station; k rows of each reach the second step.
    """
    shard = F.pmod(F.xxhash64("station"), F.lit(shards)).cast("int")
    first = _readings(m).withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(_sized(ShardHeads(), k), outputStructType=HEADS, outputMode="Append", timeMode="None")
    return first.withColumn("one", F.lit(0)).groupBy("one").transformWithStateInPandas(_sized(MergedHeads(), k), outputStructType=LISTS, outputMode="Append", timeMode="None")


def retained_topk_stream(m: DataFrame, k: int = 10) -> DataFrame:
    """As ``topk_stream``, of a list that remembers k entries only. It depends on the order of all readings, so one task keeps it."""
    return _readings(m).withColumn("one", F.lit(0)).groupBy("one").transformWithStateInPandas(_sized(RetainedHeads(), k), outputStructType=LISTS, outputMode="Append", timeMode="None")
