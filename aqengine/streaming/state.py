"""Stateful operators on streams: averages with alerts, and deduplicated alerts.

They need the RocksDB state store: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stateful import ALERT_AT, DOUBLE_ALPHA, STEPS, WARM_UP, Z_LIMIT, reading
from ..schemas import STATION_STATE

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCORED = "city string, state string, pollutant string, time timestamp, event_id long, aqi double, count long, ema double, emvar double, ema1 double, ema2 double, z double, trend double, predicted double, is_anomaly boolean, is_forecast_alert boolean"
SENT = "city string, state string, pollutant string, category string, time timestamp, event_id long, aqi int"
EMPTY = (0, 0.0, 0.0, 0.0, 0.0)

Row = tuple[int, int, float]  # time in microseconds, event_id, index


def results(state: tuple, x: float) -> tuple[tuple, tuple]:
    """State and results after a reading."""
    *now, z = reading(state, x)
    n, _, _, e1, e2 = now
    warm = n > WARM_UP
    trend = DOUBLE_ALPHA / (1 - DOUBLE_ALPHA) * (e1 - e2) if warm else 0.0
    pred = 2 * e1 - e2 + STEPS * trend if warm else 0.0
    return tuple(now), (z, trend, pred, warm and z > Z_LIMIT, warm and x < ALERT_AT <= pred)


def _rows(part: pd.DataFrame) -> list[Row]:
    part = part[part["aqi"].notna() & part["time"].notna()]
    return list(zip(part["time"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), part["event_id"].tolist(), part["aqi"].astype(float).tolist(), strict=True))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.assign(time=pd.to_datetime(out["time"], unit="us"))


class Fold(StatefulProcessor):
    """What becomes of a key's readings, taken in order. Each batch's are sorted and taken at once, so one that comes in a later batch is taken after those before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[Row]) -> pd.DataFrame:
        raise NotImplementedError

    def forget_at(self) -> int | None:
        """When the watermark (in milliseconds) may drop the key's state."""
        return None

    def forget(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.take(key, sorted(r for part in rows for r in _rows(part)))

    def close(self) -> None:
        pass


class InOrder(Fold):
    """Readings wait in state, and are taken in the order of time once the watermark has passed them: then none before them can come any more. A key's waiting list
    holds what lies within the grace, and one batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long, event_id long, aqi double")

    def _wake(self, at: int | None) -> None:
        timers = list(self.handle.listTimers())
        if at is None or (timers and min(timers) <= at):
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            if new := _rows(part):
                self.waiting.appendList(new)
                least = min(new[0][0] if least is None else least, min(r[0] for r in new))
        if least is not None:
            self._wake(-(-least // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted(r for r in held if r[0] <= upto), [r for r in held if r[0] > upto]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield self.take(key, due)
        at = self.forget_at()
        if rest:
            self._wake(-(-min(r[0] for r in rest) // 1000))
        elif at is not None and at * 1000 > upto:
            self._wake(at)
        elif at is not None:
            self.forget()


class Ema(Fold):
    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATION_STATE)

    def take(self, key: tuple, rows: list[Row]) -> pd.DataFrame:
        now, out = tuple(self.state.get()) if self.state.exists() else EMPTY, []
        for at, event, x in rows:
            now, got = results(now, x)
            out.append((*key, at, event, x, *now, *got))
        self.state.update(now)
        return _frame(out, SCORED)


class Dedup(Fold):
    """Sends an alert unless its key's last one was sent less than the time to live before. With ``forgetful`` a timer drops a key's state when
    the watermark has passed its time to live, after which it can hold nothing back."""

    ttl_seconds, forgetful = 3600, False

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def take(self, key: tuple, rows: list[Row]) -> pd.DataFrame:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for at, event, x in rows:
            if last is None or at - last >= self.ttl_seconds * 1_000_000:
                last = at
                out.append((*key, at, event, int(x)))
        if last is not None:
            self.last.update((last,))
        return _frame(out, SENT)

    def forget_at(self) -> int | None:
        return self.last.get()[0] // 1000 + self.ttl_seconds * 1000 if self.last.exists() else None

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timerValues)
        if self.forgetful and (at := self.forget_at()) is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())


class EmaInOrder(InOrder, Ema):
    pass


class DedupInOrder(InOrder, Dedup):
    pass


class WallClockDedup(Dedup):
    """Sends an alert unless its key sent one less than the time to live ago by the clock. A timer drops the key then, whether or not anything more comes for it."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min((r for part in rows for r in _rows(part)), default=None)
        if first is None or self.last.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((now,))
        self.handle.registerTimer(now + self.ttl_seconds * 1000)
        yield _frame([(*key, first[0], first[1], int(first[2]))], SENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def _with_ttl(made: Dedup, ttl_seconds: int, forgetful: bool = False) -> Dedup:
    made.ttl_seconds, made.forgetful = ttl_seconds, forgetful
    return made


def ema_zscore_stream(m: DataFrame, grace: str | None = None) -> DataFrame:
    """As ``stateful.ema_zscore``, on a stream of city, state, pollutant, time, event_id, aqi.

    With a ``grace`` readings are folded in the order of time, whatever batches they come in; those later than that are dropped, and a reading comes out when the watermark has
    passed it. Without one they are folded as they come. Readings without a time or an index are left out.
    """
    keyed = (m.withWatermark("time", grace) if grace else m).groupBy("city", "state", "pollutant")
    return keyed.transformWithStateInPandas(EmaInOrder() if grace else Ema(), outputStructType=SCORED, outputMode="Append", timeMode="EventTime" if grace else "None")


def dedup_alerts_stream(alerts: DataFrame, ttl_seconds: int = 3600, grace: str | None = None, in_order: bool = False) -> DataFrame:
    """As ``stateful.dedup_alerts``, on a stream; times of events count.

    With a ``grace`` alerts later than that are dropped, and keys are forgotten once their time to live is over, so state holds only
    keys of the last hours; without one it holds every key there ever was. ``in_order`` (which needs a grace) takes alerts in the order of time, whatever batches they come in,
    and sends one when the watermark has passed it; else they are taken and sent as they come.
    """
    keyed = (alerts.withWatermark("time", grace) if grace else alerts).groupBy("city", "state", "pollutant", "category")
    made = _with_ttl(DedupInOrder() if grace and in_order else Dedup(), ttl_seconds, bool(grace) and not in_order)
    return keyed.transformWithStateInPandas(made, outputStructType=SENT, outputMode="Append", timeMode="EventTime" if grace else "None")


def dedup_alerts_by_clock(alerts: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Alerts of keys that sent none in the last ``ttl_seconds`` of the clock; of a batch's the first. Keys are forgotten by the clock too."""
    keyed = alerts.groupBy("city", "state", "pollutant", "category")
    return keyed.transformWithStateInPandas(_with_ttl(WallClockDedup(), ttl_seconds), outputStructType=SENT, outputMode="Append", timeMode="ProcessingTime")
