"""Folds over each station's readings in time, on tables; ``streaming.state`` has them on streams.

A fold is a parallel prefix: rows are dealt by ranges of (key, time), so that a busy station lies in many tasks, and cut into chunks of at most CHUNK rows
of one key. What a chunk does to the state before it is a few numbers: a scan over each key's chunks gives every chunk its state, and
rows then follow from that state and their own place in the chunk. ``ema_zscore`` takes states to start from, so that a long archive can also be folded part by part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..interim import written
from ..schemas import STATION_STATE

# Weights of the averages, warm-up, limits and steps.
ALPHA, DOUBLE_ALPHA, WARM_UP, Z_LIMIT, STEPS, ALERT_AT = 0.1, 0.2, 20, 3.0, 2, 100.0

#: Rows of a chunk at most.
CHUNK = 4096

STATE = ("count", "ema", "emvar", "ema1", "ema2")


def reading(state: tuple, x: float) -> tuple:
    """The state after a reading, and the reading's z-score."""
    n, ema, var, e1, e2 = state
    if n == 0:
        return 1, x, 0.0, x, x, 0.0
    d = x - ema
    e1 = DOUBLE_ALPHA * x + (1 - DOUBLE_ALPHA) * e1
    return n + 1, ema + ALPHA * d, (1 - ALPHA) * (var + ALPHA * d * d), e1, DOUBLE_ALPHA * e1 + (1 - DOUBLE_ALPHA) * e2, abs(d) / var**0.5 if var > 0 else 0.0


def _dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows in the order of key, time and event_id over all tasks; a long key lies in several."""
    order = (*keys, "time", "event_id")
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_shard", F.spark_partition_id())


def _chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int) -> Iterator[pa.Table]:
    """Runs of at most ``most`` sorted rows of one key."""
    held: list[pa.RecordBatch] = []
    last, n = None, 0
    for b in batches:
        own = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        lo = 0
        for i in range(len(own) + 1):
            full = i > lo and n + i - lo == most
            if i == len(own) or full or (own[i] != last and (n or i > lo)):
                if i > lo:
                    held.append(b.slice(lo, i - lo))
                    n += i - lo
                    lo = i
                if held and (full or i < len(own)):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            if i < len(own):
                last = own[i]
    if held:
        yield pa.Table.from_batches(held)


def _together(tables: Iterator[pa.Table], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small tables in larger batches."""
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += t.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _scanned(chunks: DataFrame, keys: tuple[str, ...], after: Callable[[tuple | None, dict], tuple | None], state: str) -> DataFrame:
    """_shard, _seq, _state: the state before each chunk that has one. ``chunks`` has a row for each chunk; ``after`` gives the state after it. A key's chunks are one task's work: a few
    numbers for CHUNK rows."""
    rows = chunks.repartition(*keys).sortWithinPartitions(*keys, "_shard", "_seq")
    begins = "_start" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (own := tuple(row[k] for k in keys)) != key:
                    key, now = own, (tuple(row["_start"].values()) if begins and row["_start"] else None)
                if now is not None:
                    out.append({"_shard": row["_shard"], "_seq": row["_seq"], "_state": dict(zip(names, now, strict=True))})
                now = after(now, row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_shard", pa.int32()), ("_seq", pa.int64()), ("_state", pa.struct([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.float64()) for c in state.split(", ")]))]))

    names = [c.split()[0] for c in state.split(", ")]
    return rows.mapInArrow(run, f"_shard int, _seq long, _state struct<{', '.join(c.replace(' ', ': ') for c in state.split(', '))}>")


def _results(df: DataFrame) -> DataFrame:
    """Trend, forecast and flags from the averages after each reading."""
    trend = DOUBLE_ALPHA / (1 - DOUBLE_ALPHA) * (F.col("ema1") - F.col("ema2"))
    warm = F.col("count") > WARM_UP
    df = df.withColumn("trend", F.when(warm, trend).otherwise(0.0))
    df = df.withColumn("predicted", F.when(warm, 2 * F.col("ema1") - F.col("ema2") + STEPS * F.col("trend")).otherwise(0.0))
    return df.withColumn("is_anomaly", warm & (F.col("z") > Z_LIMIT)).withColumn("is_forecast_alert", warm & (F.col("aqi") < ALERT_AT) & (F.col("predicted") >= ALERT_AT))


#: Of each row, in its chunk: readings so far, the first one (all else is measured from it), the mean, variance, sum of deviations and two averages as if the state before had been that first reading;
#: deviation and variance before the row.
_LOCAL = ("_n", "_c", "_r", "_v", "_g", "_s1", "_s2", "_d", "_vp")


def _local(values: list[float | None]) -> list[tuple]:
    c = next((x for x in values if x is not None), 0.0)
    n, r, v, g, s1, s2 = 0, 0.0, 0.0, 0.0, 0.0, 0.0
    out = []
    for x in values:
        if x is None:  # no reading: the state stands
            out.append((n, c, r, v, g, s1, s2, None, None))
            continue
        y, vp = x - c, v
        d = y - r
        n, r, v, g = n + 1, r + ALPHA * d, (1 - ALPHA) * (v + ALPHA * d * d), g + d
        s1 = DOUBLE_ALPHA * y + (1 - DOUBLE_ALPHA) * s1
        s2 = DOUBLE_ALPHA * s1 + (1 - DOUBLE_ALPHA) * s2
        out.append((n, c, r, v, g, s1, s2, d, vp))
    return out


def _variance(am, v0, u, g, v):
    """Variance after m readings: linear in the one before, quadratic in how far the mean before lies from the chunk's first reading."""
    return am * v0 + am * (1 - am) * u * u - 2 * ALPHA * am * g * u + v


def _after(state: tuple | None, row: dict) -> tuple | None:
    """The state after a chunk, from the state before it and the chunk's last row."""
    if state is None and not row["_n"]:
        return None
    n, c = row["_n"], row["_c"]
    count, ema, var, e1, e2 = state or (0, c, 0.0, c, c)
    am, bm = (1 - ALPHA) ** n, (1 - DOUBLE_ALPHA) ** n
    u, u1, u2 = ema - c, e1 - c, e2 - c
    return count + n, c + am * u + row["_r"], max(0.0, _variance(am, var, u, row["_g"], row["_v"])), c + bm * u1 + row["_s1"], c + bm * u2 + DOUBLE_ALPHA * n * bm * u1 + row["_s2"]


def _states() -> dict[str, Column]:
    """State and z-score of each row, from its own numbers and its chunk's state before (null: none)."""
    n, c, s = F.col("_n"), F.col("_c"), lambda f: F.col(f"_state.{f}")
    from_c = lambda f: F.coalesce(s(f) - c, F.lit(0.0))
    u, u1, u2, v0 = from_c("ema"), from_c("ema1"), from_c("ema2"), F.coalesce(s("emvar"), F.lit(0.0))
    am, bm, before = F.pow(F.lit(1 - ALPHA), n), F.pow(F.lit(1 - DOUBLE_ALPHA), n), F.pow(F.lit(1 - ALPHA), n - 1)
    count = F.coalesce(s("count"), F.lit(0)) + n
    some = lambda x: F.when(count > 0, x).otherwise(0.0)
    d, vp = F.col("_d") - before * u, _variance(before, v0, u, F.col("_g") - F.col("_d"), F.col("_vp"))
    return {
        "count": count, "ema": some(c + am * u + F.col("_r")), "emvar": some(F.greatest(F.lit(0.0), _variance(am, v0, u, F.col("_g"), F.col("_v")))), "ema1": some(c + bm * u1 + F.col("_s1")),
        "ema2": some(c + bm * u2 + DOUBLE_ALPHA * n * bm * u1 + F.col("_s2")), "z": F.when(F.col("_d").isNotNull(), F.when(vp > 0, F.abs(d) / F.sqrt(vp)).otherwise(0.0)),
    }


def ema_zscore(m: DataFrame, keys: tuple[str, ...] = ("city", "state", "pollutant"), start: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Each reading with its key's exponential mean and variance after it, its z-score before it, double-average trend and forecast.

    Readings of a key are folded in the order of (time, event_id); null ones leave the state as it is. ``start`` gives keys a state to go on from (the last row of an
    earlier result). Over a chunk the means are affine in the state before it and the variance a polynomial of degree two, so chunks are folded apart, their
    transforms composed by key, and rows finished by column expressions.
    """
    names = [*keys, "time", "event_id", "aqi"]
    rows = m.select(*keys, "time", "event_id", F.col("aqi").cast("double").alias("aqi"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded() -> Iterator[pa.Table]:
            for seq, t in enumerate(_chunks(batches, keys, chunk)):
                cols = list(zip(*_local(t["aqi"].to_pylist()), strict=True))
                n = t.num_rows
                t = t.append_column("_seq", pa.array([seq] * n, pa.int64())).append_column("_end", pa.array([False] * (n - 1) + [True]))
                for name, kind, c in zip(_LOCAL, (pa.int64(), *[pa.float64()] * 8), cols, strict=True):
                    t = t.append_column(name, pa.array(c, kind))
                yield t

        yield from _together(folded())

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", _shard int, _seq long, _end boolean, _n long, " + ", ".join(f"{c} double" for c in _LOCAL[1:])
    folded = written(_dealt(rows, keys).mapInArrow(run, schema), "folded")
    last = folded.filter("_end").select(*keys, "_shard", "_seq", *_LOCAL[:7])
    if start is not None:
        last = last.join(start.select(*keys, F.struct(*[F.col(c) for c in STATE]).alias("_start")), list(keys), "left")
    states = _scanned(last, keys, _after, STATION_STATE)
    return _results(folded.join(states, ["_shard", "_seq"], "left").select(*names, *[c.alias(n) for n, c in _states().items()]))


def last_states(scored: DataFrame, keys: tuple[str, ...] = ("city", "state", "pollutant")) -> DataFrame:
    """Each key's state after its last reading: what ``ema_zscore`` starts from next time."""
    return scored.groupBy(*keys).agg(F.max_by(F.struct("count", "ema", "emvar", "ema1", "ema2"), F.struct("time", "event_id")).alias("s")).select(*keys, "s.*")


def anomaly_alerts(scored: DataFrame) -> DataFrame:
    """Readings far above or below the mean; the expected index is the mean after the reading."""
    return scored.filter("is_anomaly").select("time", "city", "state", "pollutant", "aqi", F.col("ema").alias("expected_aqi"), F.col("z").alias("z_score"))


def forecast_alerts(scored: DataFrame) -> DataFrame:
    """Readings below the alert level whose forecast reaches it."""
    return scored.filter("is_forecast_alert").select("time", "city", "state", "pollutant", F.col("aqi").alias("current_aqi"), F.col("predicted").alias("predicted_aqi"), "trend", F.lit(STEPS).alias("forecast_steps"))


def _exits(at: list[int], ttl: int) -> tuple[list[int], list[int]]:
    """What a chunk of alerts does to the time of the last one sent: with the first alert that may be sent at or before ``upto[i]`` (and after the one before), ``exits[i]`` is sent last.

    Each alert points to the first one ``ttl`` later; the ends of these chains follow from the back, with one look for each alert. Alerts next to each other that lead to the
    same end share an entry.
    """
    n = len(at)
    end = [0] * n
    for i in range(n - 1, -1, -1):
        j = bisect_left(at, at[i] + ttl, i + 1)
        end[i] = end[j] if j < n else i
    upto, exits = [], []
    for i in range(n):
        if i + 1 == n or end[i + 1] != end[i]:
            upto.append(at[i])
            exits.append(at[end[i]])
    return upto, exits


def dedup_alerts(alerts: DataFrame, ttl_seconds: int = 3600, keys: tuple[str, ...] = ("city", "state", "pollutant", "category"), chunk: int = CHUNK) -> DataFrame:
    """Alerts that are sent: the first of a key, then each that comes ``ttl_seconds`` or more after the last one sent. Those without a time are not."""
    names, ttl = [*keys, "time", "event_id", "aqi"], ttl_seconds * 1_000_000
    rows = alerts.select(*names, F.unix_micros(F.col("time").cast("timestamp")).alias("_at")).filter("_at is not null")
    kinds = dict(rows.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for seq, t in enumerate(_chunks(batches, keys, chunk)):
                n = t.num_rows
                upto, exits = _exits(t["_at"].to_pylist(), ttl)
                last = lambda v: pa.array([None] * (n - 1) + [v], pa.list_(pa.int64()))
                yield t.append_column("_seq", pa.array([seq] * n, pa.int64())).append_column("_upto", last(upto)).append_column("_exits", last(exits))

        yield from _together(tables())

    def after(state: tuple | None, row: dict) -> tuple:
        i = bisect_left(row["_upto"], state[0] + ttl) if state else 0
        return (row["_exits"][i],) if i < len(row["_exits"]) else state

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_, last = None, None
        for b in batches:
            keep = []
            for i, (shard, seq, at, before) in enumerate(zip(b["_shard"].to_pylist(), b["_seq"].to_pylist(), b["_at"].to_pylist(), b["_last"].to_pylist(), strict=True)):
                if (shard, seq) != chunk_:
                    chunk_, last = (shard, seq), before
                if last is None or at - last >= ttl:
                    last = at
                    keep.append(i)
            yield b.select(names).take(pa.array(keep, pa.int64()))

    listed = ", ".join(f"{n} {kinds[n]}" for n in names)
    marked = written(_dealt(rows, keys).mapInArrow(cut, f"{listed}, _at long, _shard int, _seq long, _upto array<long>, _exits array<long>"), "alerts")
    before = _scanned(marked.filter("_upto is not null").select(*keys, "_shard", "_seq", "_upto", "_exits"), keys, after, "at long")
    every = marked.drop("_upto", "_exits").join(before.select("_shard", "_seq", F.col("_state.at").alias("_last")), ["_shard", "_seq"], "left")
    return every.repartition("_shard", "_seq").sortWithinPartitions("_shard", "_seq", "time", "event_id").mapInArrow(sent, listed)
