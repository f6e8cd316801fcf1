"""Folds in chunks against plain ones, and streams whose rows come late, over several batches."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aqengine.operators import stateful, topk
from aqengine.sources.paced import paced, slices_of
from aqengine.streaming import heads, state

T0 = datetime(2024, 1, 1)
READING = "city string, state string, pollutant string, category string, time timestamp, event_id long, aqi int"
KEYS = ("city", "state", "pollutant")


def readings(seed, n=600, cities=4, hours=200):
    """A third and more of all readings are one station's; times tie; some indexes and times are null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        city = "hot" if r.random() < 0.4 else f"c{r.randrange(cities)}"
        at = T0 + timedelta(minutes=15 * r.randrange(hours * 4))
        out.append((city, "CA", "O3", "bad", at, i, None if r.random() < 0.05 else r.choice((50, r.randrange(1, 500)))))
    return out


def plain(rows):
    """The fold, reading by reading."""
    out, states = {}, {}
    for row in sorted(rows, key=lambda x: (x[4], x[5])):
        now, z = states.get(row[0], (0, 0.0, 0.0, 0.0, 0.0)), None
        if row[6] is not None:
            *now, z = stateful.reading(tuple(now), float(row[6]))
        states[row[0]] = tuple(now)
        out[row[5]] = (*now, z)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all((a is None and b is None) or abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[k], w, strict=True)), (k, got[k], w)


def by_event(df):
    return {r["event_id"]: tuple(r[c] for c in (*stateful.STATE, "z")) for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_folds_in_chunks_equal_a_plain_fold(spark, chunk):
    rows = readings(chunk)
    close(by_event(stateful.ema_zscore(spark.createDataFrame(rows, READING), chunk=chunk)), plain(rows))


def test_a_fold_goes_on_from_states(spark):
    rows = sorted(readings(3), key=lambda x: (x[4], x[5]))
    first, rest = (spark.createDataFrame(part, READING) for part in (rows[:300], rows[300:]))
    begun = stateful.ema_zscore(first, chunk=16)
    close(by_event(begun.select("event_id", *stateful.STATE, "z").unionByName(stateful.ema_zscore(rest, start=stateful.last_states(begun), chunk=16).select("event_id", *stateful.STATE, "z"))), plain(rows))


def test_no_chunk_is_longer_than_told_and_a_hot_station_lies_in_many_tasks(spark):
    m = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("city"), F.lit("CA").alias("state"), F.lit("O3").alias("pollutant"), F.timestamp_seconds(F.col("id") * 60).alias("time"), F.col("id").alias("event_id"), (F.col("id") % 91).alias("aqi"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would all go to one task
    try:
        dealt = stateful._dealt(m, KEYS).filter("city = 'hot'").groupBy("_shard").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 1334
    rows = [(r["city"], 0, 0, 0, r["time"], r["event_id"], r["aqi"]) for r in m.collect()]
    close(by_event(stateful.ema_zscore(m, chunk=100)), plain(rows))


def test_empty_and_constant_series(spark):
    assert stateful.ema_zscore(spark.createDataFrame([], READING)).collect() == []
    rows = [("a", "CA", "O3", "bad", T0 + timedelta(hours=i), i, 40) for i in range(50)]
    got = by_event(stateful.ema_zscore(spark.createDataFrame(rows, READING), chunk=4))
    assert all(v[1:] == (40.0, 0.0, 40.0, 40.0, 0.0) for v in got.values())


def sent(rows, ttl):
    out, last = set(), {}
    for row in sorted(rows, key=lambda x: (x[4], x[5])):
        if row[0] not in last or row[4] - last[row[0]] >= timedelta(seconds=ttl):
            last[row[0]] = row[4]
            out.add(row[5])
    return out


@pytest.mark.parametrize(("chunk", "ttl"), [(1, 3600), (5, 3600), (9, 6 * 3600), (4096, 900), (3, 0)])
def test_alerts_in_chunks_equal_a_plain_walk(spark, chunk, ttl):
    rows = readings(chunk + ttl)
    got = stateful.dedup_alerts(spark.createDataFrame([*rows, ("hot", "CA", "O3", "bad", None, 9999, 1)], READING), ttl, chunk=chunk)
    ids = [r["event_id"] for r in got.collect()]
    assert set(ids) == sent(rows, ttl) and len(ids) == len(set(ids))


def test_exits_of_a_chunk():
    r = random.Random(1)
    at = sorted(r.randrange(500) for _ in range(200))
    upto, exits = stateful._exits(at, 30)
    assert len(upto) <= len(at) and upto == sorted(upto)
    for last in range(-60, 520, 7):
        want = last
        for t in at:
            if t - want >= 30:
                want = t
        i = next((i for i, u in enumerate(upto) if u >= last + 30), None)
        assert want == (last if i is None else exits[i])


def run(df, path):
    df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def test_late_readings_over_batches_fold_as_the_table_does(spark, tmp_path):
    rows = [r for r in readings(8, 300) if r[6] is not None]
    m = spark.createDataFrame([*rows, ("end", "CA", "O3", "bad", T0 + timedelta(days=30), 9999, 1)], READING)
    arrival = slices_of(m.filter("event_id <> 9999"), 4, F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    stream = paced(m, F.when(F.col("event_id") == 9999, 3).otherwise(arrival), 4, f"{tmp_path}/in")
    folded = run(state.ema_zscore_stream(stream.drop("category"), "30 days"), f"{tmp_path}/ema").filter("event_id <> 9999")
    whole = plain(rows)
    got = by_event(folded)
    assert len(got) < len(whole)  # the last month waits for the watermark
    close(got, {k: v for k, v in whole.items() if k in got})


def test_the_order_of_slices(spark, tmp_path):
    m = spark.createDataFrame(readings(2, 100), READING)
    stream = paced(m, slices_of(m, 3), 3, f"{tmp_path}/in")
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append([r[0] for r in b.select("slice").distinct().collect()])).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[0], [1], [2]]


def test_top_lists_in_state(spark, tmp_path):
    """After each batch as the table says; the list with ten entries as a plain loop keeps it."""
    r = random.Random(5)
    rows = [(f"c{r.randrange(40)}", "CA", "O3", "bad", T0 + timedelta(minutes=i), i, r.randrange(1, 300)) for i in range(240)]
    m = spark.createDataFrame(rows, READING)
    stream = paced(m, slices_of(m, 3), 3, f"{tmp_path}/in")
    got = {(x["slice"], x["rank"]): (x["station"], x["aqi"]) for x in run(heads.topk_stream(stream, 5, 3), f"{tmp_path}/top").collect()}
    told = run(heads.retained_topk_stream(stream, 5), f"{tmp_path}/kept").collect()
    lists = {(x["slice"], x["rank"]): (x["station"], x["aqi"]) for x in told}
    kept = {}
    for i in range(3):
        upto = [row for row in rows if row[5] * 3 // 239 <= i or i == 2]
        last = {f"{row[0]} - CA": float(row[6]) for row in upto}
        assert [got[i, k] for k in range(1, 6)] == sorted(last.items(), key=lambda h: (-h[1], h[0]))[:5]
        kept = {}
        for row in upto:
            topk.retain(kept, f"{row[0]} - CA", float(row[6]), 5)
        assert [lists[i, k] for k in range(1, 6)] == sorted(kept.items(), key=lambda h: (-h[1], h[0]))


def test_heads_fall_and_come_back():
    start = {n: (n, "O3", v) for n, v in (("a", 9.0), ("b", 8.0))}
    assert heads.changed(start, {"c": ("c", "O3", 7.0)}, 2) == (start, False)
    assert heads.changed(start, {"c": ("c", "O3", 8.5)}, 2)[0].keys() == {"a", "c"}
    assert heads.changed(start, {"a": ("a", "O3", 1.0)}, 2)[1] and not heads.changed(start, {"a": ("a", "O3", 8.2)}, 2)[1]


def test_keys_are_forgotten_by_the_clock(spark, tmp_path):
    """An alert within the time to live is held back; then the key goes though nothing comes, and the next alert is sent."""
    alert = lambda i: spark.createDataFrame([("a", "CA", "O3", "bad", T0, i, 200)], READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    alert(1)
    out = state.dedup_alerts_by_clock(spark.readStream.schema(READING).parquet(f"{tmp_path}/in"), 20)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()

    def wait(what, seconds=90):
        end = time.time() + seconds
        while not what() and time.time() < end:
            time.sleep(0.3)
        assert what()

    kept = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    ids = lambda: sorted(r["event_id"] for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    try:
        wait(lambda: any(kept()))
        alert(2)
        wait(lambda: kept() and kept()[-1] == 0)
        assert ids() == [1]
        alert(3)
        wait(lambda: ids() == [1, 3])
    finally:
        q.stop()
