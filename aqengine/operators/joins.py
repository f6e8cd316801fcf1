"""Location and distance joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, cell, columns_within, geo_distance_m, planar
from ..interim import written

#: Points of a quadtree's leaf at most, its depth at most, and the levels that are counted.
LEAF, DEPTH, STEP = 64, 20, 2


def with_location(df: DataFrame, loc: DataFrame) -> DataFrame:
    """Rows with their city's coordinates. Spark broadcasts the locations if they are small enough, and else shuffles both sides."""
    return df.join(loc.select("city", "state", "longitude", "latitude"), ["city", "state"])


def latest_geo(m: DataFrame, loc: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest measurement of each city and pollutant with coordinates, newest first."""
    last = latest_per_key(m, ["city", "state", "pollutant"], "time", "event_id")
    out = with_location(last, loc).orderBy(F.desc("time"), "city", "state", "pollutant")
    return out if limit is None else out.limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """Of each key the row with the greatest (time, ties): a maximum, so most rows are gone before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = [time, *ties]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_l")
    return df.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in df.columns])


def _near(lon: Column, lat: Column, at_lon: float, at_lat: float, radius_m: float) -> Column:
    """A cheap box around the circle, for the scan."""
    import math

    high = 1.01 * radius_m / DEGREE
    wide = high / max(0.01, math.cos(math.radians(min(89.0, abs(at_lat) + high))))
    return lat.between(at_lat - high, at_lat + high) & lon.between(at_lon - wide, at_lon + wide)


def alerts_near(alerts: DataFrame, loc: DataFrame, lon: float, lat: float, radius_m: float = 50_000, since=None) -> DataFrame:
    """Alerts since a time whose city lies within the radius of a point, with the distance."""
    here = loc.filter(_near(F.col("longitude"), F.col("latitude"), lon, lat, radius_m))
    d = geo_distance_m(F.lit(lon), F.lit(lat), F.col("longitude"), F.col("latitude"))
    here = here.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)
    rows = alerts if since is None else alerts.filter(F.col("time") >= F.lit(since))
    return rows.join(here.select("city", "state", "longitude", "latitude", "distance_m"), ["city", "state"])


def subscribers_near(cities: DataFrame, subs: DataFrame, radius_m: float = 50_000, digits: int | None = None) -> DataFrame:
    """id, email, city, state, distance_m (rounded to ``digits``, if given): active subscribers within the radius of ``cities`` (city, state, longitude, latitude).

    A subscriber meets only cities of its own and neighbouring cells, and distances are computed once, for pairs within a box around the circle. Cities are a dimension, written once, so
    that Spark knows their size. Pairs are dealt anew by subscriber, as what joins them may be many times as large.
    """
    cities = written(cities.select("city", "state", F.col("longitude").alias("c_lon"), F.col("latitude").alias("c_lat")), "cities")
    row, column = cell(F.col("c_lon"), F.col("c_lat"), radius_m)
    cities = cities.withColumn("cell_row", row).withColumn("cell_col", column)
    row, column = cell(F.col("longitude"), F.col("latitude"), radius_m)
    span = columns_within(F.col("latitude"))
    around = subs.filter("active").withColumn("cell_row", F.explode(F.sequence(row - 1, row + 1))).withColumn("cell_col", F.explode(F.sequence(column - span, column + span)))
    pairs = around.join(cities, ["cell_row", "cell_col"]).filter(F.abs(F.col("latitude") - F.col("c_lat")) <= 1.01 * radius_m / DEGREE)
    d = geo_distance_m(F.col("longitude"), F.col("latitude"), F.col("c_lon"), F.col("c_lat"))
    # A generator behind the formula, so that the filter doesn't repeat it.
    pairs = pairs.select("id", "email", "city", "state", d.alias("_d")).select("id", "email", "city", "state", F.explode(F.array("_d")).alias("distance_m"))
    pairs = pairs.filter(F.col("distance_m") <= radius_m)
    if digits is not None:
        pairs = pairs.withColumn("distance_m", F.round("distance_m", digits))
    return pairs.repartition("id")


def alert_recipients(alerts: DataFrame, loc: DataFrame, subs: DataFrame, radius_m: float = 50_000, digits: int | None = None) -> DataFrame:
    """Each alert with each active subscriber within the radius of its city.

    Distances (rounded to ``digits``, if given) are taken between cities that have alerts and subscribers; alerts, written once, join these pairs by city. The result has a row for each
    alert and subscriber, so whatever depends on one of them alone is best computed before.
    """
    alerts = written(alerts, "sent")
    pairs = subscribers_near(alerts.select("city", "state").distinct().join(loc, ["city", "state"]), subs, radius_m, digits)
    return alerts.join(pairs, ["city", "state"])


def with_message(alerts: DataFrame) -> DataFrame:
    """Alerts with the message that each of their recipients gets."""
    text = F.format_string("Air quality alert for %s, %s: %s index %d at %s UTC", F.col("city"), F.col("state"), F.col("pollutant"), F.col("aqi"), F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return alerts.withColumn("message", text)


def outbox(recipients: DataFrame) -> DataFrame:
    """A message for each recipient of an alert."""
    return (recipients if "message" in recipients.columns else with_message(recipients)).select("id", "email", "time", "message")


def nearest(df: DataFrame, loc: DataFrame, lon: float, lat: float, k: int = 5, ties: tuple[str, ...] = ("city", "state", "pollutant")) -> DataFrame:
    """The k rows nearest to a point, in planar degrees; each task keeps k."""
    d = planar(F.col("longitude"), F.col("latitude"), F.lit(lon), F.lit(lat))
    return with_location(df, loc).withColumn("distance", d).orderBy("distance", *ties).limit(k)


def _cell(level: str) -> list[Column]:
    """The cell of a level that holds the finest cell (x, y)."""
    return [F.expr(f"shiftright({c}, {DEPTH} - {level})").alias(c) for c in ("x", "y")]


def quadtree(points: DataFrame, box: tuple[float, float, float], leaf: int) -> tuple[DataFrame, DataFrame]:
    """The cells of a quadtree over ``points`` (c_lon, c_lat), and the points with the leaf (level, x, y) that holds them.

    A cell (level, x, y, n, leaf, and up_x, up_y of the cell STEP levels above) is split while it holds more than ``leaf`` points and is above DEPTH. All levels are
    counted in one pass, combined before the shuffle, so neither a dense place nor the root is one task's work. Cells without points aren't there.
    """
    x0, y0, side = box
    at = lambda c, low: F.least(F.floor((F.col(c) - low) / side * 2**DEPTH), F.lit(2**DEPTH - 1)).cast("long")
    placed = points.withColumn("x", at("c_lon", x0)).withColumn("y", at("c_lat", y0)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH), F.lit(STEP))))
    placed = placed.select("level", *_cell("level"), *points.columns)
    full = placed.groupBy("level", "x", "y").agg(F.count("*").alias("n")).withColumn("leaf", (F.col("n") <= leaf) | (F.col("level") == DEPTH))
    full = written(full.withColumn("up_x", F.shiftright("x", STEP)).withColumn("up_y", F.shiftright("y", STEP)), "cells")
    split = full.filter("not leaf").select((F.col("level") + STEP).alias("level"), F.col("x").alias("up_x"), F.col("y").alias("up_y"))
    tree = written(full.join(split, ["level", "up_x", "up_y"], "left_semi").unionByName(full.filter("level = 0")), "tree")
    return tree, placed.join(tree.filter("leaf").select("level", "x", "y"), ["level", "x", "y"])


def _may_hold_nearest(cells: DataFrame, box: tuple[float, float, float], k: int) -> DataFrame:
    """Of each user's cells those that may hold one of its k nearest points: not further than the cells that hold k points for sure reach."""
    x0, y0, side = box
    edge = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    least, most = [], []
    for c, i, zero in (("longitude", "x", x0), ("latitude", "y", y0)):
        low = F.col(i) * edge + zero
        least.append(F.greatest(low - F.col(c), F.col(c) - low - edge, F.lit(0.0)))
        most.append(F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - low - edge)))
    size = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("_most", "level", "x", "y"))
    judged = cells.withColumn("_least", size(least)).withColumn("_most", size(most)).withColumn("_upto", upto)
    judged = judged.withColumn("_enough", F.min(F.when(F.col("_upto") >= k, F.col("_most"))).over(Window.partitionBy("id")))
    kept = F.col("_enough").isNull() | (F.col("_least") <= F.col("_enough") + 1e-9 * side)  # room for rounding
    return judged.filter(kept).select(*cells.columns)


def nearest_places(users: DataFrame, places: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(id, city, state, distance): for each of ``users`` (id, longitude, latitude) the k nearest of ``places`` (city, state, c_lon, c_lat), ties by city and state.

    Users go down a quadtree of the places together, STEP levels a round, each with the cells that may still hold one of its k nearest, until all
    these are leaves; then they meet the places of their leaves. What a user meets depends on k and ``leaf``, not on how dense places lie
    around it. Of places at one point k stand for it. Each round is written, so plans don't grow. Places without finite coordinates take no part;
    with fewer than k places all are returned; no users or no places give an empty result.
    """
    finite = reduce(and_, [F.abs(F.col(c)) < float("inf") for c in ("c_lon", "c_lat")])
    point = Window.partitionBy("c_lon", "c_lat").orderBy("city", "state")
    places = places.filter(finite).withColumn("_r", F.row_number().over(point)).filter(F.col("_r") <= k).drop("_r")
    places = written(places.select("city", "state", "c_lon", "c_lat"), "places")
    b = places.agg(F.min("c_lon"), F.min("c_lat"), F.max("c_lon"), F.max("c_lat"), F.count("*").alias("n")).first()
    box = (b[0] or 0.0, b[1] or 0.0, max((b[2] or 0.0) - (b[0] or 0.0), (b[3] or 0.0) - (b[1] or 0.0), 1e-6))
    tree, held = quadtree(places, box, leaf)
    root = [F.lit(0).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(b["n"]).cast("long").alias("n"), F.lit(b["n"] <= leaf).alias("leaf")]
    front = users.select("id", "longitude", "latitude", *root)
    for level in range(STEP, DEPTH + 1, STEP):
        inner = front.filter("not leaf")
        if inner.isEmpty():
            break
        below = tree.filter(F.col("level") == level).select("level", "x", "y", "n", "leaf", "up_x", "up_y")
        if 4**level <= 4096:  # a level has no more cells than that
            below = F.broadcast(below)
        inner = inner.select("id", "longitude", "latitude", F.col("x").alias("up_x"), F.col("y").alias("up_y")).join(below, ["up_x", "up_y"]).drop("up_x", "up_y")
        front = written(_may_hold_nearest(front.filter("leaf").unionByName(inner), box, k), "front")
    # The places of a leaf are one row (of a leaf at the least level that holds more: several), and a user keeps k of them where it meets them.
    piece = F.pmod(F.xxhash64("city", "state"), F.ceil(F.col("n") / leaf)).alias("piece")
    held = held.join(tree.select("level", "x", "y", "n"), ["level", "x", "y"]).select("level", "x", "y", piece, F.struct("c_lon", "c_lat", "city", "state").alias("p"))
    lists = written(held.groupBy("level", "x", "y", "piece").agg(F.collect_list("p").alias("_held")), "leaves")
    d = lambda p: planar(F.col("longitude"), F.col("latitude"), p["c_lon"], p["c_lat"]).alias("distance")
    best = F.slice(F.array_sort(F.transform("_held", lambda p: F.struct(d(p), p["city"].alias("city"), p["state"].alias("state")))), 1, k)
    near = front.drop("n", "leaf").join(lists, ["level", "x", "y"]).select("id", best.alias("_best"))
    least = F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k)
    return near.groupBy("id").agg(least.alias("_best")).select("id", F.explode("_best").alias("p")).select("id", "p.city", "p.state", "p.distance")


def nearest_for_users(df: DataFrame, loc: DataFrame, users: DataFrame, k: int = 5, ties: tuple[str, ...] = ("city", "state", "pollutant")) -> DataFrame:
    """For each user the k rows nearest to it; for one without a location the k latest rows.

    Users meet cities, not rows: of each user's cities the k nearest are kept (their rows hold the k nearest rows), see ``nearest_places``. Cities are a
    dimension; k rows of each, written so that Spark knows their size, join the users' cities.
    """
    df = written(df, "rows")
    first = Window.partitionBy("city", "state").orderBy(*ties)
    df, every = written(df.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r"), "first"), df
    here = df.join(loc.select("city", "state"), ["city", "state"], "left_semi").select("city", "state").distinct()
    cities = here.join(loc, ["city", "state"]).select("city", "state", F.col("longitude").alias("c_lon"), F.col("latitude").alias("c_lat"))
    todo = users.filter("longitude is not null and latitude is not null").select("id", "longitude", "latitude")
    pairs = nearest_places(todo, cities, k)
    rows = df.join(pairs, ["city", "state"])
    r = Window.partitionBy("id").orderBy("distance", *ties)
    near = rows.withColumn("rank", F.row_number().over(r)).filter(F.col("rank") <= k)
    last = every.orderBy(F.desc("time"), *ties).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("time"), *ties)))  # k rows
    rest = users.filter("longitude is null or latitude is null").select("id").join(F.broadcast(last)).withColumn("distance", F.lit(None).cast("double"))
    return near.unionByName(rest.select(near.columns))


def of_top_sensors(a: DataFrame, k: int = 20) -> DataFrame:
    """The rows of the k sensors with most rows, in the order of time and site."""
    top = a.groupBy("SiteID").count().orderBy(F.desc("count"), "SiteID").limit(k).select("SiteID")
    return a.join(F.broadcast(top), "SiteID", "left_semi").orderBy("timestamp", "SiteID")  # k rows


def last_two(avg: DataFrame, keys: tuple[str, ...] = ("city", "state", "pollutant")) -> DataFrame:
    """Of each key the last and the last but one average: current, previous."""
    w = Window.partitionBy(*keys).orderBy(F.desc("time_start"))
    two = avg.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return two.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col("aqi"))).alias("current"), F.max(F.when(F.col("_r") == 2, F.col("aqi"))).alias("previous"))
