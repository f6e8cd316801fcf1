"""What the operators of this folder share: words, batches, components of a graph."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..interim import dropped, removed, shared_dir, shared_path, written

__all__ = ["WORD", "batches", "components", "dropped", "removed", "shared_dir", "shared_path", "utf8", "written"]

#: A word, as every contract here has it: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` whose batches stay within some 16 MB, however long the texts, and at most ``rows``. Sets the session's limits, which hold when the result is
    computed."""
    conf = df.sparkSession.conf
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        conf.set(key, value)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(it)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """A worker takes task after task, so what it no longer needs goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def utf8(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node in ``edges`` (a, b: long); root is the component's smallest node.

    Large-star and small-star steps in turn, O(log² n) rounds; each round is written to the shared folder. Minima are
    aggregated before the shuffle and joins on a node can be split, so a node with very many edges does no harm.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = sign(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        old, (edges, before) = edges, (written(small, "edges"), now)
        dropped(old)
        dropped(large)
        now = sign(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
