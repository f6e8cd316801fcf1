"""Operator 7: near-duplicate documents by SimHash, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, components, utf8, written

RADIUS = 3
#: Fingerprints of one shard tree at most; larger shards are split, see ``near_pairs``.
TREE = 2048
CHUNK = 1 << 18


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words joined by a space, in arrays of at most CHUNK."""
    if not words:
        return
    k = min(k, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(words) - k] + 1).tolist()]
    for at in range(0, len(last), CHUNK):
        yield np.array([h(line[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], dtype=np.uint64)


def fingerprint(words: list[bytes], k: int = 3) -> int:
    """64 bits; a bit is 1 if more than half of the shingles' hashes have it. No words: 0."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(words, k):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and fp of each row; fp is the fingerprint of its text as a signed long. A null text counts as empty."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t.lower().split(), k) for t in b.column(len(keep)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    kinds = dict(docs.dtypes)
    return batches(docs.select(*keep, utf8().alias("_text")), step, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        new = len(self.value)
        self.value.append(x)
        self.children.append({})
        at = 0
        while at < new:
            d = (x ^ self.value[at]).bit_count()
            at = self.children[at].setdefault(d, new)
        return new

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def links(values: list[int], radius: int, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs within the radius that join the same groups as all such pairs do: among values, or of queries with values."""
    tree, own = BKTree(), queries is None
    values, parent = values if own else values + queries, list(range(len(values) + len(queries or ())))
    out, n = [], len(values) - len(queries or ())

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius) if own or i >= n else ():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((x, values[j]))
        if own or i < n:
            tree.add(x)
    return out


def _blocks() -> Column:
    """Four keys: each 16-bit block with its number. Of two fingerprints that differ in at most 3 bits, one of four blocks is equal."""
    return F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(i << 16)) for i in range(4)])


def _parts() -> Column:
    """Four keys within one of ``_blocks``: each 12-bit part of the other 48 bits, of which again one is equal."""
    rests = []
    for i in range(4):
        low = F.col("fp").bitwiseAND(F.lit((1 << 16 * i) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("fp", 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rests.append(low.bitwiseOR(high))
    rest = F.element_at(F.array(*rests), (F.shiftright("key", 16) + 1).cast("int"))
    return F.array(*[F.shiftleft("key", 14).bitwiseOR(F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))).bitwiseOR(F.lit(j << 12)) for j in range(4)])


def _across() -> Column:
    """Four keys within one of ``_parts``: every fourth of the sixteen 4-bit pieces, so that each set lies across the blocks before."""
    piece = lambda i: F.shiftrightunsigned("fp", 4 * i).bitwiseAND(F.lit(15))
    return F.array(*[F.xxhash64("key", F.lit(g), *[piece(4 * b + g) for b in range(4)]) for g in range(4)])


def _search(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links among the fingerprints (fp) of each key, which are no more than a tree may hold."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in it:
            keys, fps = (batch.column(i).to_numpy() for i in (0, 1))
            cuts, fps = np.flatnonzero(np.diff(keys)) + 1, fps.view(np.uint64).tolist()
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo < hi and keys[lo] != key:
                    out += links(held, radius) if len(held) > 1 else []
                    key, held = keys[lo], []
                held += fps[lo:hi]
            if out:
                yield _rows(out)
        if out := links(held, radius):
            yield _rows(out)

    return batches(keyed.repartition("key").sortWithinPartitions("key", "fp"), step, "a long, b long")


def _rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_pairs(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (fp) within the radius, enough of them to join every group.

    Fingerprints are dealt into shards by one equal 16-bit block (four keys each; all pairs within 3 bits share one), and each shard
    has its own BK-tree. Shards are counted first: one with more than ``tree`` fingerprints is never sent to a task, but split in up to three more
    steps, all exact: by 12 more bits, by 16 bits across these (again one of four is equal), then into slices, each slice's tree being
    searched by the other slices.
    """
    assert radius <= 3
    found, large = [], fps.select(F.lit(0).cast("long").alias("key"), "fp")
    for keys in (_blocks(), _parts(), _across()):
        keyed = large.select(F.explode(keys).alias("key"), "fp")
        beyond = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tree).select("key"), "beyond")
        if beyond.isEmpty():
            found.append(_search(keyed, radius))
            return reduce(DataFrame.unionByName, found)
        found.append(_search(keyed.join(beyond, "key", "left_anti"), radius))
        large = written(keyed.join(beyond, "key", "left_semi"), "large")
    pairs = reduce(DataFrame.unionByName, found)
    n = large.groupBy("key").agg(F.ceil(F.count("*") / tree).cast("int").alias("n"))
    slices = large.join(n, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    slices = slices.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def both(pdf):
        import pandas as pd

        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        values = [pdf.loc[pdf["own"] == x, "fp"].to_numpy().view(np.uint64).tolist() for x in (i, j)]
        got = links(values[0], radius) if i == j else links(values[0], radius, values[1])
        return pd.DataFrame(np.array(got, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return pairs.unionByName(slices.groupBy("key", "i", "j").applyInPandas(both, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable through links) of every row.

    Equal texts have equal fingerprints; trees and graph hold each distinct fingerprint once, so a large group of copies is
    one node and copies are never paired. A null text is an empty one; empty texts have fingerprint zero and are linked as
    any other. Rows that repeat a doc_id stay rows of their own; a null doc_id is in its component but never names it
    (component_id is null only if no doc_id is reachable). An empty table gives an empty result; further columns are
    ignored.
    """
    own = written(fingerprints(docs, k), "fingerprints")
    named = _firsts(own.withColumn("first", F.col("doc_id")), radius).withColumnRenamed("first", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _firsts(own: DataFrame, radius: int) -> DataFrame:
    """(fp, first): for each fingerprint in ``own`` (fp, first) the least ``first`` of its component."""
    fps = written(own.groupBy("fp").agg(F.min("first").alias("least")), "distinct")
    roots = components(near_pairs(fps.select("fp"), radius))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return written(rooted.join(least, "root").select("fp", "first"), "components")


def one_of_each(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest doc_id, whatever the names of its columns.

    Groups are those of ``near_duplicates``, over rows: of several rows with the smallest doc_id one stays (the first as read), and rows that
    repeat a doc_id but are unlike each other stay all. A row with a null doc_id stays only if no row of its group has one; of several such one stays. Texts
    that are null, empty or blank are alike and one of them stays. An empty table gives an empty result.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    own = written(fingerprints(packed, k, ("row", "doc_id", "doc")), "packed")
    slim = own.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("first"))
    kept = _firsts(slim, radius).select("first.row").distinct()
    return own.join(kept, "row", "left_semi").select("doc.*")
