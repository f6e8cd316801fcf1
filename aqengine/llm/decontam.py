"""Operator 10: documents that hold benchmark items, by SimHash of item-sized windows and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import batches, utf8, written
from .memo import places
from .words import pieces, runs, word_hashes

K, SIMILARITY = 5, 0.8
#: Words of 64 bits of a fingerprint, and bits in which a window's may differ from an item's. At similarity 0.8 some 40 of 256 differ, six more for a standard
#: deviation; of unlike ones 128, eight less for a deviation.
PARTS, RADIUS = 4, 88
#: Items (and their shingles, some 40 bytes each) that go to the executors at a time; more are taken in blocks, each a pass over the documents.
ITEMS, ITEM_SHINGLES = 50_000, 1_000_000
_TABLE = 20


def _spread(h: np.ndarray) -> np.ndarray:
    """PARTS words of bits for each hash: (hashes, PARTS)."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(PARTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """PARTS words; a bit is 1 if the shingles that have it weigh over half of all."""
    if not len(h):
        return np.zeros(PARTS, np.uint64)
    bits = np.unpackbits(_spread(h).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(2 * (w @ bits) > w.sum(), bitorder="little").view(np.uint64)


class HammingIndex:
    """All fingerprints within a radius: of PARTS blocks of 64 bits at least one then differs in at most its share of the radius. Blocks are that wide because a
    quarter of 88 bits in 64 is rare (1 unlike pair of 120), while 6 in 16 is not; each is looked through whole, and what it leaves is compared in full."""

    def __init__(self, fps: np.ndarray, radius: int) -> None:
        self.fps, self.radius = fps.reshape(-1, PARTS), radius
        self.blocks = [np.ascontiguousarray(b) for b in self.fps.T]

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        some = np.zeros(len(self.fps), bool)
        for block, own in zip(self.blocks, fp, strict=True):
            some |= np.bitwise_count(block ^ own) <= self.radius // PARTS
        return np.flatnonzero(some)

    def near(self, fp: np.ndarray) -> np.ndarray:
        own = self.candidates(fp)
        return own[np.bitwise_count(self.fps[own] ^ fp).sum(1, dtype=np.int64) <= self.radius]


@dataclass
class Items:
    """A block of items: each one's distinct shingles with their counts and weights, fingerprints, and of every shingle the places in items. Flat arrays all."""

    ids: list[int]
    sizes: np.ndarray
    fps: np.ndarray
    ends: np.ndarray
    shingle: np.ndarray
    count: np.ndarray
    weight: np.ndarray
    by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[Row], total: int) -> Items:
        """``rows``: item_id, n (words), h (of its shingles, in order), in_items (how many of all ``total`` items have each)."""
        runs_of = [np.array(r["h"], np.int64).view(np.uint64) for r in rows]
        fps, parts = [], []
        for r, h in zip(rows, runs_of, strict=True):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            # A shingle that many items share says less: it weighs by the logarithm of the items' number over that of its own.
            w = np.log1p(total / np.array(r["in_items"], float)[first])
            parts.append((u, n, w))
            fps.append(simhash(u, n * w))
        sizes = np.array([r["n"] for r in rows], np.int64)
        by_k = {}
        for k in sorted(set(np.minimum(K, sizes).tolist())):
            own = np.flatnonzero(np.minimum(K, sizes) == k)
            h = np.concatenate([runs_of[i] for i in own.tolist()])
            n = np.array([len(runs_of[i]) for i in own.tolist()])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _TABLE, bool)
            table[(h >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
            w = np.concatenate([np.log1p(total / np.array(rows[i]["in_items"], float)) for i in own.tolist()])
            by_k[k] = (h[order], np.repeat(own, n).astype(np.int32)[order], places(np.zeros(len(n), np.int64), n).astype(np.int32)[order], w[order], table)
        ends = np.concatenate([[0], np.cumsum([len(u) for u, _, _ in parts])])
        return cls([r["item_id"] for r in rows], sizes, np.array(fps, np.uint64).reshape(-1, PARTS), ends, *(np.concatenate(x) for x in zip(*parts, strict=True)), by_k)

    def index(self) -> HammingIndex:
        return HammingIndex(self.fps, RADIUS)

    def similarity(self, item: int, window: np.ndarray, n: np.ndarray) -> float:
        """The share of the item's shingle weight that is in the window (its distinct shingles in order, and their counts)."""
        own = slice(self.ends[item], self.ends[item + 1])
        s, c, w = self.shingle[own], self.count[own], self.weight[own]
        at = np.minimum(np.searchsorted(window, s), len(window) - 1)
        return float((w * np.where(window[at] == s, np.minimum(c, n[at]), 0)).sum() / (w * c).sum())

    def search(self, h: np.ndarray, index: HammingIndex, least: float = SIMILARITY) -> dict[int, tuple[float, int, int]]:
        """For each item in a text (its word hashes): best similarity, first word and number of words of the window.

        A window that shares no shingle with any item cannot pass, so windows are laid where a shingle of a text stands in some item
        at the same place of the window. Which items a window is compared with, its fingerprint says: shingles weigh in it as they do in the
        similarity, and those of no item not at all, so text that items share, or that stands between an item's words, moves few bits.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for k, (table, item, place, weight, bits) in self.by_k.items():
            r = runs(h, k)
            seeds = np.flatnonzero(bits[(r >> np.uint64(64 - _TABLE)).astype(np.int64)])
            lo, hi = np.searchsorted(table, r[seeds]), np.searchsorted(table, r[seeds], side="right")
            seeds, lo, hi = seeds[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(seeds):
                continue
            at = places(lo, hi - lo)
            start = np.clip(np.repeat(seeds, hi - lo) - place[at], 0, None)
            for first, size in np.unique(np.stack([start, self.sizes[item[at]]], 1), axis=0).tolist():
                own = r[first : first + size - k + 1]
                if not len(own):
                    continue
                u, n = np.unique(own, return_counts=True)
                row = np.minimum(np.searchsorted(table, u), len(table) - 1)
                known = np.flatnonzero(table[row] == u)
                for i in index.near(simhash(u[known], n[known] * weight[row[known]])).tolist():
                    if min(K, self.sizes[i]) == k and (s := self.similarity(i, u, n)) >= least - 1e-12:
                        if i not in best or (-s, first) < (-best[i][0], best[i][1]):
                            best[i] = (s, first, size)
        return best


def item_table(benchmark: DataFrame) -> DataFrame:
    """_item (a number for each row), item_id, n (words), h (shingles' hashes in order) of the items that have words."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = [word_hashes([t])[0] for t in b.column(2).to_pylist()]
            keep = [i for i, w in enumerate(words) if len(w)]
            if keep:
                h = [runs(words[i], min(K, len(words[i]))).view(np.int64) for i in keep]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in h]), pa.int32()), pa.array(np.concatenate(h)))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(keep)) for i in (0, 1)], pa.array([len(words[i]) for i in keep], pa.int64()), flat], names=["_item", "item_id", "n", "h"])

    own = benchmark.filter("item_id is not null and text is not null").select(F.monotonically_increasing_id().alias("_item"), "item_id", utf8().alias("_text"))
    return written(batches(own, step, f"_item long, item_id {dict(benchmark.dtypes)['item_id']}, n long, h array<long>"), "items")


def _blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[Items]:
    """Items in blocks of a checked size, in the order of their ids. Shingles' weights come from all items, so blocks give what one would."""
    table = item_table(benchmark)
    total = table.count()
    place = table.select("_item", F.posexplode("h").alias("i", "s"))
    shared = table.select(F.explode(F.array_distinct("h")).alias("s")).groupBy("s").agg(F.count("*").alias("m"))
    each = place.join(shared, "s").groupBy("_item").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("in_items"))
    held, size = [], 0
    for row in table.join(each, "_item").orderBy("item_id", "_item").toLocalIterator():
        held.append(row)
        size += len(row["h"])
        if len(held) >= items or size >= ITEM_SHINGLES:
            yield Items.of(held, total)
            held, size = [], 0
    if held:
        yield Items.of(held, total)


def _hits(texts: list[bytes], items: Items, index: HammingIndex, least: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    for a, b in pieces(texts):
        h, text, _ = word_hashes(texts[a:b])
        ends = np.searchsorted(text, np.arange(b - a + 1))
        # One look over the whole piece finds the few texts that hold any item's shingle.
        hot = np.zeros(b - a, bool)
        for k, (table, _, _, _, bits) in items.by_k.items():
            r = runs(h, k)
            at = np.flatnonzero(bits[(r >> np.uint64(64 - _TABLE)).astype(np.int64)])
            place = np.minimum(np.searchsorted(table, r[at]), len(table) - 1)
            hot[text[at[table[place] == r[at]]]] = True
        for i in np.flatnonzero(hot).tolist():
            if found := items.search(h[ends[i] : ends[i + 1]], index, least):
                yield a + i, found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each document that holds an item, and the window most like it.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles take five of them (an item of fewer: all). An item
    is held if a window of as many words has at least ``least`` of the item's shingle weight, weights being those among all items. Items' places in
    documents overlap freely. Documents aren't shuffled; items go to the executors in blocks of a checked size, which change no result.

    Null texts, null item ids and items without words match nothing; repeated rows each give their own rows, repeated items
    each match; an empty table gives an empty result; further columns are ignored.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    out = None
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def step(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            ids, index = items.ids, items.index()
            for b in it:
                rows = [(i, ids[j], *v) for i, found in _hits(b.column(1).to_pylist(), items, index, least) for j, v in sorted(found.items())]
                if rows:
                    at, item, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item), *[pa.array(x) for x in rest]], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        own = batches(docs.select("doc_id", utf8().alias("_text")), step, schema)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold an item; nothing is shuffled. See ``contaminated``."""
    out = docs
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def step(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            index = items.index()
            for b in it:
                keep = np.ones(b.num_rows, bool)
                keep[[i for i, _ in _hits(b.column(0).to_pylist(), items, index, least)]] = False
                yield b.select(list(range(1, b.num_columns))).filter(pa.array(keep))

        schema = out.schema
        out = batches(out.select(utf8().alias("_text"), *[F.col(f"`{c}`") for c in out.columns]), step, schema)
    return out
