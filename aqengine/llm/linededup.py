"""Operator 4: repeated and nearly repeated lines, by a deletion-neighbourhood join.

The edit bound is one word: two lines are near if one becomes the other by adding, removing or replacing one word (A-Z lower-cased,
words as everywhere here), and both have at least MIN_WORDS. All variants of a line with one word left out are hashed; lines
with an equal variant are joined, and the edit is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, utf8, written
from .words import BACK, STEP, mix, pieces, powers, word_hashes

#: Shorter lines are repeated only if they are equal: one word in four is not a small edit.
MIN_WORDS = 5
#: Places of the bitmap of documents.
BITS = 1 << 24
_STEP, _BACK = int(STEP), int(BACK)


def _prefix(h: np.ndarray) -> np.ndarray:
    """Sums of h[j] * STEP**j before each place."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_STEP, 1 << max(12, len(h).bit_length()))[: len(h)], out=out[1:])
    return out


def _ranged(pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words a to b, alike wherever they stand."""
    return mix((pre[b] - pre[a]) * powers(_BACK, 1 << max(12, len(pre).bit_length()))[a] + (b - a).astype(np.uint64))


def _lines(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the texts: number of the first text; each line's text, number, first and last word; and the words' prefix sums."""
    for lo, hi in pieces(texts):
        h, text, line = word_hashes(texts[lo:hi], b"\n")
        count = np.array([t.count(b"\n") + 1 for t in texts[lo:hi]], np.int64)
        base = np.cumsum(count) - count
        key = base[text] + line
        bounds = np.searchsorted(key, np.arange(count.sum() + 1))
        owner = np.repeat(np.arange(hi - lo), count)
        yield lo, owner, np.arange(count.sum()) - base[owner], bounds[:-1], bounds[1:], _prefix(h)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def line_table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """_row (a number for each row, or the column ``row``), doc_id, _text (a hash of the whole text), line (from 0), n (words), h (of all words), halves.

    halves: hashes of the first and last floor(m / 2) words for m = n and m = n - 1. Lines of m words, or m and m + 1, that are one
    word apart have one of the halves of m in common; so lines without such a partner need no variants.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, owner, line, first, last, pre in _lines(b.column(3).to_pylist()):
                n = last - first
                cols = []
                for less in (0, 1):
                    half = np.maximum(n - less, 0) // 2
                    salt = ((n - less) * 4 + 1).astype(np.uint64)
                    cols += [_ranged(pre, first, first + half) ^ mix(salt), _ranged(pre, last - half, last) ^ mix(salt + np.uint64(1))]
                halves = pa.FixedSizeListArray.from_arrays(_signed(np.stack(cols, 1).ravel()), 4).cast(pa.list_(pa.int64()))
                at = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(line), pa.array(n), _signed(_ranged(pre, first, last)), halves], names=["_row", "doc_id", "_text", "line", "n", "h", "halves"])

    own = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("_row"), "doc_id", F.xxhash64("text").alias("_text"), utf8().alias("_utf8"))
    return batches(own, step, f"_row long, doc_id {kind}, _text long, line long, n long, h long, halves array<long>")


def _held_by(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_id, _text, _utf8 of the documents that may hold a wanted line (_id, _text): a bitmap of BITS places, at most 2 MB however many lines there
    are, spares the others the shuffle."""
    place = F.pmod(F.xxhash64("_id", "_text"), F.lit(BITS))
    own = docs.select(F.xxhash64("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), utf8().alias("_utf8")).withColumn("_place", place)
    bits = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = own.withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(bits), "_bucket")
    return found.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select("_id", "_text", "_utf8")


def _variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """at, text (words joined by a space), variants: for each wanted line (_id, _text, line, at) the hashes without its i-th word."""
    asked = wanted.groupBy("_id", "_text").agg(F.collect_list(F.struct("line", "at")).alias("asked"))
    own = _held_by(docs, wanted).join(asked, ["_id", "_text"])

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, asked = b.column(0).to_pylist(), b.column(1).to_pylist()
            ats, lines, variants = [], [], []
            for lo, owner, _, first, last, pre in _lines(texts):
                start = np.searchsorted(owner, np.arange(owner[-1] + 2)) if len(owner) else [0]
                back = powers(_BACK, 1 << max(12, len(pre).bit_length()))
                for i in range(len(start) - 1):
                    split = texts[lo + i].split(b"\n")
                    for want in asked[lo + i]:
                        a, z = int(first[start[i] + want["line"]]), int(last[start[i] + want["line"]])
                        j = np.arange(a, z)
                        # The words before the one left out, and those after it moved one place forward.
                        rest = (pre[j] - pre[a]) + (pre[z] - pre[j + 1]) * BACK
                        ats.append(want["at"])
                        lines.append(b" ".join(split[want["line"]].lower().split()).decode("utf-8", "replace"))
                        variants.append(mix(rest * back[a] + np.uint64(z - a - 1)).view(np.int64))
            if ats:
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(v) for v in variants]), pa.int32()), pa.array(np.concatenate(variants)))
                yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(lines, pa.string()), flat], names=["at", "text", "variants"])

    return batches(own.select("_utf8", "asked"), step, "at long, text string, variants array<long>")


def _without(text: str, i: str) -> Column:
    """The words of a line without the i-th (-1: with all)."""
    w = F.split(F.col(text), " ", -1)
    return F.when(F.col(i) < 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(F.col(i), F.lit(0))), F.slice(w, F.greatest(F.col(i), F.lit(0)) + 2, F.size(w))))


def near_lines(docs: DataFrame, table: DataFrame, first: DataFrame) -> DataFrame:
    """h of each distinct line that has an earlier line within one edit.

    ``table`` is the line table; ``first`` has each distinct line's h, n, _text and pos (doc_id, _row, line of its first place). Lines that share a variant at the
    same place differ in that word alone, so each needs comparing only with the earliest of them; the same holds for a line
    and those that become it by losing a word. So no pairs within a group are made, and groups are summed before the shuffle.
    Only lines that share a half with another are numbered (``at``, in the order of pos) and give variants, and only variants
    that two lines share go on.
    """
    long = first.filter(F.col("n") >= MIN_WORDS)
    halves = table.filter(F.col("n") >= MIN_WORDS).select(F.explode("halves").alias("half"), "h")
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("half")
    asked = halves.join(shared, "half").select("h").distinct()
    ranked = long.join(asked, "h").orderBy("pos").select("h", F.monotonically_increasing_id().alias("at"), F.xxhash64("pos.doc_id").alias("_id"), "_text", F.col("pos.line").alias("line"))
    ranked = written(ranked, "ranked")
    found = written(_variants(docs, ranked), "variants")
    every = found.select("at", F.posexplode("variants").alias("i", "v")).unionByName(ranked.select("at", F.lit(-1).alias("i"), F.col("h").alias("v")))
    live = every.groupBy("v").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a <> b").select("v")
    every = written(every.join(live, "v").select("v", "i", "at"), "shared")
    each, whole = every.filter("i >= 0"), every.filter("i < 0")
    least = each.groupBy("v", "i").agg(F.min("at").alias("of"))
    replaced = each.join(least, ["v", "i"]).select("at", "i", "of", F.col("i").alias("j"))
    full = whole.groupBy("v").agg(F.min("at").alias("of"))
    longer = each.join(full, "v").select("at", "i", "of", F.lit(-1).alias("j"))
    # The earliest line that becomes a whole one by losing a word, and the word: the least of the least by word.
    longest = least.groupBy("v").agg(F.min("of").alias("of")).join(least, ["v", "of"]).groupBy("v", "of").agg(F.min("i").alias("j"))
    shorter = full.withColumnRenamed("of", "at").join(longest, "v").select("at", F.lit(-1).alias("i"), "of", "j")
    pairs = replaced.unionByName(longer).unionByName(shorter).filter("of < at")
    pairs = pairs.groupBy("at", "of").agg(F.min(F.struct("i", "j")).alias("ij")).select("at", "of", "ij.i", "ij.j")
    text = found.select("at", "text")
    pairs = pairs.join(text, "at").join(text.select(F.col("at").alias("of"), F.col("text").alias("of_text")), "of")
    pairs = pairs.filter(_without("text", "i") == _without("of_text", "j"))
    return pairs.select("at").distinct().join(ranked, "at").select("h")


def repeated_lines(docs: DataFrame, row: str | None = None) -> DataFrame:
    """The lines of ``docs`` with what becomes of them: _row, doc_id, line, n, same (an equal line stands earlier), near (a near one does).

    Earlier is by doc_id (null last), then row, then line. Lines without words are never repeated ones. Equality is that of words.
    """
    table = written(line_table(docs, row), "lines")
    pos = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "line").alias("pos")
    words = table.filter("n > 0").select("h", "n", "_text", pos)
    first = written(words.groupBy("h", "n").agg(F.min(F.struct("pos", "_text")).alias("f")).select("h", "n", "f.*"), "first")
    near = near_lines(docs, table, first)
    near = near.withColumn("near", F.lit(True))
    verdict = first.join(near, "h", "left").select("h", "n", F.col("pos").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    here = table.select("_row", "doc_id", "line", "n", "h", pos)
    judged = here.filter("n > 0").join(verdict, ["h", "n"]).select("_row", "doc_id", "line", "n", (F.col("pos") != F.col("first")).alias("same"), "near")
    return judged.unionByName(here.filter("n = 0").select("_row", "doc_id", "line", "n", F.lit(False).alias("same"), F.lit(False).alias("near")))


def line_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_same, n_near (repeated, and not also equal to an earlier line), removed (numbers of the
    lines that go, from 0, joined by commas).

    A line goes if an equal or near line stands earlier in the corpus; so of any lines that repeat each other the earliest stays.
    A null text is one empty line, which stays, as all lines without words do. Rows that repeat a doc_id are documents of
    their own. An empty table gives an empty result; further columns are ignored.
    """
    gone = F.col("same") | F.col("near")
    by_row = repeated_lines(docs).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.count_if("same").alias("n_same"), F.count_if(F.expr("near and not same")).alias("n_near"), F.array_join(F.array_sort(F.collect_list(F.when(gone, F.col("line")))).cast("array<string>"), ",").alias("removed"))
    return by_row.drop("_row")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines taken out that ``line_report`` removes, whatever the names of its columns.

    Rows are numbered once, in a table that holds them whole, and matched by that number; so null and repeated doc_ids do no harm. Null texts stay
    null, and an empty table stays empty.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    own = written(packed, "packed")
    gone = repeated_lines(own.select("row", "doc_id", "text"), "row").filter("same or near").groupBy(F.col("_row").alias("row")).agg(F.collect_list("line").alias("gone"))
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col("gone"))  # by hashing; the order stays
    kept = F.transform(kept, lambda i: F.get(lines, i.cast("int")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return own.join(gone, "row", "left").select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
