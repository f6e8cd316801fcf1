"""Operator 5: token ids of a corpus in a compact binary format.

Format (a folder): ``vocab`` is a Parquet table (rank, id), ids by falling frequency. ``ids/shard=N`` are Parquet files, one
record for each document in ascending doc_id order, shard after shard: doc_id, start, n_tokens, control, data. An id is stored as
its rank in 1 to 4 bytes, lowest byte first; ``control`` has two bits for each id, four ids in a byte from the lowest bits
up, saying how many bytes less one; ``data`` has the bytes. Every record stands alone, so files can be split and read in any order.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, removed, shared_path
from .memo import Memo, flat_binary, flat_bytes, gathered, places

#: White space other than the space and the line feed, by the tokenizer's pattern.
_OTHER = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts are cut before each space and each line feed: byte-level BPE of this family never joins what stands on both sides of one that has no other
#: white space beside it (two line feeds are two pieces as well). Texts with other runs of white space, or some at an end, are encoded whole.
ODD = rf"^[ ]|[ \n]$|^{_OTHER}|{_OTHER}$|[ ][ \n]|\n[ ]|\n\n\n|[ \n]{_OTHER}|{_OTHER}[ \n]"
#: Pieces are parted once more before the marks at their end; and pieces of these letters alone go to the model without a search for parts.
PARTS = r"^(?P<stem>(?s:.*)[0-9A-Za-z\x{C0}-\x{24F}])(?P<marks>[.,;:!?|]+)$"
LETTERS = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Pieces whose ids a worker keeps, the longest of them in bytes, and the bytes of texts that are encoded at a time.
KEPT, LONGEST, GATHERED = 250_000, 64, 4 << 20
#: Bytes of pieces that the tokenizer gets at a time.
CHUNK = 1 << 16

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)
_MASKS = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class Encoder:
    """Ids of texts by a tokenizers file. Texts are cut into pieces at spaces and line feeds, and each distinct piece is encoded once: words go to the
    file's model by themselves, other pieces in a row with line feeds between them, whose ids part them again. The ids of the KEPT pieces
    most in use stay at hand, in flat arrays. A file that isn't plain byte-level BPE encodes whole texts instead."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        self.cuts = made["model"]["type"] == "BPE" and not made.get("normalizer") and not made.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        self.cuts = self.cuts and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        self.odd = "|".join([ODD, *[re.escape(t["content"]) for t in added]])
        feed = self.whole("\n")
        self.cuts, self.feed = self.cuts and len(feed) == 1, feed[:1]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memo = Memo(self._new, lambda: KEPT, LONGEST)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (LETTERS), and how many each has."""
        named = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[10]) if words else []
        got = [[t.id for t in self.model.tokenize(w)] for w in named]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without line feeds, and how many each has."""
        ids, sizes, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and size < CHUNK:
                size += len(pieces[end])
                end += 1
            got = np.array(self.tokenizer.encode_batch_fast(["\n" + "\n".join(pieces[at:end])], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(got == self.feed[0])
            if len(first) == end - at:
                sizes.append(np.diff(np.append(first, len(got))) - 1)
                ids.append(got[got != self.feed[0]])
            else:
                each = [self.whole(p) for p in pieces[at:end]]
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
            at = end
        return np.concatenate(ids), np.concatenate(sizes)

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False)
        others = ~words & pc.invert(pc.is_in(pieces, pa.array(["", " "]))).to_numpy(zero_copy_only=False)  # no text has a space alone
        start, size, pool = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.zeros(0, np.uint32)
        for own, make in ((words, self._words), (others, self._others)):
            ids, n = make(pieces.filter(pa.array(own)).to_pylist())
            start[own], size[own] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
        return pool, start, size

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = np.ones(len(texts), bool) if not self.cuts else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat, firsts = cut.flatten(), cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        named = flat.dictionary_encode()
        codes = named.indices.to_numpy().astype(np.int32)
        codes[firsts] = len(named.dictionary) + np.arange(len(firsts))
        # Pieces have their space before them, but for the first of a text and those after a line feed.
        feed = pc.starts_with(pa.concat_arrays([named.dictionary, flat.take(pa.array(firsts))]), "\n")
        every = pa.concat_arrays([pc.binary_join_element_wise("", named.dictionary, " "), flat.take(pa.array(firsts))])
        every = pc.if_else(feed, pc.replace_substring_regex(every, r"^ ?\n", ""), every)
        parts = pc.extract_regex(every, PARTS)
        stem, marks = (parts.field(i) for i in (0, 1))
        whole = pc.is_null(parts)
        units = pa.concat_arrays([pc.if_else(whole, every, stem), pc.if_else(whole, "", marks)]).dictionary_encode()
        of = units.indices.to_numpy().reshape(2, -1)
        times = np.bincount(codes, minlength=len(every))
        pool, start, sizes = self.memo(units.dictionary, np.bincount(of.ravel(), np.tile(times, 2), len(units.dictionary)).astype(np.int64))
        pool = np.append(pool, self.feed[0])
        size = np.stack([feed.to_numpy(zero_copy_only=False).astype(np.int64), *sizes[of]], 1)
        pool = pool[places(np.stack([np.full(len(every), len(pool) - 1), *start[of]], 1).ravel(), size.ravel())]
        size = size.sum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(pool, pa.uint32()))
        out = lists.take(pa.array(codes)).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[codes])])
        count = np.diff(np.append(upto[firsts], upto[-1]))
        if odd.any():
            split = np.split(out, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                split[i] = self.whole(texts[i].as_py())
            out, count = np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return out, count

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        out, count = self.flat(texts)
        return np.split(out, np.cumsum(count)[:-1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_all(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of records of unsigned 32-bit values, one after the other, and how many of each a record has."""
    v = np.ascontiguousarray(values, dtype="<u4")
    less = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= less[:, None]]
    controls = -(-sizes // 4)
    four = np.zeros(4 * int(controls.sum()), np.uint8)
    four[places(4 * (np.cumsum(controls) - controls), sizes)] = less
    upto = np.concatenate([[0], np.cumsum(less + np.int64(1))])
    last = np.cumsum(sizes)
    return (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8), data, controls, upto[last] - upto[last - sizes]


def unpack_all(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all records; a table over control bytes says where each data byte goes."""
    controls = -(-sizes // 4)
    where = _MASKS[control].reshape(-1, 4)[places(4 * (np.cumsum(controls) - controls), sizes)]
    out = np.zeros((len(where), 4), np.uint8)
    out[where] = data
    return out.view("<u4").ravel()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one record."""
    control, data, _, _ = pack_all(values, np.array([len(values)]))
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    return unpack_all(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array([n]))


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encodes every text of ``docs``, each followed by ``end_id``, into files of the format above at ``path``.

    Documents are dealt out by ranges of doc_id and sorted within them; texts are encoded once, into an interim table beside the
    files, which goes when they are written. Only the counts of ids (bounded by the vocabulary) and the lengths of shards reach the driver. A null text is
    an empty one: its record has the end id alone. Rows that repeat a doc_id follow one another in the order of a hash of their texts,
    by which they may be dealt to several shards; null doc_ids come first. An empty table writes an empty folder of files. Further columns are ignored.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at, total = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        names = ["shard", "doc_id", "n_tokens", "at", "ids", "counts"]
        for ids_col, texts in gathered(it, 1, GATHERED):
            ids, n = enc.flat(texts)
            # Every text's end goes behind it.
            every = np.full(len(ids) + len(n), end_id, np.uint32)
            every[places(np.cumsum(n + 1) - n - 1, n)] = ids
            n = n + 1
            upto = at + np.cumsum(n)
            at = int(upto[-1])
            c = np.bincount(every)
            total, c = (total, c) if len(total) >= len(c) else (c, total)
            total[: len(c)] += c
            narrow = every.astype("<u2") if len(total) <= 1 << 16 else every.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), ids_col, pa.array(n), pa.array(upto - n), flat_binary(narrow.view(np.uint8), n * narrow.itemsize), pa.nulls(len(n), pa.binary())], names=names)
        if len(total):  # and a row with how often each id was met
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, ids_col.type), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    interim = batches(dealt, encode, f"shard int, doc_id {kind}, n_tokens long, at long, ids binary, counts binary")
    interim.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{path}/interim")
    own = spark.read.schema(interim.schema).parquet(f"{path}/interim")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in b.column(0).to_pylist():
                total = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["id", "n"])

    rank = batches(own.filter("counts is not null").select("counts"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(dtype=np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/vocab")
    rank_of = np.zeros(int(rank.max(initial=0)) + 1, np.uint32)
    rank_of[rank] = np.arange(len(rank))
    own = own.filter("counts is null").drop("counts")
    sizes = own.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before = dict(zip((r["shard"] for r in sizes), itertools.accumulate((r["n"] for r in sizes), initial=0), strict=False))

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            n, ids = b.column("n_tokens").to_numpy(), flat_bytes(b.column("ids"))
            if len(ids) == 2 * n.sum():
                values = ids.view("<u2")
            elif len(ids) == 4 * n.sum():
                values = ids.view("<u4")
            else:
                values = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(b.column("ids").to_pylist(), n.tolist(), strict=True)])
            control, data, controls, datas = pack_all(rank_of[values], n)
            start = np.array([before[s] for s in b.column("shard").to_pylist()], np.int64) + b.column("at").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), pa.array(start), b.column("n_tokens"), flat_binary(control, controls), flat_binary(data, datas)], names=["shard", "doc_id", "start", "n_tokens", "control", "data"])

    out = batches(own, store, f"shard int, doc_id {kind}, start long, n_tokens long, control binary, data binary")
    out.sortWithinPartitions("shard", "start").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").partitionBy("shard").parquet(f"{path}/ids")
    removed(spark, f"{path}/interim")


def read_ids(spark: SparkSession, path: str, doc_id: str = "long", texts: bool = False) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian 32-bit integers; with
    ``texts`` (meant for tests and samples) also ids."""
    id_of = spark.read.parquet(f"{path}/vocab").orderBy("rank").toPandas()["id"].to_numpy(dtype=np.uint32)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_numpy()
            ids = id_of[unpack_all(flat_bytes(b.column("control")), flat_bytes(b.column("data")), n)].astype("<u4")
            line, ends = memoryview(ids.tobytes()), 4 * np.concatenate([[0], np.cumsum(n)])
            crcs = [zlib.crc32(line[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cols = [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if texts:
                cols.append(pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(ids, pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.schema(f"doc_id {doc_id}, start long, n_tokens long, control binary, data binary").parquet(f"{path}/ids")
    return batches(files, step, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * texts)


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the files of ``docs`` into the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path, dict(docs.dtypes)["doc_id"])
