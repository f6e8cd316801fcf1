"""Operator 2: nearest neighbours by inner product; score-aware quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, dropped, removed, shared_path, written

#: Vectors that the codebooks are fitted on at most; rounds of fitting.
SAMPLE, ROUNDS = 20_000, 6
#: Weight of the error parallel to a vector against that across it.
PARALLEL = 4.0
#: Candidates for each query and block that are reranked at least, and coded vectors of a block at most.
RERANK, BLOCK = 200, 1 << 16
#: Bytes of the query vectors that go out at once.
QUERY_BYTES = 32 << 20
SPREAD = 32
FOUND = "q long, vec_id long, times long, s double"


def valid(embedding: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = F.col(embedding)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0)


@dataclass
class Codebook:
    """16 centres for each pair of dimensions: (pairs, 16, width)."""

    centres: np.ndarray

    def _costs(self, x: np.ndarray) -> np.ndarray:
        """Squared distances (rows, parts, 16)."""
        m, _, w = self.centres.shape
        diff = x.reshape(len(x), m, 1, w) - self.centres
        return (diff**2).sum(3)

    def encode(self, x: np.ndarray, parallel: float = PARALLEL, rounds: int = 2) -> np.ndarray:
        """Codes (rows, parts) that keep |r|² + (parallel - 1) <r, x/|x|>² low, r being the residual; part after part, each given the others."""
        m, _, w = self.centres.shape
        x = x.astype(np.float32)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        cost = self._costs(x)
        # Share of each centre's residual along the vector.
        along = (x * unit).reshape(len(x), m, w).sum(2)[:, :, None] - np.einsum("nmw,mcw->nmc", unit.reshape(len(x), m, w), self.centres)
        codes = cost.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for p in range(m):
                rest = total - along[rows, p, codes[:, p]]
                codes[:, p] = (cost[:, p] + (parallel - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(1)
                total = rest + along[rows, p, codes[:, p]]
        return codes.astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, width: int = 2, parallel: float = PARALLEL, rounds: int = ROUNDS, seed: int = 7) -> Codebook:
        """Codes and centres in turn: centres solve the weighted least squares of all codes at once, part after part, each
        given the others."""
        rng = np.random.default_rng(seed)
        x = _padded(np.asarray(x, np.float32), width)
        m = x.shape[1] // width
        parts = x.reshape(len(x), m, width)
        start = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), p] for p in range(m)])
        book = cls(start.astype(np.float32))
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(len(x), m, width)
        for r in range(rounds):
            weight = 1.0 if r < rounds // 2 else parallel  # plain rounds first
            codes = book.encode(x, weight, 1)
            along = ((parts - book.centres[np.arange(m), codes]) * unit).sum(2)
            total = along.sum(1)
            for p in range(m):
                rest = total - along[:, p]
                for c in range(16):
                    own = codes[:, p] == c
                    if not own.any():
                        book.centres[p, c] = parts[rng.integers(len(x)), p]
                        continue
                    u, y = unit[own, p], parts[own, p]
                    # (I + (w - 1) u u') averaged, times the centre, equals the same of the vectors and the rest's error.
                    a = np.eye(width) * own.sum() + (weight - 1) * u.T @ u
                    b = y.sum(0) + (weight - 1) * (u * ((u * y).sum(1) + rest[own])[:, None]).sum(0)
                    book.centres[p, c] = np.linalg.solve(a, b)
                along[:, p] = ((parts[:, p] - book.centres[p, codes[:, p]]) * unit[:, p]).sum(1)
                total = rest + along[:, p]
        return book

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with pairs of centres: (bytes of a code, 256, queries)."""
        m, _, w = self.centres.shape
        t = np.einsum("qmw,mcw->mcq", _padded(q.astype(np.float32), w).reshape(len(q), m, w), self.centres)
        if m % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        return (t[1::2, :, None, :] + t[::2, None, :, :]).reshape(len(t) // 2, 256, len(q))


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % width)))


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte, the even part in the low bits."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(code: np.ndarray, tables: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its number, and its summed table entries with all coded vectors."""
    for lo in range(0, tables.shape[2], 128):
        t = np.ascontiguousarray(tables[:, :, lo : lo + 128])
        score = np.empty((t.shape[2], len(code)), np.float32)
        for a in range(0, len(code), 2048):
            part = t[0][code[a : a + 2048, 0]]
            for b in range(1, code.shape[1]):
                part += t[b][code[a : a + 2048, b]]
            score[:, a : a + 2048] = part.T
        for i, s in enumerate(score):
            yield lo + i, s


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, dimension after dimension."""
    out = np.zeros(len(x))
    for d in range(len(q)):
        out += x[:, d] * q[d]
    return out


def _leading(score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the best scores (ties: smaller ``least``) up to the k-th different ``least``; all if there are fewer."""
    size = 2 * k
    while True:
        at = np.arange(len(score))
        if size < len(score):
            at = np.flatnonzero(score >= -np.partition(-score, size - 1)[size - 1])
        at = at[np.lexsort((least[at], -score[at]))]
        _, first = np.unique(least[at], return_index=True)
        if len(first) >= k:
            return at[: np.sort(first)[k - 1] + 1]
        if len(at) == len(score):
            return at
        size *= 4


def _ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k)


def _searched(block: list[pa.RecordBatch], qs: np.ndarray, vs: np.ndarray, book: Codebook, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """The k + 1 best different ids of a block of coded vectors for each query (and all that tie within them)."""
    t = pa.Table.from_batches(block).combine_chunks()
    ids, times = t["ids"].combine_chunks(), t["times"].combine_chunks().flatten().to_numpy()
    starts, many, ids = ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py(), ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
    code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
    x, left_out = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).astype(float), t["left_out"].to_numpy()
    least, long = ids[starts], np.linalg.norm(x, axis=1) + left_out
    for lo in range(0, len(qs), 256):
        out = []
        for i, s in scan(code, book.tables(vs[lo : lo + 256])):
            q = vs[lo + i]
            length = np.linalg.norm(q)
            at = np.argpartition(-s, rerank - 1)[:rerank] if rerank < len(s) else np.arange(len(s))
            score = exact(x[at], q)
            # What may still be among them: the tables' single precision is allowed for.
            lead = _leading(score, least[at], k + 1)
            enough = len(np.unique(least[at[lead]])) > k
            may = s + length * (left_out + 1e-5 * long) >= score[lead[-1]] if enough else np.ones(len(s), bool)
            may[at] = False
            if len(more := np.flatnonzero(may)):
                near = x[more] @ q
                if enough:
                    more = more[near >= score[lead[-1]] - 1e-9 * length * long[more]]
                at, score = np.concatenate([at, more]), np.concatenate([score, exact(x[more], q)])
                lead = _leading(score, least[at], k + 1)
            at, score = at[lead], score[lead]
            each = np.repeat(at, many[at])
            own = starts[each] + np.arange(len(each)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            score = np.repeat(score, many[at])
            first = _leading(score, ids[own], k + 1)
            out.append((np.full(len(first), qs[lo + i]), ids[own[first]], times[own[first]], score[first]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], names=["q", "vec_id", "times", "s"])


def _against(coded: DataFrame, sent: Broadcast, book: Codebook, k: int, rerank: int, block: int) -> DataFrame:
    """What each block of ``coded`` holds for the queries that were sent (their numbers, their vectors). A task cuts what it reads into blocks."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            while b.num_rows:
                held.append(b.slice(0, block - n))
                n, b = n + held[-1].num_rows, b.slice(held[-1].num_rows)
                if n == block:
                    yield from _searched(held, *sent.value, book, k, rerank)
                    held, n = [], 0
        if n:
            yield from _searched(held, *sent.value, book, k, rerank)

    return batches(coded, step, FOUND)


def nearest(table: DataFrame, k: int = 20, every: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k rows of largest inner product among all others.

    Codebooks are fitted on at most ``sample`` vectors; every vector is coded, every code is scanned for every query in blocks, and the best
    ``rerank`` of each query and block are scored exactly (double precision, dimension after dimension). So are all others of the
    block whose table score, with the length of what the code leaves out of the vector, may reach the k + 1 best of these: the
    result is exact. Vectors are searched once for each distinct value, whose k + 1 smallest vec_ids stand for it, and ties go
    to the smaller vec_id. Queries that are equal are searched once. They are sent to the codes in groups of at most some QUERY_BYTES;
    vectors and codes are written once and not shuffled again, however many queries there are.

    Rows whose vector is null, empty, zero or has a null or non-finite component take no part, nor do rows with a null vec_id, nor vectors
    of another length than the most frequent one. Rows that repeat a vec_id are all its own, never its candidates, and are queries
    of their own if their vectors differ; with fewer candidates than k all are returned. An empty table gives an empty result; further columns are ignored.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & valid("v"))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], schema)
    v = v.filter(F.size("v") == size["n"]).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)))
    # The k + 1 smallest different ids of each distinct vector: first within slices of it, so that no task has all its copies.
    v = v.groupBy("v", "_salt", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    v = _ranked(v, ["v", "_salt"], [F.col("vec_id")], k + 1)
    v = _ranked(v, ["v"], [F.col("vec_id")], k + 1)
    classes = v.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "v", F.col("ids.vec_id").alias("ids"), F.col("ids.times").alias("times")), "classes")
    asked = table.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("v")).filter(F.expr(f"query_id % {every} = 0") & valid("v"))
    asked = written(asked.join(classes.select("c", "v"), "v").select("query_id", "c").distinct(), "asked")
    n, n_asked = classes.count(), asked.select("c").distinct().count()
    h = F.pmod(F.xxhash64(F.lit("fit"), "v"), F.lit(1_000_000))
    fit_on = classes.select("v", h.alias("h")).filter(F.col("h") < max(1, int(1.2e6 * sample / n) if n > sample else 1_000_000)).orderBy("h", "v").limit(sample).collect()
    if not fit_on or not n_asked:
        return spark.createDataFrame([], schema)
    book = Codebook.fit(np.array([r["v"] for r in fit_on]))

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            wide = _padded(x.astype(np.float32), book.centres.shape[2])
            codes = book.encode(wide)
            left_out = np.linalg.norm(wide.astype(float) - book.centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in packed(codes)], pa.binary()), pa.array(left_out)], names=[*b.schema.names, "code", "left_out"])

    # Codes and vectors stay where they are. Queries go out in groups of a bounded size, each of which passes over them once.
    block, groups = BLOCK, -(-n_asked // max(1, QUERY_BYTES // (8 * size["n"])))
    parts = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
    coded = written(batches(classes.repartition(parts, "c"), code, f"c long, v {dict(classes.dtypes)['v']}, ids array<long>, times array<long>, code binary, left_out double"), "coded")
    queries = classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v", F.pmod(F.xxhash64(F.lit("g"), "c"), F.lit(groups)).cast("int").alias("group"))
    at = shared_path(spark, "queries")
    queries.write.partitionBy("group").parquet(at)
    queries = spark.read.schema(queries.schema).parquet(at)
    found = shared_path(spark, "found")
    for g in range(groups):
        rows = queries.filter(F.col("group") == g).select("c", "v").toPandas()
        sent = spark.sparkContext.broadcast((rows["c"].to_numpy(), np.array(rows["v"].tolist(), float).reshape(len(rows), -1)))
        _against(coded, sent, book, k, rerank, block).write.mode("append").parquet(found)
        sent.unpersist()
    found = spark.read.schema(FOUND).parquet(found)
    for table in (classes, coded):
        dropped(table)
    removed(spark, at)
    # Own rows go out first. A row that is there more than once counts as often.
    own = asked.join(found.select(F.col("q").alias("c"), "vec_id", "times", F.col("s").alias("score")), "c").filter("vec_id <> query_id")
    own = _ranked(own, ["query_id", "c"], [F.desc("score"), F.col("vec_id")], k).drop("_rank").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return _ranked(own, ["query_id", "c"], [F.desc("score"), F.col("vec_id"), F.col("_time")], k).select("query_id", F.col("_rank").cast("int").alias("rank"), "vec_id", "score")
