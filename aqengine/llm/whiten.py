"""Operator 12: whitening of vectors along their leading components, by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

# What entries are scaled and shifted by.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors carried along beside the wanted ones; the residual, as a part of the largest eigenvalue, at which a component is certified; how much more a filter may raise one
#: vector than another; its largest degree; rounds before more vectors are carried.
GUARD, CERTIFIED, RAISED, DEGREE, ROUNDS = 16, 1e-13, 1e8, 14, 12
#: Entries beyond this have no place in the scaled numbers; entries of a block of vectors.
LARGEST, BLOCK = 2.0**40, 1 << 18
FOUND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Scaled:
    """The scaled vectors in blocks of rows, and what is known of all: their number, dimension and sums."""

    blocks: DataFrame
    n: int
    dim: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        """A whole number near each mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the means have beyond ``base``."""
        return np.array([s % self.n for s in self.sums], np.int64)


def scaled(embeddings: DataFrame) -> Scaled:
    """Whole vectors as floor(1024 c) + 100000, in blocks. Vectors of another length than most have (ties: the shorter) or with an entry beyond 2**40 take no part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = embeddings.select("vec_id", x.alias("e")).filter(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
    first = fine.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = first["dim"] if first else 1
    rows = max(1, BLOCK // dim)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                entries = np.floor(part["e"].flatten().to_numpy() * SCALE).astype(np.int64) + SHIFT
                sums = entries.reshape(-1, dim).sum(0)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["vec_id"].cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([entries.tobytes()], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["ids", "x", "sums"])

    blocks = written(batches(fine.filter(F.size("e") == dim), step, "ids array<long>, x binary, sums array<long>", rows), "vectors")
    n = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect() if n else []
    return Scaled(blocks.drop("sums"), n, dim, [int(r["s"]) for r in sums])


def _cells(data: Scaled, make) -> np.ndarray:
    """The sum over all blocks of what ``make`` gives for a block of centred vectors (an array of one shape): combined by cell in the cluster."""
    base, rest = data.base, data.rest / data.n

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            for x in b["x"]:
                z = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(base)) - base) - rest
                own = make(z)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    rows = batches(data.blocks.select("x"), step, "cell int, v double", 16).groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    return rows.sort_values("cell")["v"].to_numpy()


def times(data: Scaled, q: np.ndarray) -> np.ndarray:
    """Covariance times ``q``: one pass over all vectors, as X'(Xq), centred before multiplying."""
    return _cells(data, lambda z: z.T @ (z @ q)).reshape(q.shape) / data.n


def rayleigh_ritz(q: np.ndarray, aq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best eigenvalues (falling), vectors and residuals' lengths that the orthonormal columns of ``q`` allow."""
    h = q.T @ aq
    e, w = np.linalg.eigh((h + h.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    u = q @ w
    return e, u, np.linalg.norm(aq @ w - u * e, axis=0)


def filtered(data: Scaled, u: np.ndarray, locked: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """Chebyshev's polynomial of the covariance times ``u``: small between low and high, fast growing above. ``locked`` vectors stay out of it."""
    mid, half = (high + low) / 2, (high - low) / 2
    out = lambda y: y - locked @ (locked.T @ y)
    before, now = u, out((times(data, u) - mid * u) / half)
    for _ in range(degree - 1):
        before, now = now, out(2 * (times(data, now) - mid * now) / half - before)
    return now


def components(data: Scaled, k: int = COMPONENTS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns), each certified by its residual.

    A block of k + GUARD vectors starts from two steps of a Krylov space, which also bounds the unwanted part of the spectrum. Each round filters the vectors that aren't
    certified yet and takes Ritz vectors anew. If ROUNDS rounds don't do, the block doubles, at last to all dimensions, where one step is exact.
    """
    d = data.dim
    k, block = min(k, d), min(d, k + GUARD)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    if block < d:
        aq = times(data, q)
        q = np.linalg.qr(np.hstack([q, aq])) [0][:, : min(d, 2 * block)]
    e, u, r = rayleigh_ritz(q, times(data, q))
    low = max(0.0, float(e[-1] - r[-1]))
    e, u, r = e[:block], u[:, :block], r[:block]
    rounds = 0
    while block < d and not (r[:k] <= CERTIFIED * e[0]).all():
        if rounds == ROUNDS:
            block, rounds = min(d, 2 * block), 0
            more = rng.standard_normal((d, block - u.shape[1]))
            q = np.linalg.qr(np.hstack([u, more]))[0]
            e, u, r = rayleigh_ritz(q, times(data, q))
            continue
        rounds += 1
        done = int(np.argmin(np.append(r[:k] <= CERTIFIED * e[0], False)))  # the leading ones that are certified
        locked, rest, high = u[:, :done], u[:, done:], float(e[-1])
        if high <= low:
            low = 0.0
        if high - low <= 1e-12 * e[0]:  # nothing to damp: all that is left is one eigenvalue
            q = rest
        else:
            reach = np.arccosh(max(1 + 1e-12, (e[done] - (high + low) / 2) / ((high - low) / 2)))
            q = filtered(data, rest, locked, low, high, int(np.clip(np.arccosh(RAISED) / reach, 2, DEGREE)))
        q = np.linalg.qr(np.hstack([locked, q / np.maximum(np.linalg.norm(q, axis=0), 1e-300)]))[0]
        e, u, r = rayleigh_ritz(q, times(data, q))
    return e[:k], u[:, :k]


def _deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n x - S)², exact; null where a long can't hold it."""
    small = x - base
    if x.shape[1] * (n * float(np.abs(small).max(initial=0)) + n) ** 2 < 2.0**62:
        return ((n * small - rest) ** 2).sum(1).tolist()
    each = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in small]
    return [v if v < 2**63 else None for v in each]


def whitened(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component.

    Vectors that are null, or hold null or non-finite entries, are dropped, as are those that ``scaled`` names; rows with a null or repeated vec_id are rows like any other,
    and equal vectors count as often as they come. There are no more components than dimensions; along one without variance (a hundred-billionth of the whole or less) all
    are 0, which identity_error then shows as 1. An empty table gives an empty result. Further columns are ignored.
    """
    data = scaled(embeddings)
    if not data.n:
        return embeddings.sparkSession.createDataFrame([], FOUND)
    n, base, rest = data.n, data.base, data.rest
    trace = float(_cells(data, lambda z: np.array([(z * z).sum()]))[0]) / n
    e, u = components(data, k)
    k = len(e)
    flat = e <= 1e-11 * trace
    along = np.where(flat, 0.0, u / np.sqrt(np.where(flat, 1.0, e)))
    sums = _cells(data, lambda z: np.vstack([(w := z @ along).sum(0), w.T @ w])).reshape(k + 1, k) / n
    error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max())
    explained = np.where(flat, 0.0, e) / trace if trace else np.zeros(k)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, x in zip(b["ids"], b["x"], strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(base))
                m = len(x)
                values = ((x - base) - rest / n) @ along
                each = lambda v: v.take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        each(ids.values), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), each(pa.array(_deviations(x, n, base, rest), pa.int64())), pa.array(values.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return batches(data.blocks, step, FOUND, 16)
