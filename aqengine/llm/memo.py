"""Runs of numbers that a worker keeps for strings it meets again, in flat arrays; and arithmetic on such runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, size[0] of them, then the same of the next."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "i" else float)])
    last = np.cumsum(sizes)
    return upto[last] - upto[last - sizes]


def flat_binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other; sizes in bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def flat_bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)


def gathered(it: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[list[pa.Array]]:
    """The columns of several batches at once, with some ``size`` bytes of the column ``text``."""
    held, n = [], 0
    for b in it:
        if b.num_rows:
            held.append(b)
            n += b.column(text % b.num_columns).nbytes
        if n >= size:
            yield [pa.concat_arrays([x.column(i) for x in held]) for i in range(held[0].num_columns)]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays([x.column(i) for x in held]) for i in range(held[0].num_columns)]


class Memo:
    """The run of numbers of each string, made once. Those of the strings most in use stay, at most ``kept`` of them."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], kept: Callable[[], int], longest: int = 64) -> None:
        """``make``: for strings a pool of numbers, and where in it each has its own and how many. ``longest``: of a kept one, in bytes."""
        self.make, self.kept, self.longest = make, kept, longest
        self.known, self.ends, self.pool, self.uses = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, values: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct strings, met so many times: a pool, and where in it each has its own numbers and how many."""
        at = pc.fill_null(pc.index_in(values, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.known) + np.arange(len(new))
        added = values.take(pa.array(new))
        pool, start, size = self.make(added)
        start, size = np.concatenate([self.ends[:-1], len(self.pool) + start]), np.concatenate([np.diff(self.ends), size])
        pool = np.concatenate([self.pool, pool])
        uses = np.concatenate([self.uses, np.zeros(len(added), np.int64)])
        uses[at] += times
        if len(added):
            self._keep(pa.concat_arrays([self.known, added]), pool, start, size, uses)
        else:
            self.uses = uses
        return pool, start[at], size[at]

    def _keep(self, values: pa.Array, pool: np.ndarray, start: np.ndarray, size: np.ndarray, uses: np.ndarray) -> None:
        keep, kept = np.flatnonzero(pc.less_equal(pc.binary_length(values), self.longest).to_numpy(zero_copy_only=False)), self.kept()
        if len(keep) > kept:  # half of them go, the least used first
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: kept // 2]])
            uses = uses // 2
        self.known, self.uses = values.take(pa.array(keep)), uses[keep]
        self.pool, self.ends = pool[places(start[keep], size[keep])], np.concatenate([[0], np.cumsum(size[keep])])
