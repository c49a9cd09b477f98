"""Distributed sums of arrays and a randomised SVD over rows that stay on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slices an array travels in, so that no message or reducer holds whole arrays of all tasks.
SLICES = 64


def summed(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], np.ndarray]], size: int) -> np.ndarray:
    """Sum over all partitions of one float64 array of ``size`` each.

    ``make()`` returns the function from a partition's batches to its array. Each slice is added up
    on one reducer as it streams in; the driver receives ``size`` numbers, whatever the input.
    """
    bounds = np.linspace(0, size, SLICES + 1).astype(int)

    def part(batches):
        values = np.asarray(make()(batches), dtype=np.float64).reshape(-1)
        for i in range(SLICES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([values[bounds[i]:bounds[i + 1]].tobytes()], pa.binary())], ["slice", "values"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw)
                total[i] = total[i] + x if i in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                             ["slice", "values"])

    schema = "slice int, values binary"
    out = np.zeros(size)
    for i, raw in df.mapInArrow(part, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect():
        out[bounds[i]:bounds[i + 1]] += np.frombuffer(raw)
    return out


def right_singular(df: DataFrame, blocks: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]], width: int,
                   rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (width x rank, float32) of the matrix whose row blocks the
    partitions yield: a randomised SVD in one pass.

    Every task adds up X'(X O) for the same random width x (rank + 8) matrix O; of the sum Y, the
    Nystrom approximation Y (O'Y)^-1 Y' of X'X is factored on the driver. Only Y leaves the executors.
    """
    cols = rank + 8

    def make():
        fn = blocks()

        def total(batches):
            probe = np.random.default_rng(seed).standard_normal((width, cols)).astype(np.float32)
            y = np.zeros((width, cols))
            for x in fn(batches):
                y += x.T @ (x @ probe)
            return y
        return total

    y = summed(df, make, width * cols).reshape(width, cols)
    probe = np.random.default_rng(seed).standard_normal((width, cols)).astype(np.float32).astype(np.float64)
    core = probe.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((width, rank), np.float32)
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    out = np.zeros((width, rank), np.float32)
    out[:, :min(rank, u.shape[1])] = u[:, :rank]
    return out
