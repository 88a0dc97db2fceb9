"""Correlations of many columns in one scan, by masked cross products of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# For each two columns, over the rows that hold both: rows, means and squared deviations
# of the one and the other, cross deviations, and rows where either is infinite.
ROWS, MEAN, MEAN_2, SQUARES, SQUARES_2, CROSS, INFINITE = range(7)


def block(values: np.ndarray) -> np.ndarray:
    """What a block of rows tells; missing values are NaN.

    Values are taken less the first of their column, so that large means cancel nothing.
    """
    missing, endless = np.isnan(values), np.isinf(values)
    here, plain = (~missing).astype(float), ~missing & ~endless
    first = np.where(plain.any(0), values[plain.argmax(0), np.arange(values.shape[1])], 0.0)
    x = np.where(plain, values, first) - first
    n, total, squares = here.T @ here, x.T @ here, (x * x).T @ here
    known = np.maximum(n, 1)
    left = squares - total**2 / known
    # below what the sums can tell from no spread at all
    left = np.where(left > squares * n * np.finfo(float).eps, left, 0.0)
    mean, beyond = first[:, None] + total / known, endless.astype(float).T @ here
    return np.array([n, mean, mean.T, left, left.T, x.T @ x - total * total.T / known, beyond + beyond.T])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two sets of rows tell together, for any part of the pairs."""
    out = a + b
    share = b[ROWS] / np.maximum(out[ROWS], 1)
    weight = a[ROWS] * share
    both = (a[ROWS] > 0) & (b[ROWS] > 0)
    apart, apart_2 = (np.where(both, b[m] - a[m], 0.0) for m in (MEAN, MEAN_2))
    for m, gap in ((MEAN, apart), (MEAN_2, apart_2)):
        out[m] = np.where(a[ROWS] > 0, a[m] + gap * share, b[m])
    out[SQUARES] += apart**2 * weight
    out[SQUARES_2] += apart_2**2 * weight
    out[CROSS] += apart * apart_2 * weight
    return out


def wide_correlation(values: DataFrame, names: list[str]) -> DataFrame:
    """``a, b, r`` for every two of the double columns of ``values``, which ``names`` names in order.

    A task keeps seven square matrices as wide as there are columns, whatever its rows.
    They are added up by column, so no task and not the driver holds those of others whole.
    Without spread there is no correlation (null); infinite values make it NaN.
    """
    p = len(names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (
            block(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            for batch in batches
            if batch.num_rows
        )
        told = reduce(merge, blocks, np.zeros((7, p, p)))
        for i in range(p):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([told[:, i].tobytes()], pa.binary())], names=["i", "s"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column("i").to_pylist(), batch.column("s")):
                told = np.frombuffer(s.as_py()).reshape(7, p)
                kept[i] = merge(kept[i], told) if i in kept else told
        for i, told in kept.items():
            flat, endless = (told[SQUARES] <= 0) | (told[SQUARES_2] <= 0), told[INFINITE] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                r = told[CROSS] / (np.sqrt(told[SQUARES]) * np.sqrt(told[SQUARES_2]))
            r[i] = 1.0
            cells = pc.if_else(pa.array(endless), float("nan"), pa.array(r, mask=flat))
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * p), pa.array(names), cells], names=["a", "b", "r"])

    return values.mapInArrow(part, "i int, s binary").repartition("i").mapInArrow(finish, "a string, b string, r double")
