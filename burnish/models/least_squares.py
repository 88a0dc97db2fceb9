"""Least squares over sparse rows by conjugate gradients.

Each round reads the rows once and needs one product of the centred feature matrix with
its own transpose, summed over partitions. Features come scaled to unit deviation, which
is the usual diagonal preconditioner. The rounds end when the residual of the normal
equations has all but vanished, so results are those of solving them directly.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.models.prep import FEATURES, LABEL

#: Residual over right-hand side at which the rounds end, and the most rounds.
TOLERANCE, MAX_ROUNDS = 1e-13, 2_000
#: Partial sums that the driver adds up at most; more are added by tasks first.
SUMS = 32


@dataclass(frozen=True)
class Solution:
    """Weights and intercept, with the rounds taken and the relative residual left."""

    weights: np.ndarray
    intercept: float
    rounds: int
    residual: float


def entries(rows: DataFrame) -> DataFrame:
    """Label, positions and values of each row's features."""
    v = F.unwrap_udt(F.col(FEATURES))
    dense = F.sequence(F.lit(0), F.size(v["values"]) - F.lit(1))
    return rows.select(F.col(LABEL).alias("y"), F.coalesce(v["indices"], dense).alias("at"), v["values"].alias("x"))


def product(told: DataFrame, width: int, v: np.ndarray | None, less: float = 0.0, partitions: int = 1) -> np.ndarray:
    """The transposed feature matrix times itself times v, or times the labels, and less the same times ``less``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            n, lists = batch.num_rows, batch.column("x")
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            at, x = batch.column("at").flatten().to_numpy(), lists.flatten().to_numpy()
            y = batch.column("y").to_numpy() if v is None else np.bincount(row, weights=x * v[at], minlength=n)
            total += np.bincount(at, weights=x * (y - less)[row], minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    sums = told.mapInArrow(part, "s binary")
    if partitions > SUMS:
        sums = sums.repartition(SUMS).mapInArrow(add, "s binary")
    out = np.zeros(width)
    for r in sums.toLocalIterator():
        out += np.frombuffer(r.s)
    return out


def solve(
    rows: DataFrame,
    width: int,
    means: np.ndarray,
    alpha: float = 0.0,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    partitions: int = 1,
) -> Solution:
    """Weights that minimise squared errors plus ``alpha`` times the squared weights; the intercept is free.

    ``means`` are the features' means over ``rows``. Features that never vary get weight
    0. The residual carried along is checked against the true one before the rounds end.
    Warns if ``max_rounds`` end before it is down to ``tolerance``.
    """
    told = entries(rows)
    n, label = told.agg(F.count("*").alias("n"), F.avg("y").alias("m")).first()

    def gram(v: np.ndarray) -> np.ndarray:
        # every product is of rows less their mean, so that nothing large cancels out
        centre = float(means @ v)
        return product(told, width, v, centre, partitions) + alpha * v

    b = product(told, width, None, label, partitions)
    w, r, rounds = np.zeros(width), b.copy(), 0
    p, size, whole = r.copy(), float(r @ r), float(b @ b)
    goal, before = tolerance**2 * whole, np.inf
    while size > goal and rounds < max_rounds:
        q = gram(p)
        step = size / float(p @ q)
        w += step * p
        r -= step * q
        now = float(r @ r)
        p, size, rounds = r + (now / size) * p, now, rounds + 1
        if size <= goal and rounds < max_rounds:
            r = b - gram(w)
            size = float(r @ r)
            if size >= before:  # as near as numbers of this precision come
                break
            p, before = r.copy(), size
    residual = float(np.sqrt(size / whole)) if whole > 0 else 0.0
    if residual > max(tolerance, 1e-9):
        warnings.warn(f"least squares stopped after {rounds} rounds with a relative residual of {residual:.1e}", stacklevel=2)
    return Solution(w, float(label - means @ w), rounds, residual)
