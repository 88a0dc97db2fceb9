"""Kernel machines on landmarks: the hinge and the epsilon-insensitive loss, with a duality gap.

Landmarks (Nyström) stand for the kernel: a row's features are its similarities to a few
training rows, turned so that inner products give the kernel again. They are chosen from
a bounded number of rows by pivoted Cholesky, each being the row that those before it
explain least. If they explain all rows, the machine is the kernel machine itself.

The loss has corners. It is rounded by barriers whose weight shrinks, and each rounded
problem is solved by Newton steps. A step needs one pass over the rows: every task adds up the
loss, its slopes and curvatures, a vector and a matrix as wide as the landmarks. The
slopes are also a candidate for the dual problem, so each pass bounds how far the loss
without rounding is from its least value; the fit ends when that gap is small enough.

Machines of several classes take their steps side by side: a pass makes the features of a
row once and adds up the sums of all machines that still ask for one.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.hashing import mix
from burnish.models.least_squares import SUMS, entries
from burnish.models.prep import FEATURES
from burnish.table import ROW_ID

#: Rows that landmarks are chosen from, for each landmark wanted.
CANDIDATES = 4
#: What is left of a candidate's kernel below which it counts as explained.
EXPLAINED = 1e-10
#: Duality gap over the objective at which a fit ends, and the most passes over the rows.
GAP, MAX_PASSES = 1e-3, 300
#: A rounded problem counts as solved if its gap is so many times the one that its rounding
#: leaves; the next is rounded so much less.
SOLVED, SHRINK = 1.5, 10.0
#: Numbers of a working matrix in a task.
SLICE = 2_000_000
#: Machines that share a pass at most; each has a matrix as wide as the landmarks in every task.
TOGETHER = 8

#: What a pass is asked for: how many sums, and the function that gives them for features and labels.
Asked = tuple[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Landmarks:
    """Chosen rows over the columns they use, and the turn that makes features of similarities.

    ``uncovered`` is the mean share of a candidate's kernel that the landmarks leave open.
    """

    columns: np.ndarray
    points: np.ndarray
    gamma: float
    root: np.ndarray
    uncovered: float
    width: int

    def similarities(self, at: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The kernel between rows, given as entries, and the landmarks."""
        n, m = len(counts), len(self.points)
        row = np.repeat(np.arange(n), counts)
        if len(self.columns) == self.width and (counts == self.width).all():
            dots = x.reshape(n, self.width) @ self.points.T
        else:
            dots = np.zeros((n, m))
            place = np.minimum(np.searchsorted(self.columns, at), max(len(self.columns) - 1, 0))
            met = self.columns[place] == at if len(self.columns) else np.zeros(len(at), bool)
            if met.any():
                rows, parts = row[met], self.points.T[place[met]] * x[met, None]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                dots[rows[starts]] = np.add.reduceat(parts, starts, axis=0)
        own = np.bincount(row, weights=x * x, minlength=n)
        apart = own[:, None] + (self.points**2).sum(1)[None, :] - 2 * dots
        return np.exp(-self.gamma * np.maximum(apart, 0.0))

    def slices(self, at: np.ndarray, x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Similarities for runs of rows that keep working matrices small."""
        counts = np.diff(offsets)
        widest = max(int(counts.max(initial=1)), 1) if not (counts == self.width).all() else 1
        step = max(1, SLICE // (max(len(self.points), 1) * widest))
        for lo in range(0, len(counts), step):
            run = slice(lo, min(lo + step, len(counts)))
            cut = slice(offsets[run.start], offsets[run.stop])
            yield run, self.similarities(at[cut], x[cut], counts[run])


@dataclass(frozen=True)
class Machine:
    """One fitted machine: its value at a row is ``similarities @ weights + intercept``."""

    weights: np.ndarray
    intercept: float
    objective: float
    gap: float
    passes: int


def choose(rows: DataFrame, width: int, gamma: float, count: int) -> Landmarks:
    """Up to ``count`` landmarks from ``CANDIDATES`` times as many rows, those of the least hashed ids."""
    drawn = rows.select(ROW_ID, "label", FEATURES).orderBy(mix(F.col(ROW_ID)), ROW_ID).limit(CANDIDATES * count)
    told = [(np.array(r.at, dtype=int), np.array(r.x, dtype=float)) for r in entries(drawn).collect()]
    columns = np.unique(np.concatenate([at for at, _ in told]))
    points = np.zeros((len(told), len(columns)))
    for i, (at, x) in enumerate(told):
        points[i, np.searchsorted(columns, at)] = x
    norms = (points**2).sum(1)

    def kernel(i: int) -> np.ndarray:
        return np.exp(-gamma * np.maximum(norms + norms[i] - 2 * points @ points[i], 0.0))

    left, factors, chosen = np.ones(len(points)), np.zeros((len(points), 0)), []
    while len(chosen) < min(count, len(points)) and left.max() > EXPLAINED:
        i = int(left.argmax())
        factor = (kernel(i) - factors @ factors[i]) / np.sqrt(left[i])
        factors = np.column_stack([factors, factor])
        left = np.maximum(left - factor**2, 0.0)
        left[i] = 0.0
        chosen.append(i)
    kept = points[chosen]
    used = np.flatnonzero((kept != 0).any(0)) if len(columns) < width else np.arange(len(columns))
    values, vectors = np.linalg.eigh(np.array([kernel(i)[chosen] for i in chosen]))
    good = values > values.max() * 1e-12
    root = vectors[:, good] / np.sqrt(values[good])
    return Landmarks(columns[used], kept[:, used], gamma, root, float(left.mean()), width)


def _added(told: DataFrame, marks: Landmarks, asked: list[Asked], partitions: int) -> list[np.ndarray]:
    """For all that is asked, the sums over every run of rows; a 1 follows each row's features."""
    k = marks.root.shape[1]
    cuts = np.cumsum([0, *[size for size, _ in asked]]).tolist()
    size, few = cuts[-1], max(SUMS // len(asked), 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            lists, y = batch.column("x"), batch.column("y").to_numpy()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at, x = batch.column("at").flatten().to_numpy(), lists.flatten().to_numpy()
            for run, near in marks.slices(at, x, offsets):
                z = np.ones((len(near), k + 1))
                z[:, :k] = near @ marks.root
                for (_, of), a, b in zip(asked, cuts, cuts[1:]):
                    total[a:b] += of(z, y[run])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    sums = told.mapInArrow(part, "s binary")
    if partitions > few:
        sums = sums.repartition(few).mapInArrow(add, "s binary")
    whole = np.sum([np.frombuffer(r.s) for r in sums.collect()], axis=0)  # at most SUMS rows of one machine's size
    return np.split(whole, cuts[1:-1])


def _round(excess: np.ndarray, over: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A smooth stand-in for what exceeds 0: its value, slope and curvature.

    It is the least cost of a slack that logarithmic barriers of weight ``over`` keep
    above 0 and above the excess, which Newton steps cope with well.
    """
    less = 2 * over / (np.sqrt(excess**2 + 4 * over**2) + 2 * over + np.abs(excess))
    slope, rest = np.where(excess < 0, less, 1 - less), np.where(excess < 0, 1 - less, less)
    value = over / rest - over * (2 * np.log(over) - np.log(rest) - np.log(slope))
    return value, slope, (slope * rest) ** 2 / (slope**2 + rest**2) / over


def _loss(y: np.ndarray, f: np.ndarray, epsilon: float | None, over: float) -> tuple[np.ndarray, ...]:
    """For each row the loss, the rounded loss, its slope away from ``f`` and its curvature.

    With ``epsilon`` values may be that far from the label; without, labels are 1 and -1
    and values must reach 1 on their side.
    """
    if epsilon is None:
        excess = 1 - y * f
        value, slope, bend = _round(excess, over)
        return np.maximum(excess, 0.0), value, slope * y, bend
    above, below = _round(y - f - epsilon, over), _round(f - y - epsilon, over)
    exact = np.maximum(np.abs(y - f) - epsilon, 0.0)
    return exact, above[0] + below[0], above[1] - below[1], above[2] + below[2]


@dataclass(frozen=True)
class _Place:
    """What a pass tells of one setting of the weights."""

    at: np.ndarray
    primal: float
    rounded: float
    dual: float
    slope: np.ndarray
    curve: np.ndarray


def _look(at: np.ndarray, over: float, c: float, epsilon: float | None) -> Generator[Asked, np.ndarray, _Place]:
    k = len(at) - 1

    def of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        exact, soft, pull, bend = _loss(y, z @ at, epsilon, over)
        up, down = np.maximum(pull, 0.0), np.minimum(pull, 0.0)
        few = [exact.sum(), soft.sum(), y @ up, y @ down]
        bent = z * np.sqrt(bend)[:, None]  # a matrix times its own transpose costs half a product
        return np.concatenate([few, up @ z, down @ z, (bent.T @ bent).ravel()])

    s = (yield 4 + 2 * (k + 1) + (k + 1) ** 2, of) * c
    loss, soft, y_up, y_down = s[:4]
    up, down = s[4 : 5 + k], s[5 + k : 6 + 2 * k]
    curve = s[6 + 2 * k :].reshape(k + 1, k + 1)
    curve[:k, :k] += np.eye(k)
    free = np.r_[at[:k], 0.0]
    weight = at[:k] @ at[:k] / 2
    # The dual wants both sides to pull alike; the stronger one is scaled down.
    even = min(up[k], -down[k])
    a = even / up[k] if up[k] > 0 else 0.0
    b = even / -down[k] if down[k] < 0 else 0.0
    both = a * up[:k] + b * down[:k]
    dual = a * y_up + b * y_down - (epsilon or 0.0) * 2 * even - both @ both / 2
    return _Place(at, weight + loss, weight + soft, dual, free - up - down, curve)


def _step(here: _Place, move: np.ndarray, over: float, c: float, epsilon: float | None) -> Generator[Asked, np.ndarray, float]:
    """The best of thirty halvings of a step, all tried in one pass."""
    k, sizes = len(move) - 1, 0.5 ** np.arange(30)

    def of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        f, g = z @ here.at, z @ move
        return np.array([_loss(y, f + s * g, epsilon, over)[1].sum() for s in sizes])

    found = (yield len(sizes), of) * c
    found += [((here.at[:k] + s * move[:k]) ** 2).sum() / 2 for s in sizes]
    return float(sizes[found.argmin()]) if found.min() < here.rounded else 0.0


def _solve(
    marks: Landmarks, n: int, mean: float, spread: float, c: float, epsilon: float | None, gap: float, max_passes: int
) -> Generator[Asked, np.ndarray, Machine]:
    """One machine's steps; each pass over the rows is asked for and answered by sums."""
    k = marks.root.shape[1]
    over = 1.0 if epsilon is None else max(spread, epsilon, 1e-12)
    settings = (c, epsilon)
    here = yield from _look(np.r_[np.zeros(k), 0.0 if epsilon is None else mean], over, *settings)
    best, bound, passes = here, here.dual, 1
    # an objective of next to nothing (a constant target) has no share to speak of
    goal = lambda: gap * max(best.primal, 1e-9 * c * n)
    barriers = (2 if epsilon is None else 4) * c * n  # the gap that a rounding leaves, over its weight
    while best.primal - bound > goal() and passes < max_passes:
        there = None
        if here.primal - here.dual > SOLVED * barriers * over:
            move = -np.linalg.lstsq(here.curve, here.slope, rcond=1e-14)[0]
            there, passes = (yield from _look(here.at + move, over, *settings)), passes + 1
            if there.rounded > here.rounded + 1e-4 * float(here.slope @ move):
                size = yield from _step(here, move, over, *settings)
                there = (yield from _look(here.at + size * move, over, *settings)) if size else None
                passes += 2 if size else 1
        if there is None:  # this rounding is solved
            over = max(over / SHRINK, goal() / (4 * barriers)) if over > goal() / (2 * barriers) else over / 2
            there, passes = (yield from _look(here.at, over, *settings)), passes + 1
        here = there
        best = min(best, here, key=lambda p: p.primal)
        bound = max(bound, here.dual)
    left = best.primal - bound
    if left > goal():
        warnings.warn(f"a kernel machine stopped after {passes} passes with a duality gap of {left:.3g} at {best.primal:.6g}", stacklevel=2)
    return Machine(marks.root @ best.at[:k], float(best.at[k]), best.primal, max(left, 0.0), passes)


def _against(own: float, asked: Asked) -> Asked:
    """What is asked, with labels of 1 for a class and -1 for all others."""
    size, of = asked
    return size, lambda z, y: of(z, np.where(y == own, 1.0, -1.0))


def _side_by_side(told: DataFrame, marks: Landmarks, solving: list[Generator], classes: list[float | None], partitions: int) -> list[Machine]:
    """Machines solved with one pass for all that ask."""
    done: list[Machine | None] = [None] * len(solving)
    asked = {i: next(g) for i, g in enumerate(solving)}
    while asked:
        turned = [a if classes[i] is None else _against(classes[i], a) for i, a in asked.items()]
        sums, asked = dict(zip(asked, _added(told, marks, turned, partitions))), {}
        for i, found in sums.items():
            try:
                asked[i] = solving[i].send(found)
            except StopIteration as end:
                done[i] = end.value
    return done


def fit(
    rows: DataFrame,
    marks: Landmarks,
    c: float = 1.0,
    epsilon: float | None = None,
    partitions: int = 1,
    gap: float = GAP,
    max_passes: int = MAX_PASSES,
    classes: list[float] | None = None,
) -> Machine | list[Machine]:
    """Minimise half the squared weights plus ``c`` times the summed loss; the intercept is free.

    ``epsilon`` gives regression; without it labels are 1 and -1. With ``classes`` there is
    a machine for each of those labels against all others, up to TOGETHER of them in a pass.
    Warns if ``max_passes`` end before the duality gap is down to ``gap`` times the objective.
    """
    told = entries(rows)
    told_of = told.agg(F.count("*"), F.avg("y"), F.stddev_pop("y")).first()
    mine = [None] if classes is None else classes
    fitted = []
    for a in range(0, len(mine), TOGETHER):
        some = mine[a : a + TOGETHER]
        solving = [_solve(marks, *told_of, c, epsilon, gap, max_passes) for _ in some]
        fitted += _side_by_side(told, marks, solving, some, partitions)
    return fitted[0] if classes is None else fitted


def values(df: DataFrame, marks: Landmarks, machines: list[Machine], out: str) -> DataFrame:
    """Add an array with every machine's value at each row."""
    weights = np.column_stack([m.weights for m in machines])
    intercepts = np.array([m.intercept for m in machines])
    v = F.unwrap_udt(F.col(FEATURES))
    at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - F.lit(1)))

    @F.pandas_udf("array<double>")
    def value(at: pd.Series, x: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=object)
        offsets = np.r_[0, np.cumsum([len(i) for i in at])]
        ats, xs = np.concatenate(at.to_numpy()).astype(int), np.concatenate(x.to_numpy())
        return pd.Series([r for _, near in marks.slices(ats, xs, offsets) for r in near @ weights + intercepts])

    return df.withColumn(out, value(at, v["values"]))
