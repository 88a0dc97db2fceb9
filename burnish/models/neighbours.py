"""Exact k nearest neighbours as a pruned join.

The plan follows the published Voronoi kNN join (Lu, Shen, Chen, Ooi 2012): rows are
assigned to the nearest of a bounded set of pivots; distances to pivots bound how
far the k-th neighbour of any row of a cell can be, so a training point travels
only to the cells it can matter to. Equal feature vectors are folded first: of
equal training vectors only the k lowest ids can be neighbours, and equal test
vectors have equal neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.operators.skew import attach
from burnish.session import checkpointed
from burnish.table import ROW_ID

# Fixed value: neighbours asked for.
K = 5

PIVOTS = 128
TEST_BLOCK = 2_048
TRAIN_BLOCK = 32_768

# Copies per row up to which letting all blocks meet is not worth a second thought.
PLAIN_COPIES = 8

_SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature so a pair has one value anywhere."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _fold_train(train: DataFrame, k: int) -> DataFrame:
    """Distinct vectors ``z`` with their k lowest ids and targets."""
    lowest = Window.partitionBy("z").orderBy(ROW_ID)
    kept = train.withColumn("_at", F.row_number().over(lowest)).filter(F.col("_at") <= k)
    members = F.sort_array(F.collect_list(F.struct(F.col(ROW_ID).alias("id"), F.col("label").alias("y"))))
    return kept.groupBy("z").agg(members.alias("m")).select("z", F.col("m.id").alias("ids"), F.col("m.y").alias("ys"))


def _assign(df: DataFrame, pivots: np.ndarray, extra: str = "") -> DataFrame:
    """Each row's nearest pivot and the distance to it."""

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(_distances(_matrix(pdf["z"]), pivots))
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(d)), cell])

    return df.mapInPandas(place, f"z array<double>, {extra}cell int, r double")


def _reach(points: DataFrame, rows: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test cell its radius, and a bound on the k-th distance of its rows."""
    n = len(pivots)
    radius = np.full(n, -np.inf)
    for r in rows.groupBy("cell").agg(F.max("r").alias("r")).collect():  # one row per pivot
        radius[r["cell"]] = r["r"]
    nearest = Window.partitionBy("cell").orderBy("r")
    close = points.select("cell", "r", F.size("ids").alias("copies"))
    close = close.withColumn("_at", F.row_number().over(nearest)).filter(F.col("_at") <= k)
    close = close.select("cell", "r", "copies").collect()  # at most k rows per pivot
    between = np.sqrt(_distances(pivots, pivots))
    bound = np.full(n, np.inf)
    cells = np.array([c["cell"] for c in close])
    radii = np.array([c["r"] for c in close])
    copies = np.array([c["copies"] for c in close])
    for i in range(n):
        if np.isfinite(radius[i]):
            far = radius[i] + between[i, cells] + radii
            order = np.argsort(far)
            enough = np.searchsorted(np.cumsum(copies[order]), k)
            bound[i] = far[order][enough] if enough < len(far) else np.inf
    return radius, bound


def _travel(points: DataFrame, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> DataFrame:
    """A copy of each point for every test cell it can be a neighbour in."""
    with np.errstate(invalid="ignore"):
        limit = radius + bound
    limit = np.where(np.isfinite(radius), limit + _SLACK * (1 + np.abs(limit)), -np.inf)

    def spread(batches):
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(_distances(_matrix(pdf["z"]), pivots))
                row, cell = np.nonzero(d <= limit[None, :])
                yield pdf.iloc[row].assign(cell=cell.astype("int32"))

    return points.select("z", "ids", "ys").mapInPandas(
        spread, "z array<double>, ids array<long>, ys array<double>, cell int"
    )


def _per_cell(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])[F.col("cell")]


def _nearest_in_block(k: int):
    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"z": [], "d": [], "id": [], "y": []}
        if len(left) and len(right):
            b = _matrix(right["z"])
            ids, ys = right["ids"].to_numpy(), right["ys"].to_numpy()
            a, zs = _matrix(left["z"]), left["z"].to_numpy()
            for start in range(0, len(a), 64):
                d = _distances(a[start : start + 64], b)
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                row, near = np.nonzero(d <= edge)
                many = np.array([len(ids[i]) for i in near], dtype=np.int64)
                dist, of = np.repeat(d[row, near], many), np.repeat(row, many)
                m, y = np.concatenate([ids[i] for i in near]), np.concatenate([ys[i] for i in near])
                order = np.lexsort((m, dist, of))
                of = of[order]
                first = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
                out["z"].extend(zs[start + i] for i in np.repeat(row, many)[first])
                out["d"].extend(dist[first])
                out["id"].extend(m[first])
                out["y"].extend(y[first])
        # Types are spelled out: an empty block must still read as arrays and numbers.
        kinds = {"z": object, "d": float, "id": "int64", "y": float}
        return pd.DataFrame({c: pd.Series(out[c], dtype=kinds[c]) for c in kinds})

    return pick


def _cell_counts(df: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in df.groupBy("cell").count().collect():  # one row per pivot
        out[r["cell"]] = r["count"]
    return out


def nearest(
    train: DataFrame,
    test: DataFrame,
    k: int = K,
    pivots: int = PIVOTS,
    test_block: int = TEST_BLOCK,
    train_block: int = TRAIN_BLOCK,
) -> DataFrame:
    """The k nearest training rows of each distinct test vector; ties by lowest id.

    ``train`` has ``_rowId, z, label``; ``test`` has ``z``. Returns ``z, d`` (squared
    distance), ``id, y``. Both sides are cut into blocks of bounded size; a test
    block meets a train block once and passes on only k candidates per row. Pivots
    decide which blocks need not meet. Where that saves nothing (little data, or so
    many features that everything is about equally far) all blocks meet.
    """
    points = checkpointed(_fold_train(train.select(ROW_ID, "z", F.col("label").cast("double")), k), "points")
    wanted = checkpointed(test.select("z").distinct(), "wanted")
    n_points, n_wanted = points.count(), wanted.count()
    if not n_points:
        raise ValueError("no training rows")
    cores = train.sparkSession.sparkContext.defaultParallelism
    test_block = max(1, min(test_block, -(-n_wanted // cores)))

    def blocks(n_test: np.ndarray, n_train: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Blocks of both sides in each cell, and the rows sent between tasks."""
        a = np.maximum(1, np.ceil(n_test / test_block))
        b = np.maximum(1, np.ceil(n_train / train_block))
        return a, b, float((n_test * b + n_train * a).sum())

    asked, copies = wanted.withColumn("cell", F.lit(0)), points.withColumn("cell", F.lit(0))
    a, b, sent = blocks(np.array([n_wanted]), np.array([n_points]))
    if pivots > 1 and sent > PLAIN_COPIES * (n_wanted + n_points):
        sample = points.select("z").orderBy(F.xxhash64("z")).limit(pivots).collect()
        centre = np.array([r["z"] for r in sample], dtype=float)
        placed = checkpointed(_assign(wanted, centre), "asked")
        radius, bound = _reach(_assign(points, centre, "ids array<long>, ys array<double>, "), placed, centre, k)
        pruned = _travel(points, centre, radius, bound)
        pa, pb, pruned_sent = blocks(_cell_counts(placed, len(centre)), _cell_counts(pruned, len(centre)))
        if pruned_sent < sent:
            asked, copies, a, b = placed, pruned, pa, pb

    spot = F.xxhash64("z")
    left = asked.select(
        "z", "cell", F.pmod(spot, _per_cell(a)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), _per_cell(b) - 1)).alias("chunk"),
    )
    right = copies.select(
        "z", "ids", "ys", "cell", F.pmod(spot, _per_cell(b)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), _per_cell(a) - 1)).alias("block"),
    )
    keys = ["cell", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _nearest_in_block(k), "z array<double>, d double, id long, y double"
    )
    best = Window.partitionBy("z").orderBy("d", "id")
    return found.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k).drop("_at")


def _vote(near: DataFrame) -> DataFrame:
    """The most frequent class; ties to the smallest. The score is class 1's share."""
    votes = near.groupBy("z", "y").agg(F.count("*").alias("n"))
    winner = F.max_by("y", F.struct("n", -F.col("y"))).alias("prediction")
    ones = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    return votes.groupBy("z").agg(winner, (ones / F.sum("n")).alias("score"))


def predict(train: DataFrame, test: DataFrame, classify: bool, k: int = K, **options) -> DataFrame:
    """``test`` with ``prediction`` and ``score`` columns."""
    near = nearest(train, test, k, **options)
    if classify:
        made = _vote(near)
    else:
        made = near.groupBy("z").agg(F.avg("y").alias("prediction")).withColumn("score", F.col("prediction"))
    return attach(test, made, ["z"])
