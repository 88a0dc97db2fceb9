"""From table to model input: complete cases, encoding, split and scaling."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.functions.cells import TEMPORAL, col, fresh
from burnish.functions.hashing import PRIME, mix
from burnish.table import NUMERIC, ROW_ID, PrepTable

# Fewest rows to train on, and the seed of every random choice.
MIN_ROWS = 5
SEED = 42

# Design columns up to which each is a column of the table; more make sparse vectors.
DENSE_WIDTH = 256
# Labels up to which a label's position is looked up in an array; more are joined.
FEW_LABELS = 256

_SPLIT_CELLS = 65_536
_SPLIT_WIDTH = -(-PRIME // _SPLIT_CELLS)

LABEL = "label"
FEATURES = "features"


def check_inputs(t: PrepTable, features: list[str], target: str) -> list[str]:
    features = [f for f in features if f != ROW_ID]
    if not features:
        raise ValueError("select at least one feature column")
    if target in features:
        raise ValueError("the target cannot be a feature")
    t.require(*features, target)
    t.require_row_ids()
    return features


def complete_cases(t: PrepTable, features: list[str], target: str) -> PrepTable:
    """Rows that hold every feature and the target."""
    names = [*features, target]
    df = t.df.select(ROW_ID, *[col(c) for c in names]).dropna(subset=["`" + c.replace("`", "``") + "`" for c in names])
    return t.with_df(df, dense=False)


def split_flag(df: DataFrame, ratio: float, seed: int = SEED) -> Column:
    """Whether a row is in the training part: exactly ``floor(ratio * n)`` rows are.

    Rows are ranked by a hash of their id. Counting the hash range in 65,536 cells
    finds the cell the boundary lies in, and only that cell (1/65,536 of the rows)
    is ordered; every other row is placed by comparing two numbers.
    """
    ids = df.select(F.col(ROW_ID).alias("id"), mix(F.col(ROW_ID), seed).alias("h"))
    ids = ids.withColumn("cell", F.floor(F.col("h") / F.lit(_SPLIT_WIDTH)))
    counts = ids.groupBy("cell").agg(F.count("*").alias("n"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = counts.withColumn("end", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(everything))
    need = F.floor(F.lit(float(ratio)) * F.col("total"))
    edge = (
        ends.filter((F.col("end") >= need) & (F.col("end") - F.col("n") < need))
        .select(F.struct("cell", (need - F.col("end") + F.col("n")).alias("rest")))
        .scalar()
    )
    within = ids.filter(F.col("cell") == edge.getField("cell"))
    place = F.row_number().over(Window.orderBy("h", "id"))
    last = within.withColumn("at", place).filter(F.col("at") == edge.getField("rest"))
    last = last.select(F.struct("h", "id")).scalar()
    h = mix(F.col(ROW_ID), seed)
    at = last.getField("h")
    return F.coalesce((h < at) | ((h == at) & (F.col(ROW_ID) <= last.getField("id"))), F.lit(False))


def hash_order(seed: int = SEED) -> list[Column]:
    """The order the split ranks rows in; its head stands for 'the first rows'."""
    return [mix(F.col(ROW_ID), seed), F.col(ROW_ID)]


@dataclass(frozen=True)
class Design:
    """What a model reads: numbers as they are, and texts by label, without the first one."""

    plain: tuple[tuple[str, Column], ...]
    encoded: tuple[tuple[str, tuple[str, ...]], ...]

    @cached_property
    def names(self) -> tuple[str, ...]:
        return (*[n for n, _ in self.plain], *[f"{n}_{v}" for n, labels in self.encoded for v in labels[1:]])

    @property
    def columns(self) -> tuple[Column, ...]:
        """An expression for each name."""
        ones = [(col(n) == F.lit(v)).cast("double") for n, labels in self.encoded for v in labels[1:]]
        return (*[c for _, c in self.plain], *ones)

    @property
    def width(self) -> int:
        return len(self.names)


def _labels(df: DataFrame, name: str) -> list[str]:
    """Distinct texts in order. A model has a weight for each, so they reach the driver as it does."""
    found = df.select(col(name).cast("string").alias("v")).distinct().collect()
    return sorted(r["v"] for r in found)


def design(t: PrepTable, features: list[str]) -> Design:
    """Numbers and booleans as they are; text one-hot without its first label."""
    plain, encoded = [], []
    for name in features:
        dtype = t.dtype(name)
        if isinstance(dtype, T.StringType):
            labels = _labels(t.df, name)
            if len(labels) > 1:
                encoded.append((name, tuple(labels)))
        elif isinstance(dtype, TEMPORAL):
            plain.append((name, F.unix_micros(col(name).cast("timestamp")).cast("double") / 1e6))
        else:
            plain.append((name, t.number(name)))
    if not plain and not encoded:
        raise ValueError("the features hold one value each; there is nothing to learn from")
    return Design(tuple(plain), tuple(encoded))


def with_position(df: DataFrame, name: str, labels: list[str] | tuple[str, ...], into: str) -> DataFrame:
    """The rows with the position of a text among labels, from 0, as a double."""
    if len(labels) <= FEW_LABELS:
        at = F.array_position(F.array(*[F.lit(v) for v in labels]), col(name).cast("string")) - 1
        return df.withColumn(into, at.cast("double"))
    (key,) = fresh(df.columns, "_key")
    known = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(labels)], f"{key} string, {into} double")
    return df.join(known, col(name).cast("string") == F.col(key), "left").drop(key)


def sparse_design(df: DataFrame, d: Design, into: str) -> DataFrame:
    """The rows with their design as one sparse vector."""
    names = [f"_p{i}" for i in range(len(d.plain))]
    df = df.select("*", *[c.alias(n) for n, (_, c) in zip(names, d.plain)])
    at, ones, sizes = [], [], []
    for k, (name, labels) in enumerate(d.encoded):
        df = with_position(df, name, labels, f"_at{k}")
        # the encoder leaves the last position out: that is the first label's here
        df = df.withColumn(f"_at{k}", F.pmod(F.col(f"_at{k}") - 1, F.lit(float(len(labels)))))
        at.append(f"_at{k}")
        ones.append(f"_one{k}")
        sizes.append(float(len(labels) - 1))
    if at:
        largest = df.sparkSession.createDataFrame([tuple(sizes)], ", ".join(f"{c} double" for c in at))
        df = OneHotEncoder(inputCols=at, outputCols=ones, dropLast=True).fit(largest).transform(df)
    return VectorAssembler(inputCols=[*names, *ones], outputCol=into).transform(df).drop(*names, *at, *ones)


def one_hot(t: PrepTable, features: list[str]) -> DataFrame:
    """The design matrix as named columns beside the row id."""
    d = design(t, features)
    return t.df.select(ROW_ID, *[c.alias(n) for n, c in zip(d.names, d.columns)])


def class_labels(t: PrepTable, target: str) -> list[str]:
    return _labels(t.df, target)


def encode_label(t: PrepTable, target: str, labels: list[str]) -> Column:
    """The position of a class among the sorted classes, from 0."""
    names = F.array(*[F.lit(v) for v in labels])
    return (F.array_position(names, t.text(target)) - 1).cast("double")


def numeric_target(t: PrepTable, target: str) -> Column:
    """The target as a number; 0 where it is none."""
    return F.coalesce(t.number(target), F.lit(0.0))


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation of each feature over the training rows."""

    means: tuple[float, ...]
    spreads: tuple[float, ...]
    centred: bool = True  # sparse features are divided only, which keeps their zeros

    def apply(self, i: int, x: Column) -> Column:
        spread = self.spreads[i]
        centred = x - F.lit(self.means[i])
        return centred / F.lit(spread) if spread > 0 else centred


def fit_scaling(df: DataFrame, width: int) -> Scaling:
    aggs = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(width)]
    aggs += [F.stddev_pop(f"_x{i}").alias(f"s{i}") for i in range(width)]
    r = df.agg(*aggs).first()
    return Scaling(
        tuple(float(r[f"m{i}"]) for i in range(width)), tuple(float(r[f"s{i}"] or 0.0) for i in range(width))
    )


def fit_sparse_scaling(df: DataFrame, vector: str) -> Scaling:
    """The same from vectors, in one pass."""
    r = df.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")).first().s
    spreads = np.sqrt(r.variance.toArray() * (max(r["count"] - 1, 0) / r["count"]))
    return Scaling(tuple(r.mean.toArray().tolist()), tuple(spreads.tolist()), centred=False)


def sparse_scaled(df: DataFrame, scaling: Scaling | None, vector: str) -> DataFrame:
    """The vectors of features divided by their deviations, beside id and label."""
    if scaling is None:
        return df.select(ROW_ID, LABEL, F.col(vector).alias(FEATURES))
    weights = DenseVector([1.0 / s if s > 0 else 1.0 for s in scaling.spreads])
    return ElementwiseProduct(scalingVec=weights, inputCol=vector, outputCol=FEATURES).transform(df).select(ROW_ID, LABEL, FEATURES)


def scale_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Standardise columns on all rows of ``df`` in one lazy plan."""
    stats = df.agg(
        F.struct(
            *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(names)],
        )
    ).scalar()
    out = []
    for c in df.columns:
        if c not in names:
            out.append(col(c))
            continue
        i = names.index(c)
        centred, spread = col(c) - stats.getField(f"m{i}"), stats.getField(f"s{i}")
        out.append(F.when(spread > 0, centred / spread).otherwise(centred).alias(c))
    return df.select(*out)


def scaled(df: DataFrame, scaling: Scaling | None, width: int) -> DataFrame:
    """Feature columns ``_z*`` and their vector, beside id and label."""
    zs = [
        (scaling.apply(i, F.col(f"_x{i}")) if scaling else F.col(f"_x{i}")).alias(f"_z{i}") for i in range(width)
    ]
    out = df.select(ROW_ID, LABEL, *zs)
    return VectorAssembler(inputCols=[f"_z{i}" for i in range(width)], outputCol=FEATURES).transform(out)


def task_of(model: str, t: PrepTable, target: str) -> str:
    """Classification or regression, by the model's name or else the target's kind."""
    from burnish.models.train import CLASSIFIERS, REGRESSORS

    if model in CLASSIFIERS:
        return "classification"
    if model in REGRESSORS:
        return "regression"
    return "classification" if t.kind(target) != NUMERIC else "regression"

