"""Train one of twelve models on a table and evaluate it on held-out rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from burnish.functions.cells import fresh
from burnish.models import kernel, least_squares, machines, metrics, neighbours, prep
from burnish.models.prep import FEATURES, LABEL, SEED
from burnish.table import ROW_ID, PrepTable

CLASSIFIERS = ("logistic", "knn_class", "tree_class", "forest_class", "svm_class", "naive_bayes")
REGRESSORS = ("linear", "ridge", "knn_reg", "tree_reg", "forest_reg", "svm_reg")
MODELS = (*CLASSIFIERS, *REGRESSORS)

# Settings a model is trained with unless told otherwise.
DEFAULTS = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "logistic": {"C": 1.0, "max_iter": 1000},
    "knn_class": {"k": 5},
    "knn_reg": {"k": 5},
    "tree_class": {"depth": 5},
    "tree_reg": {"depth": 5},
    "forest_class": {"trees": 100, "depth": 6},
    "forest_reg": {"trees": 100, "depth": 6},
    "svm_class": {"C": 1.0, "width": kernel.WIDTH},
    "svm_reg": {"C": 1.0, "epsilon": 0.1, "width": kernel.WIDTH},
    "naive_bayes": {},
}
TRAIN_RATIO = 0.8
TOP_FEATURES = 10

CELLS_PER_PARTITION = 8_000_000

# Design columns up to which least squares are solved in one pass from the normal equations,
# a matrix on the driver; more go to conjugate gradients, which end at the same weights.
SOLVED_WIDTH = 512

Score = Callable[[DataFrame], DataFrame]


@dataclass
class Learned:
    """A fitted model: how it predicts, and its weight per feature if it has any."""

    predict: Score
    weights: list[float] | None = None
    intercept: float | None = None
    importances: list[float] | None = None
    trees: object | None = None  # the model, where it is one of trees
    report: dict | None = None  # how an iterative fit ended


@dataclass
class TrainResult:
    """A trained model with its data, predictions and evaluation, all lazy."""

    model: str
    task: str
    design: prep.Design
    scaling: prep.Scaling | None
    labels: list[str]
    learned: Learned
    train: DataFrame
    test: DataFrame
    params: dict = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    @cached_property
    def predictions(self) -> DataFrame:
        """``_rowId, label, prediction, score`` of the held-out rows, scored once."""
        out = self.learned.predict(self.test).select(ROW_ID, LABEL, "prediction", "score")
        self.kept.append(out.persist(StorageLevel.MEMORY_AND_DISK))
        return out

    @property
    def binary(self) -> bool:
        return self.task == "classification" and len(self.labels) == 2

    def split_counts(self) -> DataFrame:
        train = self.train.agg(F.count("*").alias("train_rows"))
        return train.select(
            F.lit(self.model).alias("model"), F.lit(self.task).alias("task"), "train_rows",
            self.test.agg(F.count("*")).scalar().alias("test_rows"),
        )

    def metrics(self) -> DataFrame:
        if self.task == "classification":
            return metrics.classification(self.predictions)
        return metrics.regression(self.predictions)

    def confusion_matrix(self, zeros: bool = True) -> DataFrame:
        return metrics.confusion(self.predictions, zeros)

    def roc_curve(self) -> DataFrame:
        if not self.binary:
            raise ValueError("a ROC curve needs a target with two classes")
        return metrics.roc_curve(self.predictions)

    def roc_auc(self) -> DataFrame:
        if not self.binary:
            raise ValueError("a ROC curve needs a target with two classes")
        return metrics.roc_auc(self.predictions)

    def actual_vs_predicted(self) -> DataFrame:
        return metrics.actual_vs_predicted(self.predictions)

    def importances(self, k: int = TOP_FEATURES) -> DataFrame:
        """The features that weigh most; no rows for a model without weights."""
        values = self.learned.importances
        spark = self.train.sparkSession
        rows = [] if values is None else list(zip(self.design.names, [float(v) for v in values]))
        out = spark.createDataFrame(rows, "feature string, importance double")
        return out.orderBy(F.desc("importance"), "feature").limit(k)

    def coefficients(self) -> DataFrame:
        """Weights in the units of the features, with the intercept, for linear models."""
        w, b = self.learned.weights, self.learned.intercept
        if w is None or b is None:
            raise ValueError(f"{self.model} has no coefficients")
        rows = []
        for i, name in enumerate(self.design.names):
            mean, spread = (self.scaling.means[i], self.scaling.spreads[i]) if self.scaling else (0.0, 1.0)
            weight = float(w[i]) / spread if spread > 0 else 0.0
            b -= weight * mean if self.scaling and self.scaling.centred else 0.0
            rows.append((name, weight))
        rows.append(("intercept", float(b)))
        return self.train.sparkSession.createDataFrame(rows, "term string, weight double")

    def release(self) -> None:
        for df in (self.train, self.test, *self.kept):
            df.unpersist()


def _class_score(df: DataFrame) -> DataFrame:
    """Probability of class 1, or of the first class when there are more than two."""
    p = vector_to_array("probability")
    return df.withColumn("score", F.when(F.size(p) == 2, p[1]).otherwise(p[0]))


def _value_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.col("prediction"))


def _ml(model, classify: bool, weights=None, intercept=None, importances=None) -> Learned:
    finish = _class_score if classify else _value_score
    return Learned(lambda df: finish(model.transform(df)), weights, intercept, importances)


def _least_squares(train: DataFrame, width: int, alpha: float, partitions: int) -> Learned:
    """Wide designs, over sparse rows; the model is what the normal equations give."""
    means = train.agg(Summarizer.metrics("mean").summary(F.col(FEATURES)).alias("s")).first().s.mean.toArray()
    found = least_squares.solve(train, width, means, alpha, partitions=partitions)
    w = found.weights

    def predict(df: DataFrame) -> DataFrame:
        v = F.unwrap_udt(F.col(FEATURES))
        at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - F.lit(1)))

        @F.pandas_udf("double")
        def score(at: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series([float(w[i] @ z) + found.intercept for i, z in zip(at, x)], dtype=float)

        return _value_score(df.withColumn("prediction", score(at, v["values"])))

    return Learned(predict, w.tolist(), found.intercept, np.abs(w).tolist(), report={"rounds": found.rounds, "residual": found.residual})


def _fit_linear(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    if width > SOLVED_WIDTH:
        return _least_squares(train, width, 0.0, p["partitions"])
    model = mr.LinearRegression(regParam=0.0, solver="normal").fit(train)
    w = list(model.coefficients)
    return _ml(model, False, w, model.intercept, [abs(v) for v in w])


def _fit_ridge(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    if width > SOLVED_WIDTH:
        return _least_squares(train, width, p["alpha"], p["partitions"])
    # Spark divides the target by its deviation before it applies the penalty.
    spread = train.agg(F.stddev_pop(LABEL)).first()[0]
    model = mr.LinearRegression(regParam=p["alpha"] * spread / n, elasticNetParam=0.0, standardization=False, solver="normal").fit(train)
    w = list(model.coefficients)
    return _ml(model, False, w, model.intercept, [abs(v) for v in w])


def _fit_logistic(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    model = mc.LogisticRegression(
        regParam=1.0 / (p["C"] * n), elasticNetParam=0.0, standardization=False, maxIter=p["max_iter"]
    ).fit(train)
    first = list(model.coefficientMatrix.toArray()[0])
    return _ml(model, True, first, float(model.interceptVector[0]), [abs(v) for v in first])


def _tree(estimator, classify: bool) -> Callable:
    def fit(train: DataFrame, n: int, width: int, p: dict) -> Learned:
        model = estimator(p).fit(train)
        learned = _ml(model, classify, importances=list(model.featureImportances.toArray()))
        learned.trees = model
        return learned

    return fit


def _fit_naive_bayes(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    return _ml(mc.NaiveBayes(modelType="gaussian").fit(train), True)


def _knn(classify: bool) -> Callable:
    def fit(train: DataFrame, n: int, width: int, p: dict) -> Learned:
        known = train.select(ROW_ID, LABEL, vector_to_array(FEATURES).alias("z"))

        def predict(df: DataFrame) -> DataFrame:
            asked = df.withColumn("z", vector_to_array(FEATURES))
            return neighbours.predict(known, asked, classify, p["k"]).drop("z")

        return Learned(predict)

    return fit


def _gamma(train: DataFrame, width: int, scaled: bool) -> float:
    if "_z0" not in train.columns:
        r = train.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(FEATURES)).alias("s")).first().s
        spreads = np.sqrt(r.variance.toArray() * (max(r["count"] - 1, 0) / r["count"]))
        return kernel.default_gamma(spreads.tolist(), [0.0] * width if scaled else r.mean.toArray().tolist())
    r = train.agg(
        *[F.stddev_pop(f"_z{i}").alias(f"s{i}") for i in range(width)],
        *[F.avg(f"_z{i}").alias(f"m{i}") for i in range(width)],
    ).first()
    return kernel.default_gamma([r[f"s{i}"] for i in range(width)], [r[f"m{i}"] for i in range(width)])


def _landmarks(train: DataFrame, width: int, p: dict) -> machines.Landmarks:
    return machines.choose(train, width, _gamma(train, width, p["scaled"]), p["width"])


def _machine_report(marks: machines.Landmarks, fitted: list[machines.Machine]) -> dict:
    return {
        "objective": [m.objective for m in fitted],
        "gap": [m.gap for m in fitted],
        "passes": [m.passes for m in fitted],
        "uncovered": marks.uncovered,
        "gamma": marks.gamma,
    }


def _fit_svm_class(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    """One machine for two classes, else one for each class against the others."""
    marks = _landmarks(train, width, p)
    classes = int(train.agg(F.max(LABEL)).first()[0]) + 1
    mine = [1.0] if classes <= 2 else [float(i) for i in range(classes)]
    fitted = machines.fit(train, marks, p["C"], partitions=p["partitions"], classes=mine)
    report = _machine_report(marks, fitted)
    if classes > 2:

        def predict(df: DataFrame) -> DataFrame:
            v = F.col("_values")
            out = machines.values(df, marks, fitted, "_values")
            return _value_score(out.withColumn("prediction", (F.array_position(v, F.array_max(v)) - 1).cast("double"))).drop("_values")

    else:
        margins = machines.values(train, marks, fitted, "_values")
        known = margins.select(array_to_vector("_values").alias(FEATURES), LABEL).persist(StorageLevel.MEMORY_AND_DISK)
        sigmoid = mc.LogisticRegression(maxIter=100).fit(known)
        known.unpersist()
        slope, shift = float(sigmoid.coefficients[0]), float(sigmoid.intercept)

        def predict(df: DataFrame) -> DataFrame:
            margin = F.col("_values")[0]
            out = machines.values(df, marks, fitted, "_values").withColumn("prediction", F.when(margin > 0, 1.0).otherwise(0.0))
            return out.withColumn("score", 1 / (1 + F.exp(-(margin * slope + shift)))).drop("_values")

    return Learned(predict, report=report)


def _fit_svm_reg(train: DataFrame, n: int, width: int, p: dict) -> Learned:
    marks = _landmarks(train, width, p)
    machine = machines.fit(train, marks, p["C"], p["epsilon"], partitions=p["partitions"])

    def predict(df: DataFrame) -> DataFrame:
        out = machines.values(df, marks, [machine], "_values")
        return _value_score(out.withColumn("prediction", F.col("_values")[0])).drop("_values")

    return Learned(predict, report=_machine_report(marks, [machine]))


FITS = {
    "linear": _fit_linear,
    "ridge": _fit_ridge,
    "logistic": _fit_logistic,
    "knn_class": _knn(True),
    "knn_reg": _knn(False),
    "tree_class": _tree(lambda p: mc.DecisionTreeClassifier(maxDepth=p["depth"], impurity="gini", seed=SEED), True),
    "tree_reg": _tree(lambda p: mr.DecisionTreeRegressor(maxDepth=p["depth"], seed=SEED), False),
    "forest_class": _tree(
        lambda p: mc.RandomForestClassifier(
            numTrees=p["trees"], maxDepth=p["depth"], featureSubsetStrategy="sqrt", seed=SEED
        ),
        True,
    ),
    "forest_reg": _tree(
        lambda p: mr.RandomForestRegressor(
            numTrees=p["trees"], maxDepth=p["depth"], featureSubsetStrategy="all", seed=SEED
        ),
        False,
    ),
    "svm_class": _fit_svm_class,
    "svm_reg": _fit_svm_reg,
    "naive_bayes": _fit_naive_bayes,
}


def _partitions(spark, rows: int, width: int) -> int:
    """At least one per core, at most a few million cells each."""
    by_size = -(-rows * (width + 2) // CELLS_PER_PARTITION)
    return max(spark.sparkContext.defaultParallelism, by_size)


def train(
    t: PrepTable,
    model: str,
    features: list[str],
    target: str,
    ratio: float = TRAIN_RATIO,
    params: dict | None = None,
    seed: int = SEED,
    scale: bool = True,
) -> TrainResult:
    """Prepare, split, scale and fit, over all complete rows.

    Prepared rows are kept (memory, then disk) because fitting passes over them
    many times; ``release()`` lets them go.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    unknown = set(params or {}) - set(DEFAULTS[model])
    if unknown:
        raise ValueError(f"unknown settings for {model}: {sorted(unknown)}")
    settings = {**DEFAULTS[model], **(params or {})}
    features = prep.check_inputs(t, features, target)
    cases = prep.complete_cases(t, features, target)
    rows = cases.df.count()
    if rows < prep.MIN_ROWS:
        raise ValueError(f"too few rows to train on: {rows} complete rows")
    task = prep.task_of(model, t, target)
    design = prep.design(cases, features)
    labels: list[str] = []
    if task == "classification":
        labels = prep.class_labels(cases, target)
        (at,) = fresh(cases.df.columns, "_class")
        cases = cases.with_df(prep.with_position(cases.df.withColumn(at, cases.text(target)), at, labels, at + "_at"), dense=False)
        label = F.col(at + "_at")
    else:
        label = prep.numeric_target(cases, target)

    sparse = design.width > prep.DENSE_WIDTH
    base = prep.sparse_design(cases.df, design, "_x") if sparse else cases.df
    xs = ["_x"] if sparse else [c.alias(f"_x{i}") for i, c in enumerate(design.columns)]
    flagged = base.select(ROW_ID, label.alias(LABEL), *xs, prep.split_flag(cases.df, ratio, seed).alias("_train"))
    # Fitting passes over these rows many times, so it pays to spread them evenly once.
    entries = len(design.plain) + len(design.encoded) if sparse else design.width
    spread = _partitions(t.df.sparkSession, rows, entries)
    flagged = flagged.repartition(spread, ROW_ID).persist(StorageLevel.MEMORY_AND_DISK)
    known = flagged.filter("_train")
    n = known.count()
    if n == 0 or n == rows:
        raise ValueError(f"a ratio of {ratio} leaves no rows to train on or to test")
    unknown = flagged.filter(~F.col("_train"))
    if sparse:
        scaling = prep.fit_sparse_scaling(known, "_x") if scale else None
        parts = [prep.sparse_scaled(part, scaling, "_x") for part in (known, unknown)]
    else:
        scaling = prep.fit_scaling(known, design.width) if scale else None
        parts = [prep.scaled(part, scaling, design.width) for part in (known, unknown)]
    train_rows, test_rows = (part.persist(StorageLevel.MEMORY_AND_DISK) for part in parts)
    learned = FITS[model](train_rows, n, design.width, {**settings, "scaled": scale, "partitions": spread})
    return TrainResult(model, task, design, scaling, labels, learned, train_rows, test_rows, settings, [flagged])
