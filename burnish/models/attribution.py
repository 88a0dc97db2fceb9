"""How much each feature moves a prediction (Shapley values)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.functions.hashing import mix
from burnish.models import tree_shap
from burnish.models.prep import FEATURES, LABEL, SEED, hash_order
from burnish.models.train import TrainResult
from burnish.operators.rank import renumber
from burnish.table import ROW_ID

# Fixed value: features in the summary.
TOP = 7

PERMUTATIONS = 16


def _rows(df: DataFrame, rows: int | None, width: int) -> DataFrame:
    """All rows, or the first in split order if a number is given; features as an array."""
    dense = "_z0" in df.columns
    z = F.array(*[F.col(f"_z{i}") for i in range(width)]) if dense else vector_to_array(FEATURES)
    chosen = df if rows is None else df.orderBy(*hash_order()).limit(rows)
    return chosen.select(ROW_ID, z.alias("z"))


def linear_attribution(r: TrainResult, rows: int | None = None, background: int | None = None) -> DataFrame:
    """Weight times distance from the background mean: exact for a linear model.

    Explains every held-out row against all training rows; ``rows`` and ``background``
    limit either.
    """
    w = r.learned.weights
    if w is None:
        raise ValueError(f"{r.model} is not linear")
    names = F.array(*[F.lit(n) for n in r.design.names])
    base = _rows(r.train, background, r.design.width)
    means = base.agg(Summarizer.metrics("mean").summary(array_to_vector("z")).alias("s"))
    means = means.select(F.posexplode(vector_to_array("s.mean")).alias("i", "mean"))  # one row per feature
    weights = F.array(*[F.lit(float(v)) for v in w])
    centre = None
    if r.scaling and not r.scaling.centred:  # values are told as deviations from the mean
        shifts = F.array(*[F.lit(m / s if s > 0 else m) for m, s in zip(r.scaling.means, r.scaling.spreads)])
        centre = shifts[F.col("i")]
    told = _rows(r.test, rows, r.design.width).select(ROW_ID, F.posexplode("z").alias("i", "value"))
    return told.join(F.broadcast(means), "i").select(
        ROW_ID,
        names[F.col("i")].alias("feature"),
        (F.col("value") - centre if centre is not None else F.col("value")).alias("value"),
        (weights[F.col("i")] * (F.col("value") - F.col("mean"))).alias("phi"),
    )


def tree_attribution(r: TrainResult, rows: int | None = None) -> DataFrame:
    """Shapley values of a tree or forest from its own nodes: exact, no background rows.

    Those of a row add up to its score less the mean score of the training rows, as the
    trees saw them. Explains every held-out row; ``rows`` limits them.
    """
    if r.learned.trees is None:
        raise ValueError(f"{r.model} has no trees")
    names = F.array(*[F.lit(n) for n in r.design.names])
    told, _ = tree_shap.explain(_rows(r.test, rows, r.design.width), "z", r.learned.trees, r.task == "classification")
    return told.select(ROW_ID, F.posexplode("phi").alias("i", "phi")).select(ROW_ID, names[F.col("i")].alias("feature"), "phi")


def sampled_attribution(
    r: TrainResult,
    rows: int | None = None,
    background: int | None = None,
    permutations: int = PERMUTATIONS,
    seed: int = SEED,
) -> DataFrame:
    """Shapley values of any model by sampled orderings (Strumbelj and Kononenko 2014).

    Every explained row is turned, feature by feature in a random order, from a
    background row into itself; all in-between rows are scored in one pass of the
    model, and a feature earns the score change of its step. The values of a row
    add up to its score less the mean score of the backgrounds it drew. Every held-out
    row is explained and backgrounds are drawn from all training rows; ``rows`` and
    ``background`` limit either, ``permutations`` sets how many orders are drawn.
    """
    width = r.design.width
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(width) for _ in range(permutations)]
    order = F.array(*[F.array(*[F.lit(int(j)) for j in o]) for o in orders])
    rank = F.array(*[F.array(*[F.lit(int(j)) for j in np.argsort(o)]) for o in orders])
    names = F.array(*[F.lit(n) for n in r.design.names])

    base = renumber(_rows(r.train, background, width))
    drawable = base.agg(F.count("*")).scalar()
    told = _rows(r.test, rows, width).select(
        F.col(ROW_ID).alias("row"), "z", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p")
    )
    drawn = F.pmod(mix(F.col("row") * permutations + F.col("p"), seed), drawable) + 1
    told = told.withColumn("drawn", drawn).join(base.select(F.col(ROW_ID).alias("drawn"), F.col("z").alias("b")), "drawn")
    mixed = told.select("row", "p", "z", "b", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("s"))
    place = F.element_at(rank, F.col("p") + 1)
    hybrid = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.when(F.get(place, j) < F.col("s"), F.get(F.col("z"), j)).otherwise(F.get(F.col("b"), j)),
    )
    asked = mixed.withColumn("_hybrid", hybrid).select(
        F.col("row").alias(ROW_ID), "p", "s", F.lit(0.0).alias(LABEL), array_to_vector("_hybrid").alias(FEATURES),
    )
    scored = r.learned.predict(asked).select(F.col(ROW_ID).alias("row"), "p", "s", "score")
    steps = Window.partitionBy("row", "p").orderBy("s")
    gains = scored.withColumn("gain", F.col("score") - F.lag("score").over(steps)).filter("s > 0")
    feature = F.element_at(F.element_at(order, F.col("p") + 1), F.col("s"))
    mean = gains.withColumn("i", feature).groupBy("row", "i").agg(F.avg("gain").alias("phi"))
    return mean.select(F.col("row").alias(ROW_ID), names[F.col("i")].alias("feature"), "phi")


def attribution(r: TrainResult, rows: int | None = None, **options) -> DataFrame:
    """The exact forms for linear models and trees, the sampled one for the rest."""
    if r.learned.weights is not None:
        return linear_attribution(r, rows, **options).drop("value")
    if r.learned.trees is not None and not options:
        return tree_attribution(r, rows)
    return sampled_attribution(r, rows, **options)


def attribution_summary(phi: DataFrame, k: int = TOP) -> DataFrame:
    """The features with the largest mean absolute value."""
    mean = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return mean.orderBy(F.desc("mean_abs"), "feature").limit(k)
