"""Exact Shapley values of trees and forests, with the covers of their own nodes.

What a tree gives when only some features are known is the mean over its leaves, each
branch on an unknown feature weighted by the training rows that took it. For one leaf
that is a product with a factor per feature on its path: 1 or 0, whether the row's value
lies in the interval that the path leaves the feature, if it is known, and the path's
share of rows if not. The Shapley values of such a product depend on a row only through
the pattern of those ones and zeros, so they are worked out once for each pattern that
occurs and looked up for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.session import scratch_path


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and, for each feature of its path, the interval (low, high] and the share of rows."""

    value: float
    cover: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(spark: SparkSession, model) -> list[dict[int, tuple]]:
    """The nodes of each tree: id to (statistics, left, right, feature, threshold); as large as the model."""
    path = scratch_path(spark, "model")
    model.save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    split = "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories"
    trees: dict[int, dict] = {}
    for r in data.select("treeID", "id", "impurityStats", "leftChild", "rightChild", *split).collect():
        if r.leftChild >= 0 and r.numCategories != -1:
            raise ValueError("a tree that splits categories is not explained; encode them as numbers")
        threshold = r.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else None
        trees.setdefault(r.treeID, {})[r.id] = (r.impurityStats, r.leftChild, r.rightChild, r.featureIndex, threshold)
    return [trees[k] for k in sorted(trees)]


def leaves_of(nodes: dict[int, tuple], classify: bool) -> list[Leaf]:
    """The leaves of one tree with their paths merged by feature."""

    def weight(stats: list[float]) -> float:
        return sum(stats) if classify else stats[0]

    def value(stats: list[float]) -> float:
        # a classifier's score: the share of class 1, or of the first class where there are more than two
        return stats[1 if len(stats) == 2 else 0] / sum(stats) if classify else stats[1] / stats[0]

    out, todo = [], [(0, {})]
    whole = weight(nodes[0][0])
    while todo:
        at, path = todo.pop()
        stats, left, right, feature, threshold = nodes[at]
        if left < 0:
            keys = sorted(path)
            edges = [path[k] for k in keys]
            columns = [np.array([e[i] for e in edges], dtype=float) for i in range(3)]
            out.append(Leaf(value(stats), weight(stats) / whole, np.array(keys, dtype=int), *columns))
            continue
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        own = weight(stats)
        todo.append((left, {**path, feature: (low, min(high, threshold), share * weight(nodes[left][0]) / own)}))
        todo.append((right, {**path, feature: (max(low, threshold), high, share * weight(nodes[right][0]) / own)}))
    return out


def pattern_values(inside: np.ndarray, share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of a leaf's product for patterns (rows) of features (columns) that hold or not."""
    n, m = inside.shape
    weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.empty((n, m))
    for j in range(m):
        # coefficients by the number of known features among the others
        sums = np.zeros((n, m))
        sums[:, 0] = 1
        for k in range(m):
            if k != j:
                known = np.zeros((n, m))
                known[:, 1:] = sums[:, :-1] * inside[:, k : k + 1]
                sums = sums * share[k] + known
        out[:, j] = value * (inside[:, j] - share[j]) * (sums @ weights)
    return out


def tree_values(x: np.ndarray, trees: list[list[Leaf]]) -> np.ndarray:
    """Shapley values of the mean of some trees for rows of features; they add up to score less mean score."""
    out = np.zeros(x.shape)
    for leaves in trees:
        for leaf in leaves:
            if not len(leaf.features):
                continue
            own = x[:, leaf.features]
            inside = (own > leaf.low) & (own <= leaf.high)
            patterns, which = np.unique(np.packbits(inside, axis=1), axis=0, return_inverse=True)
            bits = np.unpackbits(patterns, axis=1, count=inside.shape[1]).astype(float)
            out[:, leaf.features] += pattern_values(bits, leaf.share, leaf.value)[which.reshape(-1)]
    return out / len(trees)


def mean_score(trees: list[list[Leaf]]) -> float:
    """The score when no feature is known."""
    return sum(leaf.value * leaf.cover for leaves in trees for leaf in leaves) / len(trees)


def explain(rows: DataFrame, features: str, model, classify: bool) -> tuple[DataFrame, float]:
    """The rows with ``phi``, an array of Shapley values beside the array ``features``; and the mean score."""
    trees = [leaves_of(nodes, classify) for nodes in node_table(rows.sparkSession, model)]

    @F.pandas_udf("array<double>")
    def values(z: pd.Series) -> pd.Series:
        return pd.Series(list(tree_values(np.stack(z.to_numpy()), trees)) if len(z) else [])

    return rows.withColumn("phi", values(F.col(features))), mean_score(trees)
