"""Exact tree attributions against all subsets of features, and their sums."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.models import attribution, train
from burnish.models.tree_shap import leaves_of, mean_score, node_table, tree_values
from burnish.table import ROW_ID, PrepTable


def known_mean(nodes, x, known, classify, at=0):
    """What a tree gives when only some features are known, straight from its nodes."""
    stats, left, right, feature, threshold = nodes[at]
    weight = (lambda s: sum(s)) if classify else (lambda s: s[0])
    if left < 0:
        return (stats[1 if len(stats) == 2 else 0] / sum(stats)) if classify else stats[1] / stats[0]
    if feature in known:
        return known_mean(nodes, x, known, classify, left if x[feature] <= threshold else right)
    sides = [(weight(nodes[k][0]), known_mean(nodes, x, known, classify, k)) for k in (left, right)]
    return sum(w * v for w, v in sides) / sum(w for w, _ in sides)


def by_subsets(nodes, x, width, classify):
    out = []
    for j in range(width):
        others, phi = [k for k in range(width) if k != j], 0.0
        for s in range(width):
            for some in combinations(others, s):
                gain = known_mean(nodes, x, {*some, j}, classify) - known_mean(nodes, x, set(some), classify)
                phi += gain * factorial(s) * factorial(width - 1 - s) / factorial(width)
        out.append(phi)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1, 401):
        a, b, c, d = (float(v) for v in np.round(rng.normal(size=4), 1))
        y = 3 * a * (b > 0) + c**2 + rng.normal() * 0.1
        rows.append((i, a, b, c, d, float(y), "hi" if y > 2 else "lo" if y < 0 else "mid", "p" if y > 1 else "q"))
    return PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, a double, b double, c double, d double, y double, k string, k2 string"), dense=True)


CASES = [
    ("tree_reg", "y", {"depth": 4}), ("forest_reg", "y", {"trees": 5, "depth": 4}), ("tree_class", "k", {"depth": 4}),
    ("tree_class", "k2", {"depth": 3}), ("forest_class", "k2", {"trees": 4, "depth": 5}), ("forest_class", "k", {"trees": 3, "depth": 3}),
]


@pytest.mark.parametrize(("model", "target", "params"), CASES)
def test_values_are_those_of_all_subsets_and_add_up(table, model, target, params):
    r = train(table, model, ["a", "b", "c", "d"], target, params=params)
    classify = r.task == "classification"
    spark = table.df.sparkSession
    nodes = node_table(spark, r.learned.trees)
    trees = [leaves_of(n, classify) for n in nodes]
    z = F.array(*[F.col(f"_z{i}") for i in range(4)])
    rows = r.test.select(ROW_ID, z.alias("z")).orderBy(ROW_ID).collect()
    x = np.array([row.z for row in rows])
    phi = tree_values(x, trees)
    for i in range(0, len(x), 9):
        want = np.mean([by_subsets(n, x[i], 4, classify) for n in nodes], axis=0)
        assert phi[i] == pytest.approx(want, abs=1e-9)
    scores = dict(r.predictions.select(ROW_ID, "score").collect())
    assert phi.sum(axis=1) + mean_score(trees) == pytest.approx([scores[row[ROW_ID]] for row in rows], abs=1e-6)
    told = {(t[ROW_ID], t.feature): t.phi for t in attribution.attribution(r).collect()}
    assert len(told) == 4 * len(rows)
    for i, row in enumerate(rows):
        assert [told[row[ROW_ID], f] for f in "abcd"] == pytest.approx(phi[i].tolist(), abs=1e-12)
    r.release()


def test_a_tree_without_splits_explains_nothing(spark):
    rows = [(i, float(i % 7), 1.0) for i in range(1, 60)]
    t = PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, a double, y double"), dense=True)
    r = train(t, "tree_reg", ["a"], "y")
    assert {row.phi for row in attribution.tree_attribution(r).collect()} == {0.0}
    with pytest.raises(ValueError, match="has no trees"):
        attribution.tree_attribution(train(t, "linear", ["a"], "y"))
