"""Designs of many labels: sparse rows give the models that dense ones give."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.models import attribution, least_squares, prep, train
from burnish.table import ROW_ID, PrepTable

import sys

trainer = sys.modules["burnish.models.train"]


def table(spark, n, labels, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1, n + 1):
        k, a, b = int(rng.integers(labels)), float(rng.normal()), float(rng.normal() * 100 + 7)
        y = 0.3 * (k % 11) - a + 0.01 * b + float(rng.normal()) * 0.2
        rows.append((i, f"k{k:05d}", a, b, y, "yes" if y > 1 else "no"))
    return PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, k string, a double, b double, y double, c string"), dense=True)


FEATURES = ["k", "a", "b"]


@pytest.mark.parametrize("model", ["linear", "ridge", "logistic", "tree_reg", "knn_reg"])
def test_sparse_rows_give_the_dense_model(spark, monkeypatch, model):
    t = table(spark, 600, 30)
    target = "c" if model == "logistic" else "y"
    params = {"max_iter": 200} if model == "logistic" else None
    dense = train(t, model, FEATURES, target, params=params)
    monkeypatch.setattr(prep, "DENSE_WIDTH", 5)
    monkeypatch.setattr(prep, "FEW_LABELS", 5)
    monkeypatch.setattr(trainer, "SOLVED_WIDTH", 5)
    wide = train(t, model, FEATURES, target, params=params)
    assert wide.design.names == dense.design.names and "_z0" not in wide.test.columns
    near = lambda r, c: dict(r.predictions.select(ROW_ID, c).collect())
    assert near(wide, "score") == pytest.approx(near(dense, "score"), abs=1e-4 if model == "logistic" else 1e-6)
    if model in ("linear", "ridge"):
        weights = lambda r: {x.term: x.weight for x in r.coefficients().collect()}
        assert weights(wide) == pytest.approx(weights(dense), abs=1e-6)
        assert wide.learned.report["residual"] <= 1e-10
        told = lambda r: {(x[ROW_ID], x.feature): (x.value, x.phi) for x in attribution.linear_attribution(r, rows=20).collect()}
        a, b = told(wide), told(dense)
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-6)


def test_many_labels_train_in_seconds(spark):
    t = table(spark, 20_000, 12_000)
    start = time.perf_counter()
    r = train(t, "ridge", FEATURES, "y")
    assert r.design.width > 9_000 and r.metrics().first().r2 > 0.3
    assert r.learned.report["residual"] <= 1e-10
    assert time.perf_counter() - start < 60


def test_many_classes_are_learned(spark):
    t = table(spark, 3_000, 400)
    r = train(t, "naive_bayes", ["a", "b"], "k")
    assert len(r.labels) > prep.FEW_LABELS
    assert r.predictions.filter(F.col("label").isNull()).count() == 0


def test_rounds_that_end_too_soon_are_told(spark, monkeypatch):
    t = table(spark, 400, 50)
    monkeypatch.setattr(prep, "DENSE_WIDTH", 5)
    rows = train(t, "linear", FEATURES, "y").train
    with pytest.warns(UserWarning, match="stopped after 1 rounds"):
        found = least_squares.solve(rows, 51, np.zeros(51), max_rounds=1)
    assert found.rounds == 1 and found.residual > 1e-10
