"""Kernel machines against the dual problem solved by pairs on the whole kernel matrix."""

import warnings

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from burnish.models import machines, train
from burnish.models.prep import FEATURES
from burnish.table import ROW_ID, PrepTable


def by_pairs(K, y, c, epsilon):
    """Signed multipliers, intercept and dual value, by the most violating pair."""
    n = len(y)
    if epsilon is None:
        s, p, of = y.copy(), -np.ones(n), np.arange(n)
    else:
        s, p, of = np.r_[np.ones(n), -np.ones(n)], np.r_[epsilon - y, epsilon + y], np.r_[np.arange(n), np.arange(n)]
    z, slope = np.zeros(len(s)), p.copy()
    for _ in range(200_000):
        up = ((s > 0) & (z < c)) | ((s < 0) & (z > 0))
        low = ((s < 0) & (z < c)) | ((s > 0) & (z > 0))
        i = np.where(up, -s * slope, -np.inf).argmax()
        j = np.where(low, -s * slope, np.inf).argmin()
        high, least = -s[i] * slope[i], -s[j] * slope[j]
        if high - least < 1e-9:
            break
        a, b = of[i], of[j]
        t = (high - least) / max(K[a, a] + K[b, b] - 2 * K[a, b], 1e-12)
        t = min(t, c - z[i] if s[i] > 0 else z[i], z[j] if s[j] > 0 else c - z[j])
        z[i] += s[i] * t
        z[j] -= s[j] * t
        slope += s * t * (K[of, a] - K[of, b])
    signed = np.bincount(of, weights=s * z, minlength=n)
    return signed, (high + least) / 2, -(signed @ K @ signed) / 2 - p @ z


def rows_of(spark, x, y, partitions=3):
    rows = [(i + 1, Vectors.dense(list(a)), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, [ROW_ID, FEATURES, "label"]).repartition(partitions)


def kernel_of(a, b, gamma):
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))


@pytest.mark.parametrize("epsilon, c", [(0.1, 1.0), (0.0, 5.0), (None, 10.0)])
def test_is_the_kernel_machine_where_landmarks_explain_all_rows(spark, epsilon, c):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=70) * 0.3
    y = y if epsilon is not None else np.where(y > 0.8, 1.0, -1.0)
    df = rows_of(spark, x, y)
    marks = machines.choose(df, 2, 0.5, 256)
    assert marks.uncovered < 1e-9
    m = machines.fit(df, marks, c, epsilon, gap=1e-5)
    signed, b, dual = by_pairs(kernel_of(x, x, 0.5), y, c, epsilon)
    assert m.gap <= 1e-5 * m.objective
    assert m.objective == pytest.approx(dual, rel=2e-5)
    asked = rng.normal(size=(20, 2))
    got = machines.values(rows_of(spark, asked, np.zeros(20)), marks, [m], "v").orderBy(ROW_ID)
    want = kernel_of(asked, x, 0.5) @ signed + b
    assert [r.v[0] for r in got.collect()] == pytest.approx(want, abs=0.02 * max(1.0, np.abs(want).max()))


def test_sparse_rows_and_many_partial_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((80, 30)) < 0.1, rng.normal(size=(80, 30)), 0.0)
    dense[5] = 0.0
    y = dense.sum(1)
    df = rows_of(spark, dense, y)
    rows = [(i + 1, Vectors.sparse(30, {j: v for j, v in enumerate(a) if v}), float(b)) for i, (a, b) in enumerate(zip(dense, y))]
    thin = spark.createDataFrame(rows, [ROW_ID, FEATURES, "label"])
    a = machines.choose(df, 30, 0.2, 64)
    b = machines.choose(thin, 30, 0.2, 64)
    monkeypatch.setattr(machines, "SLICE", 200)
    one = machines.fit(df, a, 1.0, 0.1, partitions=100)
    two = machines.fit(thin, b, 1.0, 0.1)
    assert one.objective == pytest.approx(two.objective, rel=1e-3)
    for m in (one, two):
        assert m.gap <= machines.GAP * m.objective


def test_machines_of_several_classes_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 2))
    y = np.digitize(x[:, 0] + rng.normal(size=90) * 0.2, [-0.4, 0.4]).astype(float)
    df = rows_of(spark, x, y)
    marks = machines.choose(df, 2, 0.5, 48)
    alone = [machines.fit(rows_of(spark, x, np.where(y == i, 1.0, -1.0)), marks) for i in range(3)]
    seen, added = [], machines._added
    monkeypatch.setattr(machines, "_added", lambda told, marks, asked, n: seen.append(len(asked)) or added(told, marks, asked, n))
    both = machines.fit(df, marks, classes=[0.0, 1.0, 2.0], partitions=100)
    assert len(seen) == max(m.passes for m in both) < sum(seen) == sum(m.passes for m in both)
    for a, b in zip(alone, both):
        assert b.gap <= machines.GAP * b.objective and b.objective == pytest.approx(a.objective, rel=2e-3)
    monkeypatch.setattr(machines, "TOGETHER", 2)
    seen.clear()
    again = machines.fit(df, marks, classes=[0.0, 1.0, 2.0])
    assert max(seen) == 2 and [m.objective for m in again] == pytest.approx([m.objective for m in both], rel=2e-3)


def test_a_gap_that_is_left_is_told(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    df = rows_of(spark, x, x[:, 0])
    with pytest.warns(UserWarning, match="duality gap"):
        m = machines.fit(df, machines.choose(df, 2, 0.5, 32), 1.0, 0.0, max_passes=2)
    assert m.gap > 0


@pytest.mark.parametrize("label", [7.0, None])
def test_constant_targets_and_equal_rows(spark, label):
    x = np.zeros((30, 2))
    y = np.full(30, label) if label else np.r_[np.zeros(10), np.ones(20)]
    df = rows_of(spark, x, y)
    marks = machines.choose(df, 2, 1.0, 16)
    assert len(marks.points) == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        m = machines.fit(df, marks, 1.0, 0.1)
    value = float((marks.similarities(np.array([0, 1]), np.zeros(2), np.array([2])) @ m.weights + m.intercept)[0])
    assert value == pytest.approx(label if label else 1.0, abs=0.11)


def test_models_report_their_gap(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1, 401):
        a, b = float(rng.normal()), float(rng.normal())
        rows.append((i, a, b, 1000 * a * b, "in" if a * a + b * b < 1 else "out", "pqr"[int(np.digitize(a, [-0.4, 0.4]))]))
    t = PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, a double, b double, y double, c string, g string"), dense=True)
    r = train(t, "svm_reg", ["a", "b"], "y", params={"C": 100.0})
    known = r.train.select(FEATURES, "label").collect()
    asked = r.test.select(ROW_ID, FEATURES).collect()
    x, y = np.array([v[0].toArray() for v in known]), np.array([v.label for v in known])
    gamma = r.learned.report["gamma"]
    signed, b, _ = by_pairs(kernel_of(x, x, gamma), y, 100.0, 0.1)
    want = dict(zip([v[ROW_ID] for v in asked], kernel_of(np.array([v[1].toArray() for v in asked]), x, gamma) @ signed + b))
    off = [abs(v.prediction - want[v[ROW_ID]]) for v in r.predictions.collect()]
    assert np.mean(off) < 0.02 * np.std(y) and gamma == pytest.approx(0.5, rel=0.01)
    assert r.learned.report["gap"][0] <= machines.GAP * r.learned.report["objective"][0]
    r = train(t, "svm_class", ["a", "b"], "c")
    assert r.metrics().first().accuracy > 0.9 and r.roc_auc().first().auc > 0.95
    assert r.learned.report["gap"][0] <= machines.GAP * r.learned.report["objective"][0]
    assert r.predictions.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    r = train(t, "svm_class", ["a", "b"], "g")
    assert r.metrics().first().accuracy > 0.85 and len(r.learned.report["gap"]) == 3
