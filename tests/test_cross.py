"""Correlations by cross products against pandas and against the aggregates."""

import numpy as np
import pandas as pd
import pytest

from burnish.operators import charts
from burnish.table import PrepTable


def matrix(out):
    return {(r.a, r.b): r.r for r in out.collect()}


def made(n, p, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e6 * rng.random(p)
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 3] = 0.1 + 0.2
    x[:, 4] = np.nan
    x[:-1, 5] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}.x" for i in range(p)])


def nulled(frame):
    return frame.astype(object).where(frame.notna(), None)


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (7, 13), (40, 3)])
def test_cross_products_are_pairwise_complete(spark, monkeypatch, parts, batch):
    monkeypatch.setattr(charts, "FEW_PAIRS", 10)
    frame = made(400, 9)
    schema = ", ".join(f"`{c}` double" for c in frame.columns)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(nulled(frame).values.tolist(), schema).repartition(parts)
        got = matrix(charts.correlation(PrepTable.of(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = frame.corr()
    assert len(got) == 81
    for (a, b), r in got.items():
        if {a, b} & {"c 3.x", "c 4.x", "c 5.x"}:
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_infinite_values_spoil_only_pairs_that_hold_them(spark, monkeypatch):
    rows = [(1.0, 2.0, 5.0), (2.0, 1.0, 3.0), (float("inf"), 4.0, None), (3.0, 7.0, 1.0)]
    t = PrepTable.of(spark.createDataFrame(rows, "a double, b double, c double").repartition(3))
    few = matrix(charts.correlation(t))
    monkeypatch.setattr(charts, "FEW_PAIRS", 0)
    many = matrix(charts.correlation(t))
    assert np.isnan(many["a", "b"]) and np.isnan(many["b", "a"]) and np.isnan(few["a", "b"])
    for pair in (("a", "c"), ("b", "c"), ("c", "a")):
        assert many[pair] == pytest.approx(few[pair], abs=1e-12)


def test_an_empty_table_has_no_correlations(spark, monkeypatch):
    monkeypatch.setattr(charts, "FEW_PAIRS", 0)
    got = matrix(charts.correlation(PrepTable.of(spark.createDataFrame([], "a double, b double"))))
    assert set(got.values()) <= {None}


def test_hundreds_of_columns_take_one_scan(spark):
    frame = made(300, 200, seed=8)
    schema = ", ".join(f"`{c}` double" for c in frame.columns)
    out = charts.correlation(PrepTable.of(spark.createDataFrame(nulled(frame).values.tolist(), schema)))
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    got, want = matrix(out), frame.corr()
    assert len(got) == 40_000
    assert got["c 10.x", "c 150.x"] == pytest.approx(want.loc["c 10.x", "c 150.x"], abs=1e-9)
