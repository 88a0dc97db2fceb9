import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish import PrepTable
from burnish.operators import charts, profile
from burnish.operators.quantiles import group_quantiles
from burnish.sources import infer, infer_kinds


def frame(spark, pdf):
    return PrepTable.of(spark.createDataFrame(pdf), at_most=len(pdf))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {
            "age": rng.integers(18, 80, 200).astype(float),
            "pay": np.round(rng.lognormal(8, 1, 200), 2),
            "team": rng.choice(["red", "green", "blue"], 200),
        }
    )
    pdf.loc[rng.choice(200, 30, replace=False), "age"] = np.nan
    pdf.loc[rng.choice(200, 11, replace=False), "team"] = None
    pdf = pd.concat([pdf, pdf.iloc[:7]], ignore_index=True)
    return pdf, frame(spark, pdf)


def test_profile_agrees_with_pandas(people):
    pdf, t = people
    got = {r["name"]: r for r in profile.profile(t).collect()}
    for c in ("age", "pay"):
        s, r = pdf[c], got[c]
        want = dict(
            min=s.min(), max=s.max(), mean=s.mean(), median=s.median(), std=s.std(), variance=s.var(),
            skewness=s.skew(), q1=s.quantile(0.25), q3=s.quantile(0.75), sum=s.sum(),
        )
        for k, v in want.items():
            assert r[k] == pytest.approx(v), (c, k)
        assert r["kind"] == "Numeric"
    for c in pdf.columns:
        assert got[c]["missing_count"] == pdf[c].isna().sum()
        assert got[c]["unique"] == pdf[c].nunique()
    assert got["team"]["mean"] is None and got["team"]["kind"] == "Categorical"


def test_summary_agrees_with_pandas(people):
    pdf, t = people
    r = profile.table_summary(t).first()
    missing, cells = int(pdf.isna().sum().sum()), pdf.size
    twins = int(pdf.duplicated().sum())
    assert (r["rows"], r["columns"], r["missing_cells"], r["duplicates"]) == (207, 3, missing, twins)
    assert r["quality_score"] == max(0, min(100, round(100 - missing / cells * 150 - twins / 207 * 200)))
    assert r["missing_pct"] == round(missing / cells * 100, 2)


def test_correlation_agrees_with_pandas(people):
    pdf, t = people
    got = {(r["a"], r["b"]): r["r"] for r in charts.correlation(t).collect()}
    want = pdf[["age", "pay"]].corr()
    for a in ("age", "pay"):
        for b in ("age", "pay"):
            assert got[a, b] == pytest.approx(want.loc[a, b])


def test_empty_table(spark):
    t = PrepTable.of(spark.createDataFrame([], "x double, s string"))
    r = profile.table_summary(t).first()
    assert (r["rows"], r["missing_pct"], r["quality_score"], r["duplicates"]) == (0, 0.0, 100, 0)
    assert profile.completeness(profile.missing_profile(t)).first()[0] == 100.0
    p = {x["name"]: x for x in profile.profile(t).collect()}
    assert p["x"]["mean"] is None and p["x"]["unique"] == 0 and p["x"]["std"] is None


def test_singleton_constant_and_all_null(spark):
    one = profile.profile(PrepTable.of(spark.createDataFrame([(3.0,)], "x double"))).first()
    assert (one["std"], one["variance"], one["skewness"], one["median"]) == (0.0, 0.0, 0.0, 3.0)
    flat = PrepTable.of(spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 4.0)], "x double, y double"))
    p = profile.profile(flat).first()
    assert (p["std"], p["skewness"]) == (0.0, 0.0)
    assert charts.histogram(flat, "x").collect()[0]["count"] == 3
    r = {(x["a"], x["b"]): x["r"] for x in charts.correlation(flat).collect()}
    assert r["x", "y"] is None and r["x", "x"] is None and r["y", "y"] == 1.0
    empty = infer(spark.createDataFrame([(None,), (None,)], "x string"))
    assert empty.kinds == {"x": "Categorical"}


def test_booleans_and_nan(spark):
    t = PrepTable.of(spark.createDataFrame([(True, float("nan")), (False, None), (True, 1.0)], "b boolean, x double"))
    p = {r["name"]: r for r in profile.profile(t).collect()}
    assert p["b"]["kind"] == "Numeric" and p["b"]["mean"] == pytest.approx(2 / 3)
    assert p["x"]["missing_count"] == 2 and p["x"]["max"] == 1.0


def test_odd_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    t = PrepTable.of(spark.createDataFrame([(1, 2.0, "u", 4.0)], "`a.b` int, Age double, age string, `x y` double"))
    assert [r["name"] for r in profile.profile(t).orderBy("position").collect()] == ["a.b", "Age", "age", "x y"]
    assert charts.correlation(t).count() == 9


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError, match="no kind"):
        PrepTable.of(spark.createDataFrame([([1.0],)], "v array<double>"))


def test_top_values_ties_by_label(spark):
    t = PrepTable.of(spark.createDataFrame([(v,) for v in "babac"] + [(None,)], "s string"))
    got = [(r["label"], r["count"]) for r in profile.top_values(t, "s").collect()]
    assert got == [("a", 2), ("b", 2), ("[Blank]", 1), ("c", 1)]


def test_kind_needs_more_than_four_fifths(spark):
    rows = [(str(i) if i < 8 else "x", str(i) if i < 9 else "x", f"2024-01-{i + 1:02d}") for i in range(10)]
    t = infer(spark.createDataFrame(rows, "a string, b string, c string"))
    assert t.kinds == {"a": "Categorical", "b": "Numeric", "c": "Date"}
    got = {r["name"]: r["kind"] for r in infer_kinds(t).collect()}
    assert got == t.kinds


@pytest.mark.parametrize("hot_rows", [10**6, 50, 0])
def test_quantiles_by_group(spark, hot_rows):
    """Hot and cold groups give numpy's answer: ties, negatives, wide ranges, infinities."""
    rng = np.random.default_rng(7)
    parts = {
        "wide": np.concatenate([rng.normal(0, 1e-9, 300), rng.lognormal(0, 20, 300), -rng.lognormal(0, 20, 300)]),
        "tied": np.repeat([1.0, 1.0, 2.0, 5.0], 100),
        "near": 1e6 + rng.integers(0, 1000, 500) * 1e-6,
        "few": np.array([3.0, -4.0]),
        "one": np.array([9.5]),
        "inf": np.array([1.0, 2.0, 3.0, np.inf, np.inf]),
    }
    pdf = pd.DataFrame([(g, float(x)) for g, xs in parts.items() for x in xs], columns=["g", "x"])
    df = spark.createDataFrame(pdf).repartition(5)
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "x", hot_rows=hot_rows).collect()}
    assert set(got) == set(parts)
    for g, xs in parts.items():
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            want = {"q1": 2.0, "median": 3.0, "q3": np.inf}[name] if g == "inf" else np.quantile(xs, p)
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)


def test_box_over_hot_groups(spark, monkeypatch):
    from burnish.operators import quantiles, skew

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.15, 0.05]), "y": rng.lognormal(0, 1, 3000)})
    plain = frame(spark, pdf)
    unknown = PrepTable.of(spark.createDataFrame(pdf))
    key = lambda r: r["x"]
    want = sorted(charts.box(plain, "y", "g").collect(), key=key)
    rows = unknown.df.select(F.col("g").alias("x"), F.col("y"))
    fences = group_quantiles(rows, ["x"], "y", hot_rows=500)
    joined = skew.attach(rows, fences, ["x"], hot_rows=500)
    assert joined.count() == 3000
    got = sorted(quantiles.group_quantiles(rows, ["x"], "y", hot_rows=500).collect(), key=key)
    for a, b in zip(want, got):
        assert (a["q1"], a["median"], a["q3"]) == pytest.approx((b["q1"], b["median"], b["q3"]))
    assert sorted(charts.box(unknown, "y", "g").collect(), key=key) == want
