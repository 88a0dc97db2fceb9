import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish import ROW_ID, PrepTable
from burnish.models import MODELS, attribution, kernel, metrics, neighbours, prep, train
from burnish.models.train import CLASSIFIERS


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    a, b = rng.normal(0, 1, n), rng.normal(5, 3, n)
    g = rng.choice(["u", "v", "w"], n)
    y = 3 * a - 2 * b + (g == "v") * 4 + rng.normal(0, 0.5, n)
    c = np.where(a + rng.normal(0, 0.5, n) > 0, "yes", "no")
    return pd.DataFrame({ROW_ID: np.arange(1, n + 1), "a": a, "b": b, "g": g, "y": y, "c": c})


@pytest.fixture(scope="module")
def t(spark, data):
    return PrepTable.of(spark.createDataFrame(data))


def test_split_is_exact_and_repeatable(t):
    for ratio in (0.5, 0.75, 0.8, 0.123):
        flags = {r[0] for r in t.df.filter(prep.split_flag(t.df, ratio)).select(ROW_ID).collect()}
        assert len(flags) == int(ratio * 400)
        again = t.df.repartition(5)
        assert flags == {r[0] for r in again.filter(prep.split_flag(again, ratio)).select(ROW_ID).collect()}


def scaled_design(data, flags):
    x = pd.get_dummies(data[["a", "b", "g"]], drop_first=True).astype(float).to_numpy()
    tr = np.isin(data[ROW_ID], list(flags))
    return (x - x[tr].mean(0)) / x[tr].std(0), tr


def test_linear_and_ridge_match_closed_form(t, data):
    r = train(t, "linear", ["a", "b", "g"], "y")
    flags = {x[0] for x in r.train.select(ROW_ID).collect()}
    z, tr = scaled_design(data, flags)
    assert r.design.names == ("a", "b", "g_v", "g_w")
    y = data["y"].to_numpy()
    full = np.c_[z[tr], np.ones(tr.sum())]
    w = np.linalg.lstsq(full, y[tr], rcond=None)[0]
    assert r.learned.weights == pytest.approx(w[:-1].tolist(), rel=1e-6)
    got = r.metrics().first()
    miss = y[~tr] - np.c_[z[~tr], np.ones((~tr).sum())] @ w
    assert got["mse"] == pytest.approx((miss**2).mean()) and got["mae"] == pytest.approx(np.abs(miss).mean())
    assert got["r2"] == pytest.approx(1 - (miss**2).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum())
    ridge = train(t, "ridge", ["a", "b", "g"], "y", params={"alpha": 10.0})
    want = np.linalg.solve(z[tr].T @ z[tr] + 10 * np.eye(4), z[tr].T @ (y[tr] - y[tr].mean()))
    assert ridge.learned.weights == pytest.approx(want.tolist(), rel=1e-6)


def test_logistic_matches_newton(t, data):
    r = train(t, "logistic", ["a", "b", "g"], "c")
    z, tr = scaled_design(data, {x[0] for x in r.train.select(ROW_ID).collect()})
    x, y = np.c_[z[tr], np.ones(tr.sum())], (data["c"].to_numpy()[tr] == "yes").astype(float)
    w, pen = np.zeros(5), np.diag([1.0, 1, 1, 1, 0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (p - y) + pen @ w)
    assert r.learned.weights == pytest.approx(w[:-1].tolist(), abs=1e-4)


def test_naive_bayes_matches_closed_form(t, data):
    r = train(t, "naive_bayes", ["a", "b"], "c")
    z, tr = scaled_design(data, {x[0] for x in r.train.select(ROW_ID).collect()})
    z, y = z[:, :2], (data["c"].to_numpy() == "yes").astype(float)
    like = []
    for k in (0.0, 1.0):
        m = tr & (y == k)
        like.append(np.log(m.sum()) - 0.5 * (np.log(z[m].var(0)) + (z - z[m].mean(0)) ** 2 / z[m].var(0)).sum(1))
    want = dict(zip(data[ROW_ID], np.argmax(like, 0)))
    for p in r.predictions.collect():
        assert p["prediction"] == want[p[ROW_ID]]


def brute(tr, te, k):
    out = {}
    for z in te:
        d = [(sum((a - b) ** 2 for a, b in zip(z, p)), i, y) for i, p, y in tr]
        out[z] = [(i, y) for _, i, y in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("dims, levels", [(1, 30), (2, 12), (3, 5)])
@pytest.mark.parametrize("options", [{}, {"pivots": 20, "test_block": 7, "train_block": 9}])
def test_neighbours_match_brute_force(spark, monkeypatch, dims, levels, options):
    """Integer grids are full of ties and copies; small blocks force the pruned join."""
    rng = np.random.default_rng(dims)
    points = rng.integers(0, levels, (300, dims))
    points[:100] = points[0]
    tr = [(i + 1, tuple(map(float, p)), float(i % 3)) for i, p in enumerate(points)]
    te = sorted({tuple(map(float, p)) for p in rng.integers(-3, levels + 3, (60, dims))})
    if options:
        monkeypatch.setattr(neighbours, "PLAIN_COPIES", 0)
    a = spark.createDataFrame([(i, list(z), y) for i, z, y in tr], f"{ROW_ID} long, z array<double>, label double")
    b = spark.createDataFrame([(list(z),) for z in te], "z array<double>")
    got = {}
    for r in neighbours.nearest(a, b, 5, **options).orderBy("d", "id").collect():
        got.setdefault(tuple(r["z"]), []).append((r["id"], r["y"]))
    assert got == brute(tr, te, 5)


def test_fewer_points_than_neighbours(spark):
    a = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 2.0)], f"{ROW_ID} long, z array<double>, label double")
    b = spark.createDataFrame([([0.4],), ([9.0],)], "z array<double>")
    assert neighbours.nearest(a, b, 5).count() == 4


def test_blocks_without_test_rows(spark):
    a = spark.createDataFrame([(i, [float(i)], 1.0) for i in range(50)], f"{ROW_ID} long, z array<double>, label double")
    b = spark.createDataFrame([([float(i)],) for i in range(5)], "z array<double>")
    assert neighbours.nearest(a, b, 3, test_block=1, train_block=7).count() == 15


def test_vote_ties_go_to_smallest(spark):
    a = spark.createDataFrame([(i, [float(i)], float(i % 2)) for i in range(4)], f"{ROW_ID} long, z array<double>, label double")
    b = spark.createDataFrame([(7, [1.5], 0.0)], f"{ROW_ID} long, z array<double>, label double")
    r = neighbours.predict(a, b, True, 4).first()
    assert (r["prediction"], r["score"]) == (0.0, 0.5)


@pytest.mark.parametrize("model", MODELS)
def test_every_model_learns(t, model):
    small = {"trees": 10} if model.startswith("forest") else {"width": 64} if model.startswith("svm") else {}
    r = train(t, model, ["a", "b", "g"], "c" if model in CLASSIFIERS else "y", params=small)
    assert r.predictions.count() == 80 and r.predictions.filter("prediction IS NULL").count() == 0
    m = r.metrics().first()
    if model in CLASSIFIERS:
        assert m["accuracy"] > 0.75
        assert r.roc_auc().first()["auc"] > 0.8
        assert sum(x["n"] for x in r.confusion_matrix().collect()) == 80
    else:
        assert m["r2"] > 0.6
    r.release()


def test_three_classes_and_the_kernel_machine(t):
    r = train(t, "svm_class", ["a", "b", "y"], "g", params={"width": 64})
    assert r.task == "classification" and r.metrics().first()["accuracy"] > 0.3
    with pytest.raises(ValueError):
        r.roc_curve()


def test_fourier_features_approach_the_kernel(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (20, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, x array<double>")
    out = kernel.fourier(df.select("i", array_to_vector("x").alias("features")), 3, 0.4, 4096).orderBy("i").collect()
    f = np.array([r["features"].toArray() for r in out])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - exact).max() < 0.1


def test_attributions_add_up(t):
    for model, target in (("tree_reg", "y"), ("naive_bayes", "c"), ("knn_reg", "y")):
        r = train(t, model, ["a", "b", "g"], target)
        # One background row, so each row's values add up to its score less that row's.
        phi = attribution.sampled_attribution(r, rows=6, background=1, permutations=2)
        total = {x[ROW_ID]: x["s"] for x in phi.groupBy(ROW_ID).agg(F.sum("phi").alias("s")).collect()}
        base = r.learned.predict(r.train.orderBy(*prep.hash_order()).limit(1)).first()["score"]
        score = {x[ROW_ID]: x["score"] for x in r.predictions.collect()}
        assert len(total) == 6
        for row, s in total.items():
            assert s == pytest.approx(score[row] - base, abs=1e-9)
        r.release()


def test_linear_attribution_is_exact(t):
    r = train(t, "linear", ["a", "b", "g"], "y")
    phi = attribution.attribution(r, rows=10).groupBy(ROW_ID).agg(F.sum("phi").alias("s"))
    base = r.learned.predict(r.train).agg(F.avg("score")).first()[0]
    joined = phi.join(r.predictions, ROW_ID).collect()
    assert len(joined) == 10
    assert attribution.attribution(r).select(ROW_ID).distinct().count() == r.test.count()
    for x in joined:
        assert x["s"] == pytest.approx(x["score"] - base)
    assert attribution.attribution_summary(attribution.attribution(r), 2).count() == 2


def test_roc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    pts = [(r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).orderBy("fpr", "tpr").collect()]
    want = [(0, 0), (0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1), (1, 1)]
    assert [x for p in pts for x in p] == pytest.approx([x for p in want for x in p])
    area = np.trapezoid([p[1] for p in pts], [p[0] for p in pts])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(area)
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert metrics.roc_auc(flat).first()[0] == 0.5


def test_confusion_fills_zeros(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "c")], "label string, prediction string")
    assert metrics.confusion(df).count() == 9
    m = metrics.classification(df).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.5, 0.5, 0.5, 0.5)


def test_confusion_of_many_classes_lists_what_occurs(spark):
    df = spark.range(100_000).selectExpr("id AS label", "id - id % 2 AS prediction")
    out = metrics.confusion(df, zeros=False)
    assert out.count() == 100_000 and out.filter("n <> 1").count() == 0
    part = metrics.confusion(df.filter("id < 50"), labels=[3, 4])
    assert part.count() == 100 and part.agg(F.sum("n")).first()[0] == 2
    assert metrics.confusion(df, zeros=False, labels=[3]).collect() == [(3, 2, 1)]



def test_refused_inputs(spark, t):
    for call in (
        lambda: train(t, "linear", [], "y"),
        lambda: train(t, "linear", ["a", "y"], "y"),
        lambda: train(t, "oracle", ["a"], "y"),
        lambda: train(t, "linear", ["zz"], "y"),
        lambda: train(t, "ridge", ["a"], "y", params={"beta": 1}),
        lambda: train(t.with_df(t.df.limit(4)), "linear", ["a"], "y"),
        lambda: train(t, "linear", ["a"], "y", ratio=1.0),
    ):
        with pytest.raises(ValueError):
            call()
