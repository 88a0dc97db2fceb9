import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish import ROW_ID, PrepTable
from burnish.operators import clean, edits, grid, rank
from burnish.plans import PrepSession, Recipe, Step


@pytest.fixture()
def t(spark):
    rows = [
        (1, "b", 1.0, "x"), (2, "a", None, " x "), (3, "b", 1.0, "x"), (4, None, 100.0, None),
        (5, "a", 3.0, "O'NEIL"), (6, "c", 2.0, "y-z"), (7, "b", 1.0, "x"),
    ]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, k string, n double, s string")
    return PrepTable.of(df)


def rows(t):
    return [tuple(r) for r in t.numbered().df.orderBy(ROW_ID).collect()]


def test_duplicates_keep_first_and_are_idempotent(t):
    once = clean.remove_duplicates(t)
    assert [r[0] for r in rows(once)] == [1, 2, 3, 4, 5]
    assert [r[1] for r in rows(once)] == ["b", "a", None, "a", "c"]
    assert rows(clean.remove_duplicates(once)) == rows(once)
    assert clean.affected(t, "remove_duplicates").first()[0] == 2


def test_fills(t):
    assert clean.fill_missing(t, "n", "mean").df.filter("_rowId = 2").first()["n"] == pytest.approx(108 / 6)
    assert clean.fill_missing(t, "n", "median").df.filter("_rowId = 2").first()["n"] == 1.5
    assert clean.fill_missing(t, "k", "mode").df.filter("_rowId = 4").first()["k"] == "b"
    filled = clean.fill_missing(t, "n", "custom", "oops")
    assert filled.kind("n") == "Numeric" and filled.df.filter("_rowId = 2").first()["n"] == "oops"
    assert filled.df.agg(F.count(filled.number("n"))).first()[0] == 6


def test_fill_mode_takes_smallest_and_empty_text(spark):
    tied = PrepTable.of(spark.createDataFrame([(v,) for v in "babac"] + [(None,)], "s string"))
    assert clean.fill_missing(tied, "s", "mode").df.filter("s = 'a'").count() == 3
    void = PrepTable.of(spark.createDataFrame([(None,), (None,)], "s string"))
    assert clean.fill_missing(void, "s", "mode").df.filter("s = ''").count() == 2
    assert clean.fill_missing(void, "s", "mean").df.filter("s is null").count() == 2


def test_whole_numbers_stay_whole(spark):
    t = PrepTable.of(spark.createDataFrame([(1,), (None,), (3,)], "x long"))
    assert clean.fill_missing(t, "x", "custom", "7").dtype("x").simpleString() == "bigint"
    assert clean.fill_missing(t, "x", "custom", "7.5").dtype("x").simpleString() == "double"
    assert clean.replace_values(t, "x", "3.0", "4").df.agg(F.max("x")).first()[0] == 4


def test_replace(t):
    assert clean.replace_values(t, "n", "1", "").df.filter("n is null").count() == 4
    assert clean.affected(t, "replace_values", column="n", find="1.00", substitute="5").first()[0] == 3
    assert clean.replace_values(t, "n", "abc", "5").df.filter("n = 1").count() == 3
    assert clean.replace_values(t, "k", "b", "B").df.filter("k = 'B'").count() == 3
    assert clean.replace_values(t, "s", "x", "").df.filter("s is null").count() == 4


def test_text_keeps_missing(t):
    assert clean.standardize_strings(t, "s", "title").df.filter("s = 'O''Neil'").count() == 1
    for case in clean.CASES:
        assert clean.standardize_strings(t, "s", case).df.filter("s is null").count() == 1


def test_outliers_keep_missing(t):
    kept = clean.remove_outliers(t, "n")
    assert kept.df.filter("n = 100").count() == 0 and kept.df.filter("n is null").count() == 1
    with pytest.raises(ValueError):
        clean.remove_outliers(t, "k")


def test_wrong_parameters(t):
    for call in (
        lambda: clean.drop_missing(t, "zz"),
        lambda: clean.fill_missing(t, "n", "guess"),
        lambda: clean.rename_column(t, "n", "k"),
        lambda: clean.rename_column(t, "n", ""),
        lambda: clean.standardize_strings(t, "s", "camel"),
        lambda: Step("explode"),
    ):
        with pytest.raises(ValueError):
            call()


def test_rename_keeps_place_and_kind(t):
    out = clean.rename_column(t, "n", "n.2 new")
    assert out.columns == ["k", "n.2 new", "s"] and out.kind("n.2 new") == "Numeric"


def test_recipe_round_trip(t):
    recipe = Recipe().then("remove_duplicates").then("fill_missing", column="n", strategy="mean").then("drop_missing", column="k")
    again = Recipe.from_json(recipe.to_json())
    assert again == recipe and rows(again.apply(t)) == rows(recipe.apply(t))


def test_long_recipe_plan_stays_short(t):
    recipe = Recipe()
    for _ in range(5):
        recipe = recipe.then("fill_missing", column="n", strategy="mean").then("remove_outliers", column="n", multiplier=50)
    assert recipe.apply(t.with_df(t.df, at_most=7)).df.count() == 7


def test_session_undo_redo_reset(t):
    s = PrepSession(t, max_depth=3)
    start = rows(s.table)
    s.apply("remove_duplicates")
    after = rows(s.table)
    assert s.undo() and rows(s.table) == start and len(s.log) == 1
    assert not s.undo()
    assert s.redo() and rows(s.table) == after and s.log[-1]["title"] == "Remove duplicates"
    s.apply("drop_column", column="s")
    assert not s.redo()
    assert s.recipe().steps[-1].action == "drop_column"
    s.reset()
    assert rows(s.table) == start and len(s.log) == 1
    assert s.undo() and s.table.columns == ["k", "n"]
    assert s.recent(2).count() == 2 and s.ledger().count() == 3


def test_session_depth_audit_and_cut(t):
    s = PrepSession(t, max_depth=2, audit=True, cut_every=2)
    for case in ("upper", "lower", "title"):
        s.apply("standardize_strings", column="s", case=case)
    assert s.undo() and s.undo() and not s.undo()
    before = len(s.log)
    s.apply("fill_missing", column="n", strategy="custom", value="1")
    s.apply("fill_missing", column="n", strategy="mean")
    assert len(s.log) == before + 1
    assert "affected 1" in s.log[-1]["description"]


def test_edits(spark, t):
    made = [
        (1, "k", "first", 1), (1, "k", "second", 2), (2, "n", "8", 1), (3, "s", "NaN", 1), (3, "k", "[NULL]", 1),
        (99, "k", "lost", 1), (1, "zz", "lost", 1),
    ]
    e = spark.createDataFrame(made, edits.EDIT_SCHEMA)
    out = {r[ROW_ID]: r for r in edits.apply_edits(t, e).df.collect()}
    assert out[1]["k"] == "second" and out[2]["n"] == 8.0 and out[3]["s"] is None and out[3]["k"] is None
    assert {(r["reason"], r["column"]) for r in edits.rejected_edits(t, e).collect()} == {
        ("unknown row", "k"), ("unknown column", "zz"),
    }
    wide = edits.apply_edits(t, spark.createDataFrame([(5, "n", "many", 1)], edits.EDIT_SCHEMA))
    assert wide.kind("n") == "Numeric" and wide.df.filter("n = 'many'").count() == 1


def test_renumber_keeps_order(spark):
    ids = random.Random(5).sample(range(1, 400_000), 20_000)
    df = spark.createDataFrame([(i, i * 2) for i in ids], f"{ROW_ID} long, v long").repartition(7)
    out = rank.renumber(df).orderBy(ROW_ID).collect()
    assert [r[ROW_ID] for r in out] == list(range(1, 20_001))
    assert [r["v"] for r in out] == [i * 2 for i in sorted(ids)]


def test_number_rows_with_a_hot_value(spark):
    df = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v")).repartition(6)
    out = rank.number_rows(df, [F.col("v").desc(), F.col("id").asc()]).orderBy(ROW_ID).collect()
    want = sorted(((1 if i % 3 == 0 else i, i) for i in range(5_000)), key=lambda p: (-p[0], p[1]))
    assert [r[ROW_ID] for r in out] == list(range(1, 5_001))
    assert [(r["v"], r["id"]) for r in out] == want


def test_pages_agree_near_and_far(spark, monkeypatch):
    pdf = pd.DataFrame({"v": [float(i * 37 % 101) if i % 9 else None for i in range(500)], "s": [f"r{i % 7}" for i in range(500)]})
    df = rank.number_rows(spark.createDataFrame(pdf).withColumn("i", F.monotonically_increasing_id()), [F.col("i")])
    t = PrepTable.of(df.drop("i"))
    asks = [dict(number=n, size=40, sort_column=c, ascending=a) for n in (1, 6, 99) for c in ("v", "s", "") for a in (True, False)]
    asks += [dict(number=3, size=20, needle="r[12]")]
    near = [[tuple(r) for r in grid.page(t, **a).rows.collect()] for a in asks]
    monkeypatch.setattr(grid, "SHALLOW_ROWS", 0)
    far = [[tuple(r) for r in grid.page(t, **a).rows.collect()] for a in asks]
    assert near == far
    p = grid.page(t, 99, 40)
    assert (p.total, p.pages, p.current_page, p.start, p.end) == (500, 13, 13, 481, 500)
    none = grid.page(t, 1, 10, "nothing like it")
    assert (none.total, none.pages, none.start, none.end, none.rows.count()) == (0, 1, 0, 0, 0)


def test_pages_of_any_size_after_rows_have_gone(spark, monkeypatch):
    """Places by a join, as large pages take them, are those of a page whose ids reach the driver."""
    pdf = pd.DataFrame({ROW_ID: range(1, 401), "v": [float(i * 37 % 11) if i % 9 else None for i in range(400)], "_id": "x"})
    t = clean.drop_missing(PrepTable.of(spark.createDataFrame(pdf)), "v")
    asks = [dict(number=n, size=150, sort_column=c, ascending=a) for n in (1, 2, 3) for c in ("v", "") for a in (True, False)]
    asks.append(dict(number=1, size=10, needle="nothing like it"))
    few = [[tuple(r) for r in grid.page(t, **a).rows.collect()] for a in asks]
    assert [r[0] for r in few[2]] == list(range(1, 151))
    monkeypatch.setattr(grid, "MAPPED_ROWS", 0)
    assert [[tuple(r) for r in grid.page(t, **a).rows.collect()] for a in asks] == few
