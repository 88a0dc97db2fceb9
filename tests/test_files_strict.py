"""Delimited files that must not be misread."""

import pytest

from burnish.operators import clean, grid
from burnish.sinks import writers
from burnish.sources import read_csv
from burnish.sources.delimited import header_names
from burnish.table import ROW_ID, PrepTable


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_repeated_and_empty_header_names(spark, tmp_path):
    assert header_names(["a", "a", None, "a.1", "a"]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "a.2"]
    t = read_csv(spark, put(tmp_path / "r", x="a,a,b\n1,2,3\n"))
    assert t.columns == ["a", "a.1", "b"]
    assert [tuple(r) for r in t.data.collect()] == [(1, 2, 3)]


def test_surplus_fields_raise_and_missing_ones_are_null(spark, tmp_path):
    t = read_csv(spark, put(tmp_path / "s", x='a,b\n1,2\n3\n"x,y",4\n'))
    assert sorted(map(tuple, t.data.collect()), key=str) == [("1", 2), ("3", None), ("x,y", 4)]
    for bad in ("a,b\n3,4,5\n", "a,b\n1,2\n3,4,,x\n", 'a,b\n"1\n2",3,4\n'):
        with pytest.raises(Exception, match="more than 2 fields"):
            read_csv(spark, put(tmp_path / str(abs(hash(bad))), x=bad)).df.collect()


def test_files_with_another_header_raise(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, put(tmp_path / "h", x="a,b\n1,2\n", y="b,a\n20,10\n")).df.collect()


def test_one_column_keeps_missing_rows(spark, tmp_path):
    t = PrepTable.of(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], f"{ROW_ID} long, s string"), dense=True)
    writers.write_csv(t, str(tmp_path / "one"))
    back = read_csv(spark, str(tmp_path / "one"))
    assert [r.s for r in back.df.orderBy(ROW_ID).collect()] == ["x", None, "z"]


def test_pages_and_previews_of_filtered_tables(spark):
    rows = [(i, 7 + i % 2, f"s{i % 3}") for i in range(1, 31)]
    t = PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, _cell long, _id string"), dense=True)
    found = grid.search(t, "s1")
    page = grid.page(found, 1, 4)
    assert (page.total, [r[ROW_ID] for r in page.rows.collect()]) == (10, [1, 2, 3, 4])
    assert writers.preview(found, "csv").count() == 11
    ids = [r for r in found.numbered().df.orderBy(ROW_ID).collect()]
    assert [r[ROW_ID] for r in ids] == list(range(1, 11)) and {r._cell for r in ids} == {7, 8}
    last = grid.page(found, 99, 4, sort_column="_cell", ascending=False)
    assert [r[ROW_ID] for r in last.rows.collect()] == [8, 10]


def test_deep_pages_hand_on_their_order(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHALLOW_ROWS", 5)
    rows = [(i, (i * 37) % 101) for i in range(1, 101)]
    t = PrepTable.of(spark.createDataFrame(rows, f"{ROW_ID} long, _rank long"), dense=True)
    first = grid.page(t, 5, 10, sort_column="_rank")
    assert [r._rank for r in first.rows.collect()] == sorted(v for _, v in rows)[40:50]
    again = grid.page(t, 6, 10, sort_column="_rank", order=first.order)
    assert again.order is first.order
    assert [r._rank for r in again.rows.collect()] == sorted(v for _, v in rows)[50:60]


def test_text_of_numbers_and_letters(spark):
    t = PrepTable.of(spark.createDataFrame([(12345678.5, "É"), (0.25, "日本abc"), (None, "ZÜRICH")], "x double, s string"))
    assert grid.search(t, "12345678").df.count() == 1
    assert grid.search(t, "é").df.count() == grid.search(t, "ü").df.count() == 1
    assert {r.s for r in clean.standardize_strings(t, "s", "title").df.collect()} == {"É", "日本Abc", "Zürich"}
    filled = clean.fill_missing(t, "s", "custom")
    assert filled.df.count() == 3
    void = PrepTable.of(spark.createDataFrame([(None,), ("a",)], "s string"))
    assert {r.s for r in clean.fill_missing(void, "s", "custom").df.collect()} == {"", "a"}
