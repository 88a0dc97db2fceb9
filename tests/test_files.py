import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish import ROW_ID
from burnish import sinks
from burnish.sources import read_csv, read_parquet

TEXT = 'id,name,score,when,ok\n1,"Ann, ""A""",1.5,2024-01-01,True\n2,NA,,2024-01-02,False\n3,"two\nlines", 7 ,2024-01-03,True\n'


def test_csv_types_and_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXT)
    t = read_csv(spark, str(tmp_path / "a.csv"))
    assert {c: t.dtype(c).simpleString() for c in t.columns} == {
        "id": "bigint", "name": "string", "score": "double", "when": "string", "ok": "boolean",
    }
    assert t.kinds == {"id": "Numeric", "name": "Categorical", "score": "Numeric", "when": "Date", "ok": "Numeric"}
    got = [tuple(r) for r in t.df.orderBy(ROW_ID).collect()]
    assert got == [
        (1, 1, 'Ann, "A"', 1.5, "2024-01-01", True),
        (2, 2, None, None, "2024-01-02", False),
        (3, 3, "two\nlines", 7.0, "2024-01-03", True),
    ]


def test_csv_delimiters_and_no_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\n2\ty\n")
    t = read_csv(spark, str(tmp_path / "a.tsv"), delimiter="\\t", has_header=False)
    assert t.columns == ["Col0", "Col1"] and t.df.count() == 2


@pytest.mark.parametrize("multi_line", [True, False])
def test_row_ids_over_many_files_and_blocks(spark, tmp_path, multi_line):
    n = 0
    for part in range(4):
        size = 3_000 * (4 - part)
        lines = "\n".join(f"{n + i},{'v' * 20}" for i in range(size))
        (tmp_path / f"part-{part}.csv").write_text("n,v\n" + lines + "\n")
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        t = read_csv(spark, str(tmp_path), multi_line=multi_line)
        assert t.df.filter(F.col("n") + 1 != F.col(ROW_ID)).count() == 0
        assert t.df.count() == n == t.at_most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    t = read_csv(spark, str(tmp_path / "e.csv"))
    assert t.df.count() == 0 and t.kinds == {} and t.columns == ["a", "b"]


def test_parquet_row_ids_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 10_000, 1, 13).write.parquet(path)
    t = read_parquet(spark, path)
    assert t.df.filter(F.col("id") + 1 != F.col(ROW_ID)).count() == 0


def test_parquet_text_columns_can_be_inferred(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "NA"), ("2", "b")], "x string, y string").write.parquet(path)
    t = read_parquet(spark, path, infer_text=True)
    assert t.kinds == {"x": "Numeric", "y": "Categorical"} and t.df.filter("y is null").count() == 1


@pytest.fixture()
def odd(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXT)
    return read_csv(spark, str(tmp_path / "a.csv"))


def test_csv_reads_back(spark, odd, tmp_path):
    sinks.write_csv(odd, str(tmp_path / "out"), delimiter=";")
    again = read_csv(spark, str(tmp_path / "out"), delimiter=";")
    assert again.df.orderBy(ROW_ID).collect() == odd.df.orderBy(ROW_ID).collect()


def test_json_and_sql(spark, odd, tmp_path):
    sinks.write_json(odd, str(tmp_path / "j"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert lines[1] == {"id": 2, "name": None, "score": None, "when": "2024-01-02", "ok": False}
    sinks.write_sql(odd, str(tmp_path / "s"), "people")
    first = sorted((tmp_path / "s").glob("part-*"))[0].read_text().splitlines()
    assert [line[:2] for line in first[:3]] == ["--"] * 3 and first[2].endswith("3")
    body = [r[0] for r in sinks.insert_statements(odd, "people", ordered=True).collect()]
    assert body[0] == (
        "INSERT INTO people (`id`, `name`, `score`, `when`, `ok`) VALUES (1, 'Ann, \"A\"', 1.5, '2024-01-01', True);"
    )
    assert "NULL, NULL" in body[1]


def test_preview(odd):
    assert [r[0] for r in sinks.preview(odd, "csv").collect()][0] == "id,name,score,when,ok"
    assert sinks.preview(odd, "csv", header=False).count() == 3
    assert sinks.preview(odd, "sql", table="t").first()[0].startswith("INSERT INTO t ")
    with pytest.raises(ValueError):
        sinks.preview(odd, "xlsx")


def test_csv_agrees_with_pandas(spark, odd, tmp_path):
    sinks.write_csv(odd, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert pd.read_csv(pd.io.common.StringIO(text))["id"].tolist() == [1, 2, 3]
