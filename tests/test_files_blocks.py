"""Quoted files that are read in blocks, against Python's own reader."""

import csv
import io
import random

import numpy as np
import pytest

from burnish.sources import read_csv
from burnish.sources.delimited import passed, scan_csv
from burnish.table import ROW_ID

PIECES = ["a", "b c", ",", ";", '"', "\n", "\n\n", "", "é漢", '","', '"\n"', " "]


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells_of(df):
    rows = sorted(map(tuple, df.collect()))
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(c or "" for c in r[1:]) for r in rows]


@pytest.mark.parametrize(("delimiter", "end"), [(",", "\n"), (";", "\r\n"), ("\t", "\n")])
def test_blocks_give_the_rows_of_a_whole_read(spark, small_blocks, tmp_path, delimiter, end):
    rng = random.Random(7)
    want = []
    for name in ("a", "b", "c"):
        rows = [["x" + str(i), *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) for _ in range(3))] for i in range(250)]
        out = io.StringIO(newline="")
        writer = csv.writer(out, delimiter=delimiter, lineterminator=end, quoting=csv.QUOTE_MINIMAL if name != "b" else csv.QUOTE_ALL)
        writer.writerows([["id", "p", "q\nr", "s"], *rows])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
        want += map(tuple, rows)
    df, n = scan_csv(spark, str(tmp_path), delimiter=delimiter)
    assert df.columns == [ROW_ID, "id", "p", "q\nr", "s"] and n == len(want)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    assert cells_of(df) == want


def test_one_record_over_many_blocks(spark, small_blocks, tmp_path):
    long = "\n".join(f'line {i}, with "quotes" and, commas' for i in range(400))
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["a", "b"], ["1", long], ["2", "x"], ["3", long]])
    df, n = scan_csv(spark, str(tmp_path / "a.csv"))
    assert n == 3 and cells_of(df) == [("1", long), ("2", "x"), ("3", long)]


@pytest.mark.parametrize("surplus", [1, 64, 65, 1000])
def test_any_number_of_surplus_fields_raises(spark, tmp_path, surplus):
    (tmp_path / "a.csv").write_text("a,b\n1,2" + "," * surplus + "\n3,4" + "," * surplus + "LOST\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        scan_csv(spark, str(tmp_path / "a.csv"))[0].collect()
    (tmp_path / "a.csv").write_text("a,b\n1,2" + ',""' * surplus + "\n")
    assert cells_of(scan_csv(spark, str(tmp_path / "a.csv"))[0]) == [("1", "2")]


def test_repeated_header_names_are_checked_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,a\n1,2\n")
    (tmp_path / "b.csv").write_text("a,a\n3,4\n")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).df.collect())) == [(1, 1, 2), (2, 3, 4)]
    (tmp_path / "c.csv").write_text("a,b\n5,6\n")
    with pytest.raises(Exception, match="another header"):
        scan_csv(spark, str(tmp_path))[0].collect()


def test_blank_lines_an_open_quote_and_no_final_line_feed(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n\r\n1,"x\r\n\r\ny"\r\n\n2,"open')
    df, n = scan_csv(spark, str(tmp_path / "a.csv"))
    assert n == 2 and cells_of(df)[0] == ("1", "x\r\n\r\ny")
    (tmp_path / "e.csv").write_text("")
    assert scan_csv(spark, str(tmp_path / "e.csv"))[0].count() == 0


def test_states_are_those_of_following_the_lines_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        whole, closing, blank = (rng.random(n) < p for p in (0.6, 0.4, 0.2))
        for inside in (False, True):
            into, out, number = passed(whole, closing, blank, inside, 5)
            state, k = inside, 5
            for i in range(n):
                assert into[i] == state
                k += not state and not blank[i]
                state = not (closing[i] if state else whole[i])
                assert out[i] == state and number[i] == k
