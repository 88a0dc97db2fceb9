import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish.functions import mix, parse_date, parse_number, plain_number, strip_missing, title_case, trim_all
from burnish.functions.cells import NA_TOKENS
from burnish.operators.clean import as_number
from pyspark.sql import types as T

NUMBERS = {
    " 12 ": 12.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "1e5": 1e5, "inf": float("inf"), "-Infinity": float("-inf"),
    "1d": None, "1f": None, "0x1F": None, "1,000": None, "1_000": None, "1e": None, ".": None, "true": None, "": None,
}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")


def values(df):
    return [r[0] for r in df.orderBy("i").select(df.columns[-1]).collect()]


def test_numbers_in_text(spark):
    df = column(spark, list(NUMBERS)).withColumn("x", parse_number(F.col("s")))
    assert values(df) == list(NUMBERS.values())
    assert [as_number(v) for v in NUMBERS] == list(NUMBERS.values())


def test_missing_tokens_and_near_misses(spark):
    out = values(strip_missing(column(spark, [*NA_TOKENS, "n.a.", "-", "  "]), NA_TOKENS))
    assert out[: len(NA_TOKENS)] == [None] * len(NA_TOKENS)
    assert out[len(NA_TOKENS) :] == ["n.a.", "-", "  "]


def test_tokens_are_those_of_pandas(tmp_path):
    for token in NA_TOKENS:
        path = tmp_path / "t.csv"
        path.write_text(f'a,b\n"{token}",1\n')
        assert pd.read_csv(path, na_values=["", " ", "NA", "N/A", "NaN", "null", "NULL"])["a"].isna().all(), token


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-01-15", "2024-01-15"), ("2024/1/5", "2024-01-05"), ("1/15/2024", "2024-01-15"),
        ("15/1/2024", "2024-01-15"), ("15.01.2024", "2024-01-15"), ("01-02-2024", "2024-01-02"),
        ("5 Jan 2024", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"), ("2024-01-15 10:20:30", "2024-01-15"),
        ("2024-13-01", None), ("12/12", None), ("abc", None), ("Jan 50, 2024", None),
    ],
)
def test_dates_in_text(spark, text, day):
    got = column(spark, [text]).select(F.date_format(parse_date(F.col("s")), "yyyy-MM-dd")).first()[0]
    assert got == day


def test_title_and_trim(spark):
    texts = ["o'neil-smith month-to-month 3d x", "", "ÉCOLE élan", "a", None]
    got = values(column(spark, texts).withColumn("t", title_case(F.col("s"))))
    assert got == [None if s is None else s.title() for s in texts]
    padded = ["\t a b \n", " x ", "plain", None]
    got = values(column(spark, padded).withColumn("t", trim_all(F.col("s"))))
    assert got == ["a b", "x", "plain", None]


def test_numbers_as_text(spark):
    xs = [12345678.0, 12345678.9, 0.0005, 1.5, -20000000.0, 1e20, 0.0, None]
    got = values(column(spark, xs, "double").withColumn("t", plain_number(F.col("s"), T.DoubleType())))
    assert got == ["12345678.0", "12345678.9", "0.0005", "1.5", "-20000000.0", "1.0E20", "0.0", None]


def test_hash_spreads_evenly(spark):
    h = spark.range(100_000).select((mix(F.col("id")) % 10).alias("b"))
    counts = [r["count"] for r in h.groupBy("b").count().collect()]
    assert len(counts) == 10 and max(counts) < 1.1 * min(counts)
