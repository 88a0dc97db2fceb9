"""The tables of a data quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.profile import profile, table_size, table_summary
from burnish.table import PrepTable


def report_summary(t: PrepTable) -> DataFrame:
    """Shape, missing cells, duplicates, score, size and completeness as one row."""
    s = table_summary(t)
    return s.withColumn("size_kb", table_size(t).scalar()).withColumn(
        "completeness_pct", F.bround(100 - F.col("missing_pct"), 2)
    )


def report_schema(t: PrepTable, exact: bool = True) -> DataFrame:
    """One line per column: number, name, kind, completeness, uniques and mean."""
    return profile(t, exact).select(
        (F.col("position") + 1).alias("number"),
        "name",
        "kind",
        F.bround(100 - F.col("missing_pct"), 1).alias("complete_pct"),
        "unique",
        F.bround("mean", 4).alias("mean"),
    )


def report_activity(log: DataFrame) -> DataFrame:
    """The operation log in order, or one line saying that there is none."""
    if log.isEmpty():
        spark = log.sparkSession
        none = [(0, "No operations", "The table is as it was loaded.", None)]
        return spark.createDataFrame(none, "id long, title string, description string, at timestamp")
    return log.orderBy("id")
