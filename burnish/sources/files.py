"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from burnish.functions.cells import NA_TOKENS, strip_missing
from burnish.operators.rank import file_row_ids
from burnish.sources.inference import infer
from burnish.table import PrepTable


def read_parquet(
    spark: SparkSession, path: str, row_ids: bool = True, infer_text: bool = False, name: str = ""
) -> PrepTable:
    """Load a typed table.

    Row ids follow file order and cost no shuffle. ``infer_text`` treats text
    columns as a delimited file's: missing tokens, types and kinds by value.
    """
    df = spark.read.parquet(path)
    rows = df.count()
    if row_ids:
        df = file_row_ids(df)
    name = name or path.rstrip("/").split("/")[-1]
    if infer_text:
        return infer(strip_missing(df, NA_TOKENS), name, at_most=rows)
    return PrepTable.of(df, name, at_most=rows, dense=True)
