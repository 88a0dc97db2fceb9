"""Point edits, applied as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import col, fresh, parse_number
from burnish.session import checkpointed
from burnish.sources.inference import WHOLE_PATTERN
from burnish.table import NUMERIC, ROW_ID, PrepTable

EDIT_SCHEMA = f"{ROW_ID} long, column string, value string, seq long"


def _cleared(value: Column) -> Column:
    """An edit's text; some texts clear the cell."""
    clears = value.isin("", "[NULL]") | F.upper(value).isin("NAN", "NULL")
    return F.when(~clears, value)


def _store(t: PrepTable, name: str, numbers: bool | None, wholes: bool | None) -> tuple[Column, T.DataType]:
    """How an edited text is stored, and the type that holds old and new cells.

    ``numbers`` and ``wholes`` tell whether all its new texts are such, null without texts.
    """
    dtype = t.dtype(name)
    value = F.col("value")
    if isinstance(dtype, T.StringType):
        return value, dtype
    if t.kind(name) != NUMERIC or not isinstance(dtype, T.NumericType) or numbers is False:
        return value, T.StringType()
    if isinstance(dtype, T.IntegralType) and wholes is not False:
        return F.trim(value).try_cast("long"), T.LongType()
    return parse_number(value), T.DoubleType()


def apply_edits(t: PrepTable, edits: DataFrame) -> PrepTable:
    """Set cells by (row id, column); the highest ``seq`` for a cell wins.

    ``edits`` has ``_rowId, column, value, seq``. A numeric column takes numbers;
    a text that is none turns the column into text and leaves its kind. Edits of
    rows or columns that do not exist are left out, see ``rejected_edits``.
    """
    t.require_row_ids()
    t = t.numbered()
    edits = edits.filter(F.col("column").isin(*t.columns)).withColumn("value", _cleared(F.col("value")))
    # an edit that loses, or whose row does not exist, changes nothing, types included
    won = edits.groupBy(ROW_ID, "column").agg(F.max(F.struct("seq", "value")).alias("last"))
    last = won.select(ROW_ID, "column", "last.seq", "last.value").join(t.df.select(ROW_ID), ROW_ID, "left_semi")
    # read for the types and again for the cells
    edits = checkpointed(last, "edits")
    value = F.col("value")
    texts = edits.withColumn("number", F.when(value.isNotNull(), parse_number(value).isNotNull()))
    texts = texts.withColumn("whole", F.when(value.isNotNull(), value.rlike(WHOLE_PATTERN)))
    types = texts.groupBy("column").agg(F.every("number").alias("numbers"), F.every("whole").alias("wholes"))
    touched = {r["column"]: (r["numbers"], r["wholes"]) for r in types.collect()}  # at most the table's columns
    if not touched:
        return t
    aggs, out = [], {}
    for i, name in enumerate(c for c in t.columns if c in touched):
        stored, dtype = _store(t, name, *touched[name])
        latest = F.max(F.when(F.col("column") == name, F.struct("seq", stored.alias("value"))))
        (edited,) = fresh(t.columns, f"_e{i}")
        aggs.append(latest.alias(edited))
        edit = F.col(edited)
        out[name] = F.when(edit.isNotNull(), edit["value"].cast(dtype)).otherwise(
            t.text(name) if isinstance(dtype, T.StringType) else col(name).cast(dtype)
        )
    per_row = edits.groupBy(ROW_ID).agg(*aggs)
    joined = t.df.join(per_row, ROW_ID, "left")
    return t.with_df(joined.select(*[out[c].alias(c) if c in out else col(c) for c in t.df.columns]))


def rejected_edits(t: PrepTable, edits: DataFrame) -> DataFrame:
    """Edits that name no row or no column of the table."""
    t = t.numbered()
    unknown_column = edits.filter(~F.col("column").isin(*t.columns))
    unknown_row = edits.filter(F.col("column").isin(*t.columns)).join(t.df.select(ROW_ID), ROW_ID, "left_anti")
    return unknown_column.withColumn("reason", F.lit("unknown column")).unionByName(
        unknown_row.withColumn("reason", F.lit("unknown row"))
    )
