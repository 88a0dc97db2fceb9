"""CSV, JSON and SQL writers: one folder of part files each, without row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import col
from burnish.functions.text import plain_number, sql_literal
from burnish.table import ROW_ID, PrepTable

FORMATS = ("csv", "json", "sql")
PREVIEW_ROWS = 10


def _rows(t: PrepTable, ordered: bool) -> DataFrame:
    """The data columns, in row order if asked; part files then follow that order."""
    df = t.df.orderBy(ROW_ID) if ordered and t.has_row_ids else t.df
    return df.select(*[col(c) for c in t.columns])


def _cell_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return plain_number(col(name), dtype)
    return col(name).cast("string")


def _csv_options(delimiter: str, header: bool) -> dict:
    return {
        "sep": "\t" if delimiter == "\\t" else delimiter,
        "header": header,
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        "nullValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[_cell_text(df, c).alias(c) for c in df.columns])


def write_csv(
    t: PrepTable, path: str, delimiter: str = ",", header: bool = True, ordered: bool = True, mode: str = "error"
) -> None:
    texts, options = _as_text(_rows(t, ordered)), _csv_options(delimiter, header)
    if len(t.columns) == 1:
        # a missing cell alone on its line would be a blank line, which readers skip
        (name,) = texts.columns
        texts, options = texts.select(F.coalesce(col(name), F.lit("")).alias(name)), options | {"emptyValue": '""'}
    texts.write.mode(mode).csv(path, **options)


def write_json(t: PrepTable, path: str, ordered: bool = True, mode: str = "error") -> None:
    """One record per line, missing cells kept as nulls."""
    _rows(t, ordered).write.mode(mode).json(path, ignoreNullFields=False)


def _insert(df: DataFrame, table: str) -> Column:
    quoted = ", ".join("`" + c.replace("`", "``") + "`" for c in df.columns)
    values: list[Column] = []
    for f in df.schema.fields:
        values += [F.lit(", "), sql_literal(col(f.name), f.dataType)]
    return F.concat(F.lit(f"INSERT INTO {table} ({quoted}) VALUES ("), *values[1:], F.lit(");")).alias("value")


def insert_statements(t: PrepTable, table: str = "prepared_dataset", ordered: bool = False) -> DataFrame:
    """One INSERT statement per row."""
    df = _rows(t, ordered)
    return df.select(_insert(df, table))


def write_sql(
    t: PrepTable, path: str, table: str = "prepared_dataset", ordered: bool = True, mode: str = "error"
) -> None:
    """A script of INSERT statements; three comment lines open the first part file."""
    spark = t.df.sparkSession
    body = insert_statements(t, table, ordered)
    head = spark.range(1).select(
        F.explode(
            F.array(
                F.lit("-- SQL insert script"),
                F.lit(f"-- Table name: {table}"),
                F.concat(F.lit("-- Rows: "), t.df.agg(F.count("*")).scalar().cast("string")),
            )
        ).alias("value")
    )
    head.coalesce(1).union(body).write.mode(mode).text(path)


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """Rows as CSV text, quoted the way the writer quotes."""
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _csv_options(delimiter, False).items()}
    texts = _as_text(df)
    return texts.select(F.to_csv(F.struct(*[col(c) for c in texts.columns]), options).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    record = F.struct(*[col(c) for c in df.columns])
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def preview(
    t: PrepTable, format: str, delimiter: str = ",", header: bool = True, table: str = "prepared_dataset",
    rows: int = PREVIEW_ROWS,
) -> DataFrame:
    """The first lines an export would hold."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    t.require_row_ids()
    df = t.df.orderBy(ROW_ID).limit(rows).select(*[col(c) for c in t.columns])  # a top-k: every task passes on a few rows
    if format == "json":
        return json_lines(df)
    if format == "sql":
        return df.select(_insert(df, table))
    lines = csv_lines(df, delimiter)
    if not header:
        return lines
    names = t.df.sparkSession.range(1).select(F.lit(delimiter.join(t.columns)).alias("value"))
    return names.union(lines)
