"""Column types and kinds from the values, over all rows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import NESTED, TEMPORAL, col, parse_date, parse_number
from burnish.table import CATEGORICAL, DATE, NUMERIC, ROW_ID, PrepTable

# Fixed value: the share of values above which a column has a kind.
MAJORITY = 0.8

WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"


def _reads_as(c: Column) -> Column:
    """The narrowest type a text reads as.

    The first character rules most tests out, which spares their regular expressions.
    """
    first = F.ascii(c)
    blank_or_digit = (first <= 32) | first.between(ord("0"), ord("9"))
    number = blank_or_digit | (first > 127) | first.isin(*map(ord, "+-.iI"))
    date = blank_or_digit | (first > 127) | first.between(ord("A"), ord("Z"))
    return (
        F.when(number & c.rlike(WHOLE_PATTERN) & F.trim(c).try_cast("long").isNotNull(), "whole")
        .when(number & parse_number(c).isNotNull(), "number")
        .when(first.isin(*map(ord, "tTfF")) & F.lower(c).isin("true", "false"), "boolean")
        .when(date & parse_date(c).isNotNull(), "date")
        .when(c.isNotNull(), "text")
    )


def _counts(df: DataFrame) -> DataFrame:
    """One row per column: values present, and how many read as each type.

    Cells are stacked as (position, text) and then read by one expression, however many
    columns there are: code for every column on its own grows beyond what the JVM
    compiles. A task passes on a handful of counts per column.
    """
    names = [c for c in df.columns if c != ROW_ID]
    entries, labels = [], []
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        if isinstance(dtype, NESTED):
            raise ValueError(f"column {name} is {dtype.simpleString()}; drop or flatten it first")
        c = col(name)
        if isinstance(dtype, T.StringType):
            cell, known = c, F.lit(None).cast("string")
        else:
            cell = F.lit(None).cast("string")
            known = F.when(c.isNotNull(), "date" if isinstance(dtype, TEMPORAL) else "number")
        entries.append(F.struct(F.lit(i).alias("position"), cell.alias("cell"), known.alias("known")))
        labels.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("name")))
    cells = df.select(F.inline(F.array(*entries)))
    reads_as = F.coalesce(F.col("known"), _reads_as(F.col("cell"))).alias("reads_as")
    seen = cells.groupBy("position", reads_as).agg(F.count("*").alias("n"))
    n = F.col("n")

    def total(*types: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("reads_as").isin(*types), n)), F.lit(0))

    found = seen.groupBy("position").agg(
        F.coalesce(F.sum(F.when(F.col("reads_as").isNotNull(), n)), F.lit(0)).alias("present"),
        total("whole", "number").alias("numbers"),
        total("whole").alias("wholes"),
        total("boolean").alias("booleans"),
        total("date").alias("dates"),
    )
    columns = df.sparkSession.range(1).select(F.inline(F.array(*labels)))
    out = columns.join(found, "position", "left").na.fill(0)
    return out.select("position", "name", "present", "numbers", "wholes", "booleans", "dates")


def _kind(present: Column, numbers: Column, dates: Column) -> Column:
    return (
        F.when(numbers > present * MAJORITY, NUMERIC)
        .when(dates > present * MAJORITY, DATE)
        .otherwise(CATEGORICAL)
    )


def infer_kinds(t: PrepTable) -> DataFrame:
    """The kind of each column, with the shares it was decided on.

    Numbers win over dates; a column with no values is categorical. Values that
    read as numbers are not tried as dates, which cannot change the outcome of a
    column that holds over four fifths dates.
    """
    present = F.col("present")

    def share(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c), present), F.lit(0.0))

    return _counts(t.df).select(
        "position",
        "name",
        _kind(present, F.col("numbers"), F.col("dates")).alias("kind"),
        "present",
        share("numbers").alias("numeric_share"),
        share("dates").alias("date_share"),
    )


def infer(df: DataFrame, name: str = "", at_most: int | None = None) -> PrepTable:
    """Give text columns the type all their values share, and every column a kind.

    Runs one aggregation; the driver sees a few counts per column.
    """
    if not [c for c in df.columns if c != ROW_ID]:
        raise ValueError("the table has no columns")
    found = {r["name"]: r for r in _counts(df).collect()}
    kinds, out = {}, []
    for field in df.schema.fields:
        c = col(field.name)
        if field.name == ROW_ID:
            out.append(c)
            continue
        r = found[field.name]
        n = r["present"]
        if r["numbers"] > n * MAJORITY:
            kinds[field.name] = NUMERIC
        elif r["dates"] > n * MAJORITY:
            kinds[field.name] = DATE
        else:
            kinds[field.name] = CATEGORICAL
        if isinstance(field.dataType, T.StringType) and n:
            if r["wholes"] == n:
                c = F.trim(c).cast("long")
            elif r["numbers"] == n:
                c = parse_number(c)
            elif r["booleans"] == n:
                kinds[field.name] = NUMERIC
                c = c.cast("boolean")
        out.append(c.alias(field.name))
    empty = all(r["present"] == 0 for r in found.values()) and df.isEmpty()
    return PrepTable(df.select(*out), {} if empty else kinds, name, at_most=at_most)


def reinfer(t: PrepTable) -> PrepTable:
    """Decide the kinds anew from the present values."""
    kinds = {r["name"]: r["kind"] for r in infer_kinds(t).select("name", "kind").collect()}
    return t.with_df(t.df, kinds=kinds)
