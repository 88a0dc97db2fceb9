"""Cleaning operators: table in, table out.

Rows are never computed while operators are chained. An operator that needs a
statistic (a fill value, outlier bounds) computes it when applied, as one bounded
aggregate, and puts it in the plan as a constant. That keeps the plan of a long
chain as long as the chain; statistics nested as subqueries would double it at
every step. It also fixes the value, so every evaluation of the plan agrees on it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import NUMBER_PATTERN, col
from burnish.functions.text import title_case, trim_all
from burnish.operators.profile import duplicate_count
from burnish.operators.quantiles import column_quantiles
from burnish.table import NUMERIC, ROW_ID, PrepTable

CASES = {"trim": trim_all, "upper": F.upper, "lower": F.lower, "title": title_case}
STRATEGIES = ("mean", "median", "mode", "custom")

# Fixed value: the usual fence of the quartile rule.
FENCE = 1.5


def as_number(value) -> float | None:
    """A parameter read as a number, by the rule that holds for cells."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return float(value) if re.match(NUMBER_PATTERN, value, re.ASCII) else None


def _set(t: PrepTable, name: str, value: Column) -> DataFrame:
    return t.df.select(*[value.alias(c) if c == name else col(c) for c in t.df.columns])


def _numeric_type(t: PrepTable, name: str) -> bool:
    return isinstance(t.dtype(name), T.NumericType)


def _store_number(t: PrepTable, name: str, value: float | None) -> tuple[Column, Column]:
    """The column and a new number for it, in a type that holds both."""
    if value is None:
        return col(name), F.lit(None).cast(t.dtype(name))
    whole = math.isfinite(value) and value == int(value) and abs(value) < 2**53
    if isinstance(t.dtype(name), T.IntegralType) and whole:
        return col(name).cast("long"), F.lit(int(value)).cast("long")
    return col(name).cast("double"), F.lit(value)


def remove_duplicates(t: PrepTable) -> PrepTable:
    """Keep the first of each set of equal rows.

    A grouping, not a window: equal rows meet already in the map-side aggregation,
    so a row copied a billion times costs one entry per task.
    """
    if not t.has_row_ids:
        return t.with_df(t.df.distinct())
    keys = [col(c) for c in t.columns]
    first = t.df.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID))
    return t.with_df(first.select(*[col(c) for c in t.df.columns]), dense=False)


def drop_missing(t: PrepTable, column: str) -> PrepTable:
    t.require(column)
    return t.with_df(t.df.filter(col(column).isNotNull()), dense=False)


def fill_value(t: PrepTable, column: str, strategy: str, exact: bool = True) -> DataFrame:
    """The statistic a fill uses, as a table of one row."""
    t.require(column)
    if strategy == "mean":
        return t.df.agg(F.avg(t.number(column)).alias("value"))
    if strategy == "median":
        return column_quantiles(t, column, {"value": 0.5}, exact)
    if strategy == "mode":
        present = t.df.filter(col(column).isNotNull()).groupBy(col(column).alias("value"))
        return present.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1).select("value")
    raise ValueError(f"unsupported strategy: {strategy}")


def fill_missing(t: PrepTable, column: str, strategy: str, value=None, exact: bool = True) -> PrepTable:
    """Fill missing cells with the mean, median, mode or a given value.

    Mean and median do nothing on a column without numbers; mode takes the
    smallest of equally frequent values.
    """
    t.require(column)
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy: {strategy}")
    c = col(column)
    if strategy == "custom":
        n = as_number(value) if t.kind(column) == NUMERIC else None
        if n is not None and _numeric_type(t, column):
            old, new = _store_number(t, column, n)
            return t.with_df(_set(t, column, F.coalesce(old, new)))
        return t.with_df(_set(t, column, F.coalesce(t.text(column), F.lit("" if value is None else str(value)))))
    found = fill_value(t, column, strategy, exact).first()
    stat = None if found is None else found["value"]
    is_text = isinstance(t.dtype(column), T.StringType)
    if stat is None and strategy == "mode" and is_text:
        stat = ""
    if stat is None:
        return t
    if strategy == "mode" or is_text:
        return t.with_df(_set(t, column, F.coalesce(c, F.lit(stat).cast(t.dtype(column)))))
    return t.with_df(_set(t, column, F.coalesce(t.number(column), F.lit(stat))))


def drop_column(t: PrepTable, column: str) -> PrepTable:
    t.require(column)
    kinds = {k: v for k, v in t.kinds.items() if k != column}
    return t.with_df(t.df.select(*[col(c) for c in t.df.columns if c != column]), kinds=kinds)


def rename_column(t: PrepTable, column: str, new_name: str) -> PrepTable:
    """Rename in place; position and kind stay."""
    t.require(column)
    if not new_name or new_name in t.df.columns:
        raise ValueError(f"cannot rename {column} to {new_name!r}: empty or taken")
    df = t.df.select(*[col(c).alias(new_name) if c == column else col(c) for c in t.df.columns])
    return t.with_df(df, kinds={new_name if k == column else k: v for k, v in t.kinds.items()})


def _replacement(t: PrepTable, column: str, find: str, substitute: str) -> tuple[Column, Column, Column]:
    """The column, which cells match, and what they become."""
    c = col(column)
    gone = substitute in ("", None)
    f, s = as_number(find), None if gone else as_number(substitute)
    if t.kind(column) == NUMERIC and f is not None and (gone or s is not None):
        hit = F.coalesce(t.number(column) == F.lit(f), F.lit(False))
        if _numeric_type(t, column):
            old, new = _store_number(t, column, s)
            return old, hit, new
        return t.text(column), hit, F.lit(None if gone else str(substitute)).cast("string")
    if _numeric_type(t, column):
        return c, F.lit(False), c
    hit = F.coalesce(t.text(column) == F.lit(str(find)), F.lit(False))
    return t.text(column), hit, F.lit(None if gone else str(substitute)).cast("string")


def replace_values(t: PrepTable, column: str, find: str, substitute: str = "") -> PrepTable:
    """Replace cells equal to ``find``; an empty substitute clears them.

    Numeric columns compare by value when both parameters are numbers.
    """
    t.require(column)
    old, hit, new = _replacement(t, column, find, substitute)
    return t.with_df(_set(t, column, F.when(hit, new).otherwise(old)))


def standardize_strings(t: PrepTable, column: str, case: str) -> PrepTable:
    """Trim white space or change case; missing cells stay missing."""
    t.require(column)
    if case not in CASES:
        raise ValueError(f"unsupported string operation: {case}")
    return t.with_df(_set(t, column, CASES[case](t.text(column))))


def outlier_bounds(t: PrepTable, column: str, multiplier: float = FENCE, exact: bool = True) -> DataFrame:
    """One row: quartiles and the inclusive bounds a value must keep to."""
    t.require(column)
    if t.kind(column) != NUMERIC:
        raise ValueError(f"column {column} is not numeric")
    q = column_quantiles(t, column, {"q1": 0.25, "q3": 0.75}, exact)
    reach = (F.col("q3") - F.col("q1")) * F.lit(float(multiplier))
    return q.select("q1", "q3", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def _inside(t: PrepTable, column: str, multiplier: float, exact: bool) -> Column:
    bounds = outlier_bounds(t, column, multiplier, exact).first()
    x = t.number(column)
    if bounds is None or bounds["lower"] is None:
        return x.isNull()
    return x.isNull() | ((x >= F.lit(bounds["lower"])) & (x <= F.lit(bounds["upper"])))


def remove_outliers(t: PrepTable, column: str, multiplier: float = FENCE, exact: bool = True) -> PrepTable:
    """Keep rows within the quartile fences, and rows that hold no number."""
    return t.with_df(t.df.filter(_inside(t, column, multiplier, exact)), dense=False)


def affected(t: PrepTable, action: str, **params) -> DataFrame:
    """How many rows or cells an operator would touch, as one row."""
    column = params.get("column")
    if column is not None:
        t.require(column)
    if action == "remove_duplicates":
        return duplicate_count(t).select(F.col("duplicates").alias("affected"))
    if action == "drop_missing":
        return t.df.agg(F.count_if(col(column).isNull()).alias("affected"))
    if action == "fill_missing":
        missing = F.count_if(col(column).isNull())
        if params["strategy"] in ("mean", "median"):
            missing = F.when(F.count(t.number(column)) > 0, missing).otherwise(0)
        return t.df.agg(missing.cast("long").alias("affected"))
    if action == "replace_values":
        hit = _replacement(t, column, params["find"], params.get("substitute", ""))[1]
        return t.df.agg(F.count_if(hit).alias("affected"))
    if action == "remove_outliers":
        inside = _inside(t, column, params.get("multiplier", FENCE), params.get("exact", True))
        return t.df.filter(~inside).agg(F.count("*").alias("affected"))
    if action == "standardize_strings":
        changed = ~CASES[params["case"]](t.text(column)).eqNullSafe(t.text(column))
        return t.df.agg(F.count_if(changed).alias("affected"))
    if action in ("drop_column", "rename_column"):
        return t.df.agg(F.count("*").alias("affected"))
    raise ValueError(f"unsupported operation: {action}")
