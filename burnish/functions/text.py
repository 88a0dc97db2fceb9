"""Text expressions Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_all(value: Column) -> Column:
    """Strip every kind of white space; ``trim`` strips spaces only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def title_case(value: Column) -> Column:
    """Capital after everything that has no case; ``initcap`` looks at spaces only."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), ""
    )


def plain_number(value: Column, dtype: T.DataType) -> Column:
    """A number as text without an exponent between 1e-4 and 1e16."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value.cast("string")
    java = value.cast("string")
    size = F.abs(value)
    whole = F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0"))
    fraction = F.regexp_replace(java.cast("decimal(38,20)").cast("string"), "0+$", "")
    return (
        F.when((size >= 1e7) & (size < 1e16), F.when(value == F.floor(value), whole).otherwise(fraction))
        .when((size >= 1e-4) & (size < 1e-3), fraction)
        .otherwise(java)
    )


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    """A cell as it stands in an INSERT statement."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        shown = plain_number(value, dtype)
    else:
        shown = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(shown, F.lit("NULL"))
