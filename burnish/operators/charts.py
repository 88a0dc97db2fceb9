"""The data behind each chart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import col, parse_date
from burnish.operators.clean import FENCE
from burnish.operators.cross import wide_correlation
from burnish.operators.grid import filter_equals
from burnish.operators.quantiles import group_quantiles
from burnish.operators.skew import attach
from burnish.table import DATE, NUMERIC, ROW_ID, PrepTable

# Fixed value: bars of a histogram.
BINS = 10

# Pairs up to which correlations are aggregates side by side.
FEW_PAIRS = 300

_ALL = "all"


def where(t: PrepTable, column: str = "", value: str = "") -> PrepTable:
    """The rows a chart is drawn over: all, or those equal to a value."""
    return filter_equals(t, column, value) if column and value else t


def _label(t: PrepTable, x: str) -> Column:
    return t.text(x).alias("x")


def bar(t: PrepTable, x: str, y: str = "") -> DataFrame:
    """Mean of a numeric ``y`` for each ``x``; without one, the rows for each ``x``."""
    t.require(x, *([y] if y else []))
    rows = t.df.filter(col(x).isNotNull())
    if y:
        rows = rows.filter(col(y).isNotNull())
    if y and t.kind(y) == NUMERIC:
        return rows.groupBy(_label(t, x)).agg(F.avg(t.number(y)).alias("mean"))
    return rows.groupBy(_label(t, x)).agg(F.count("*").alias("count"))


def pie(t: PrepTable, x: str) -> DataFrame:
    """Rows and share for each ``x``."""
    t.require(x)
    counts = t.df.filter(col(x).isNotNull()).groupBy(_label(t, x)).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / counts.agg(F.sum("count")).scalar())


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin; the last one is closed, and no width makes one bin."""
    at = F.floor((x - lo) / ((hi - lo) / F.lit(bins)))
    return F.when(hi > lo, F.least(F.lit(bins - 1), at)).otherwise(F.lit(0)).cast("long")


def histogram(t: PrepTable, x: str, bins: int = BINS) -> DataFrame:
    """Rows in each of the bins, empty ones included, with the bin's edges; no bin without a number."""
    t.require(x)
    rows = t.df.select(t.number(x).alias("x")).filter("x IS NOT NULL")
    ends = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    counts = rows.groupBy(_bin(F.col("x"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("count"))
    # a column of one value has one bin, as no width can be cut
    every = t.df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    every = every.filter((hi > lo) | ((hi == lo) & (F.col("bin") == 0)))
    width = (hi - lo) / F.lit(bins)
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("from"),
        (lo + (F.col("bin") + 1) * width).alias("to"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def scatter(t: PrepTable, x: str, y: str) -> DataFrame:
    """All pairs in which both cells are numbers."""
    t.require(x, y)
    pairs = t.df.select(t.number(x).alias("x"), t.number(y).alias("y"))
    return pairs.filter("x IS NOT NULL AND y IS NOT NULL")


def scatter_binned(t: PrepTable, x: str, y: str, bins: int = 50) -> DataFrame:
    """Pairs counted on a grid: a picture of bounded size for any number of rows."""
    pairs = scatter(t, x, y)
    ends = pairs.agg(
        F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    ).scalar()
    xb = _bin(F.col("x"), ends.getField("x0"), ends.getField("x1"), bins).alias("x_bin")
    yb = _bin(F.col("y"), ends.getField("y0"), ends.getField("y1"), bins).alias("y_bin")
    return pairs.groupBy(xb, yb).agg(F.count("*").alias("count"))


def line(t: PrepTable, x: str, y: str) -> DataFrame:
    """Pairs in order of ``x``, a number or a date."""
    t.require(x, y)
    if t.kind(x) == DATE:
        key = parse_date(col(x)) if isinstance(t.dtype(x), T.StringType) else col(x)
    else:
        key = t.number(x)
    ties = [F.col(ROW_ID)] if t.has_row_ids else []
    pairs = t.df.select(key.alias("x"), t.number(y).alias("y"), *ties)
    return pairs.filter("x IS NOT NULL AND y IS NOT NULL").orderBy("x", *ties)


def _box_rows(t: PrepTable, y: str, x: str) -> DataFrame:
    t.require(y, *([x] if x else []))
    label = t.text(x) if x else F.lit(_ALL)
    rows = t.df.select(label.alias("x"), t.number(y).alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL")


def _fenced(t: PrepTable, rows: DataFrame) -> DataFrame:
    """Each value beside its group's quartiles and fences."""
    at_most = t.bound()
    q = group_quantiles(rows, ["x"], "y", at_most=at_most)
    reach = (F.col("q3") - F.col("q1")) * FENCE
    fences = q.withColumn("fence_low", F.col("q1") - reach).withColumn("fence_high", F.col("q3") + reach)
    return attach(rows, fences, ["x"], at_most=at_most)


def box(t: PrepTable, y: str, x: str = "") -> DataFrame:
    """Quartiles, whiskers (last values within the fences) and outliers for each ``x``."""
    y_ = F.col("y")
    inside = (y_ >= F.col("fence_low")) & (y_ <= F.col("fence_high"))
    return (
        _fenced(t, _box_rows(t, y, x))
        .groupBy("x")
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, y_)).alias("whisker_low"),
            F.max(F.when(inside, y_)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def box_outliers(t: PrepTable, y: str, x: str = "") -> DataFrame:
    """The single points a box chart draws beyond its whiskers."""
    beyond = (F.col("y") < F.col("fence_low")) | (F.col("y") > F.col("fence_high"))
    return _fenced(t, _box_rows(t, y, x)).filter(beyond).select("x", "y")


def correlation(t: PrepTable) -> DataFrame:
    """Pearson correlation of every two numeric columns over rows that hold both.

    One scan, without a shuffle of rows: few pairs are aggregates side by side, more
    are cross products of blocks of rows. A constant column has no correlation (null).
    """
    names = t.columns_of(NUMERIC)
    if len(names) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    values = t.df.select(*[t.number(c).alias(f"_{i}") for i, c in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    if len(pairs) > FEW_PAIRS:
        return wide_correlation(values, names)
    aggs, entries = [], []
    for i, j in pairs:
        a, b = F.col(f"_{i}"), F.col(f"_{j}")
        both = a.isNotNull() & b.isNotNull()
        spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
        aggs.append(F.try_divide(F.covar_pop(a, b), spread).alias(f"r{i}_{j}"))
        r = F.col(f"r{i}_{j}").alias("r")
        entries.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), r))
        entries.append(F.struct(F.lit(names[j]).alias("a"), F.lit(names[i]).alias("b"), r))
    out = values.agg(*aggs).select(F.inline(F.array(*entries)))
    spreads = values.agg(*[F.stddev_pop(f"_{i}").alias(f"s{i}") for i in range(len(names))])
    diagonal = [
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"s{i}") > 0, 1.0).alias("r"))
        for i, c in enumerate(names)
    ]
    return out.unionByName(spreads.select(F.inline(F.array(*diagonal))))
