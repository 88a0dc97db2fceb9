"""Exact quantiles that never gather a large group in one place.

Groups of bounded size use the built-in ``percentile``, which keeps a group's distinct
values in one buffer. Hot groups take another way, also exact: cut the values into
ordered cells, count the cells, keep only the cells that hold a wanted rank, cut those
again, and sort what is left. Cells depend on the values alone (and on exact cell minima
and maxima), so every pass agrees on them. Each pass writes its few counts, so a column
is read four times, hot groups found included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.operators.skew import HOT_ROWS, hot_groups, small
from burnish.session import checkpointed
from burnish.table import PrepTable

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

_FINE = 65_535


def _coarse_cell(x: Column) -> Column:
    """An ordered cell of about 1.5 per cent relative width; under 100,000 cells."""
    size = F.least(F.log1p(F.abs(x)) * 64, F.lit(1e6))
    return F.when(x < 0, -F.floor(size) - 1).otherwise(F.floor(size))


def _fine_cell(x: Column) -> Column:
    lo, hi = F.col("_lo"), F.col("_hi")
    return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * _FINE)).otherwise(F.lit(0).cast("long"))


def _locate(counts: DataFrame, keys: list[str], step: str, targets: DataFrame) -> DataFrame:
    """Find the entry of each group that holds each wanted rank.

    ``counts`` has the keys, an ordered ``step`` and ``_m`` rows for it; ``targets``
    has the keys and ``_r``, a 0-based rank within the group. ``_r`` comes back
    relative to the entry found.
    """
    upto = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum("_m").over(upto))
    hit = (F.col("_r") >= F.col("_end") - F.col("_m")) & (F.col("_r") < F.col("_end"))
    found = ends.join(targets, keys).filter(hit)
    return found.withColumn("_r", F.col("_r") - F.col("_end") + F.col("_m")).drop("_end", "_m")


def _hot_quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float], hot: DataFrame) -> DataFrame:
    """The cell-by-cell way, for groups of any size."""
    x = F.col(value)
    wanted = []
    for i, p in enumerate(probs.values()):
        place = (F.col("_n") - 1) * F.lit(p)
        low = F.floor(place)
        wanted.append(F.struct(F.lit(i).alias("_i"), F.lit(0).alias("_w"), low.alias("_r")))
        wanted.append(
            F.struct(F.lit(i).alias("_i"), F.lit(1).alias("_w"), F.least(low + 1, F.col("_n") - 1).alias("_r"))
        )
    targets = hot.select(*by, "_n", F.inline(F.array(*wanted)))

    mine = rows.join(small(hot.select(*by)), by).withColumn("_c1", _coarse_cell(x))
    coarse = mine.groupBy(*by, "_c1").agg(F.count("*").alias("_m"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at1 = checkpointed(_locate(coarse, by, "_c1", targets), "coarse")

    keys1 = [*by, "_c1"]
    in1 = mine.join(small(at1.select(*keys1, "_lo", "_hi").distinct()), keys1)
    in1 = in1.withColumn("_c2", _fine_cell(x)).drop("_lo", "_hi")
    fine = in1.groupBy(*keys1, "_c2").agg(F.count("*").alias("_m"))
    at2 = checkpointed(_locate(fine, keys1, "_c2", at1.drop("_lo", "_hi")), "fine")

    keys2 = [*keys1, "_c2"]
    in2 = in1.join(small(at2.select(*keys2).distinct()), keys2)
    distinct = in2.groupBy(*keys2, value).agg(F.count("*").alias("_m"))
    at3 = _locate(distinct, keys2, value, at2)

    out = []
    for i, (name, p) in enumerate(probs.items()):
        low = F.max(F.when((F.col("_i") == i) & (F.col("_w") == 0), x))
        high = F.max(F.when((F.col("_i") == i) & (F.col("_w") == 1), x))
        place = (F.max("_n") - 1) * F.lit(p)
        out.append(_between(low, high, place).alias(name))
    return at3.groupBy(*by).agg(*out)


def _between(low: Column, high: Column, place: Column) -> Column:
    part = place - F.floor(place)
    return F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part)


def _bounded_quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The direct way, for groups whose distinct values fit a buffer: one aggregation, no sort by group."""
    points = F.array(*[F.lit(float(p)) for p in probs.values()])
    q = rows.groupBy(*by).agg(F.percentile(value, points).alias("_q"))
    return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def group_quantiles(
    rows: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float] = QUARTILES,
    hot_rows: int = HOT_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` for each group.

    ``by`` must hold no nulls; null values are left out. One row per group, one
    column per entry of ``probs``. ``at_most`` is a known bound on the rows of any
    group; within ``hot_rows`` it spares the look for hot groups.
    """
    rows = rows.select(*by, F.col(value)).filter(F.col(value).isNotNull())
    if at_most is not None and at_most <= hot_rows:
        return _bounded_quantiles(rows, by, value, probs)
    hot = hot_groups(rows, by, hot_rows)
    cold = rows.join(small(hot.select(*by)), by, "left_anti")
    return _bounded_quantiles(cold, by, value, probs).unionByName(_hot_quantiles(rows, by, value, probs, hot))


def column_quantiles(
    t: PrepTable, name: str, probs: dict[str, float] = QUARTILES, exact: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Quantiles of one column as a single row; no row when it holds no number."""
    rows = t.df.select(F.lit(0).alias("_g"), t.number(name).alias("_x"))
    if not exact:
        points = F.array(*[F.lit(p) for p in probs.values()])
        q = rows.agg(F.percentile_approx("_x", points, 10_000).alias("_q"))
        return q.select(*[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    return group_quantiles(rows, ["_g"], "_x", probs, hot_rows, t.bound()).drop("_g")
