"""Keeping hot groups out of single tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.session import checkpointed

HOT_ROWS = 1_000_000

#: A table of at most so many short rows is broadcast; a larger one joins by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its row count, which is looked up, allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_groups(rows: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups with over ``hot_rows`` rows, written once: the keys and ``_n``, the rows of the group."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return checkpointed(counts.filter(F.col("_n") > hot_rows), "hot")


def attach(
    rows: DataFrame, per_group: DataFrame, by: list[str], hot_rows: int = HOT_ROWS, at_most: int | None = None
) -> DataFrame:
    """Join rows to a table with one row per group.

    Rows of hot groups meet a broadcast of the hot groups' entries and are never
    shuffled, unless hot groups are too many for that; then none of them holds a large
    share of the rows. The rest join by shuffle. ``at_most`` is a known bound on the
    rows; within ``hot_rows`` a plain join does.
    """
    if at_most is not None and at_most <= hot_rows:
        return rows.join(per_group, by)
    hot = small(hot_groups(rows, by, hot_rows).select(*by))
    hot_side = small(checkpointed(per_group.join(hot, by, "left_semi"), "hot"))
    cold = rows.join(hot, by, "left_anti").join(per_group.join(hot, by, "left_anti"), by)
    return rows.join(hot_side, by).unionByName(cold)
