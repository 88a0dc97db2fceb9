"""Row numbers without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.functions.cells import col, fresh
from burnish.session import scratch_path
from burnish.table import ROW_ID

CELLS = 65_536
MIN_WIDTH = 4_096
BROADCAST_FILES = 100_000


def _running_before(counts: DataFrame, order: list[Column], n: str, out: str) -> DataFrame:
    """Rows before each entry of a small table of counts."""
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def renumber(df: DataFrame) -> DataFrame:
    """Make ``_rowId`` run 1..n in its present order.

    Ids fall into at most 65,537 equal-width cells. A cell's rows are numbered in
    their own window and shifted by the rows in earlier cells. Ids are unique, so
    no cell can hold more rows than its width, whatever the data looks like, and
    the shifts are a broadcast of bounded size.
    """
    names = [c for c in df.columns if c != ROW_ID]
    cell, n, before, at = fresh(names, "_cell", "_n", "_before", "_at")
    top = df.agg(F.max(ROW_ID)).scalar()
    width = F.greatest(F.ceil(top / F.lit(CELLS)), F.lit(MIN_WIDTH))
    celled = df.withColumn(cell, F.floor(F.col(ROW_ID) / width))
    counts = celled.groupBy(cell).agg(F.count("*").alias(n))
    shifts = _running_before(counts, [F.col(cell)], n, before).select(cell, before)
    within = Window.partitionBy(cell).orderBy(ROW_ID)
    return (
        celled.withColumn(at, F.row_number().over(within))
        .join(F.broadcast(shifts), cell)
        .select((F.col(before) + F.col(at)).alias(ROW_ID), *[col(c) for c in names])
    )


def positions(df: DataFrame, ids: list[int]) -> dict[int, int]:
    """The places, from 1, of a few row ids in a table with gaps: one count, no shuffle of rows."""
    asked = sorted(set(ids))
    if not asked:
        return {}
    below = F.size(F.filter(F.array(*[F.lit(i).cast("long") for i in asked]), lambda i: i < F.col(ROW_ID)))
    found = {r["below"]: r["n"] for r in df.groupBy(below.alias("below")).agg(F.count("*").alias("n")).collect()}
    out, seen = {}, 0
    for k, i in enumerate(asked):
        seen += found.get(k, 0)
        out[i] = seen
    return out


def file_row_ids(df: DataFrame) -> DataFrame:
    """Number the rows of a parquet scan in file order.

    The reader knows each row's place in its file, so only the row counts per
    file are computed: no sort and no shuffle of the rows.
    """
    names = df.columns
    file, at, n, before = fresh(names, "_file", "_at", "_n", "_before")
    tagged = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    n_files = len(df.inputFiles())
    if n_files <= 1:
        return tagged.select((F.col(at) + 1).alias(ROW_ID), *[col(c) for c in names])
    folder = F.regexp_replace(file, "[^/]*$", "")
    part = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    counts = tagged.groupBy(file).agg(F.count("*").alias(n))
    shifts = _running_before(counts, [folder, part, F.col(file)], n, before).select(file, before)
    if n_files <= BROADCAST_FILES:
        shifts = F.broadcast(shifts)
    return tagged.join(shifts, file).select(
        (F.col(before) + F.col(at) + 1).alias(ROW_ID), *[col(c) for c in names]
    )


def number_rows(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """Number rows by any sort order.

    The rows are range partitioned, sorted and written once to the shared folder;
    the copy is then numbered by file position. The order must be total (end it
    with a unique column), which also lets a hot leading value spread over ranges.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    df = df.drop(ROW_ID)
    df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).write.parquet(path)
    return file_row_ids(spark.read.schema(df.schema).parquet(path))
