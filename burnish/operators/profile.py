"""Table summary, column profile and quality score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.cells import FLOATING, NESTED, TEMPORAL, col
from burnish.operators.quantiles import QUARTILES, group_quantiles
from burnish.table import NUMERIC, PrepTable

BLANK = "[Blank]"

# Penalties of the quality score and the score bands.
MISSING_PENALTY = 150
DUPLICATE_PENALTY = 200
GOOD, FAIR = 85, 60

# Rows in a value distribution; skew below which a column is symmetric.
TOP_VALUES = 15
SYMMETRIC = 0.2


def _long(t: PrepTable, cells: dict[str, Column], out: str) -> DataFrame:
    """Columns stacked as (position, value); nulls left out."""
    names = t.columns
    entries = [F.struct(F.lit(names.index(n)).alias("position"), c.alias(out)) for n, c in cells.items()]
    return t.df.select(F.inline(F.array(*entries))).filter(F.col(out).isNotNull())


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _percent(part: Column, whole: Column, places: int = 2) -> Column:
    """A share in percent, ties to the even digit; 0 of nothing."""
    return F.bround(_share(part * F.lit(100.0), whole), places)


def _missing_cells(t: PrepTable) -> Column:
    total = F.lit(0).cast("long")
    for c in t.columns:
        total = total + F.count_if(col(c).isNull())
    return total


def duplicate_count(t: PrepTable) -> DataFrame:
    """Rows equal to an earlier row on all data columns; missing equals missing."""
    groups = t.data.groupBy(*[col(c) for c in t.columns]).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def quality_band(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor")


def table_size(t: PrepTable) -> DataFrame:
    """Bytes of data held, in KB: fixed widths per row plus the length of each text."""
    fixed, texts = 0, F.lit(0).cast("long")
    for f in t.data.schema.fields:
        if isinstance(f.dataType, T.StringType):
            texts = texts + F.coalesce(F.sum(F.octet_length(col(f.name))), F.lit(0))
        elif isinstance(f.dataType, T.BooleanType):
            fixed += 1
        elif isinstance(f.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            fixed += 4
        else:
            fixed += 8
    return t.df.agg(F.bround((F.count("*") * fixed + texts) / 1024, 1).alias("size_kb"))


def table_summary(t: PrepTable) -> DataFrame:
    """One row: shape, missing cells, duplicates, quality score and band."""
    counts = t.df.agg(F.count("*").alias("rows"), _missing_cells(t).alias("missing_cells"))
    cells = F.col("rows") * len(t.columns)
    missing = _share(F.col("missing_cells") * F.lit(float(MISSING_PENALTY)), cells)
    repeated = _share(F.col("duplicates") * F.lit(float(DUPLICATE_PENALTY)), F.col("rows"))
    raw = F.lit(100) - missing - repeated
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0))).cast("long")
    return (
        counts.withColumn("duplicates", duplicate_count(t).scalar())
        .withColumn("quality_score", score)
        .select(
            "rows",
            F.lit(len(t.columns)).alias("columns"),
            "missing_cells",
            _percent(F.col("missing_cells"), cells).alias("missing_pct"),
            "duplicates",
            "quality_score",
            quality_band(F.col("quality_score")).alias("quality_band"),
        )
    )


def missing_profile(t: PrepTable) -> DataFrame:
    """One row per column: kind, rows, missing count and share."""
    aggs = [F.count("*").alias("_rows"), *[F.count(col(c)).alias(f"_{i}") for i, c in enumerate(t.columns)]]
    entries = []
    for i, c in enumerate(t.columns):
        missing = F.col("_rows") - F.col(f"_{i}")
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("name"),
                F.lit(t.kind(c)).alias("kind"),
                F.col("_rows").alias("rows"),
                missing.alias("missing_count"),
                _percent(missing, F.col("_rows")).alias("missing_pct"),
            )
        )
    return t.df.agg(*aggs).select(F.inline(F.array(*entries)))


def numeric_profile(t: PrepTable) -> DataFrame:
    """Range, mean, sum and moments of every numeric column in one pass.

    Values that hold no number are left out. Sample deviation and variance are 0
    for one value; skewness is the bias-corrected form, 0 below three values or
    for a constant column.
    """
    names = t.columns_of(NUMERIC)
    schema = "position int, name string, n long, min double, max double, mean double, sum double, std double, variance double, skewness double"
    if not names:
        return t.df.sparkSession.createDataFrame([], schema)
    values = t.df.select(*[t.number(c).alias(f"_{i}") for i, c in enumerate(names)])
    aggs, entries = [], []
    for i, c in enumerate(names):
        x = F.col(f"_{i}")
        aggs.append(
            F.struct(
                F.count(x).alias("n"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.sum(x).alias("sum"),
                F.var_samp(x).alias("v"),
                F.skewness(x).alias("g1"),
            ).alias(f"s{i}")
        )
        entries.append(
            F.struct(F.lit(t.columns.index(c)).alias("position"), F.lit(c).alias("name"), F.col(f"s{i}").alias("s"))
        )
    n = F.col("n")
    variance = F.when(n == 1, 0.0).otherwise(F.col("v"))
    corrected = F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    skew = F.when(n >= 3, F.coalesce(corrected, F.lit(0.0))).when(n > 0, 0.0)
    return (
        values.agg(*aggs)
        .select(F.inline(F.array(*entries)))
        .select("position", "name", "s.*")
        .select(
            "position", "name", "n", "min", "max", F.try_divide("sum", "n").alias("mean"), "sum",
            F.sqrt(variance).alias("std"), variance.alias("variance"), skew.alias("skewness"),
        )
    )


def quartile_profile(t: PrepTable, exact: bool = True) -> DataFrame:
    """First quartile, median and third quartile of every numeric column."""
    names = t.columns_of(NUMERIC)
    if not names:
        return t.df.sparkSession.createDataFrame([], "position int, q1 double, median double, q3 double")
    rows = _long(t, {c: t.number(c) for c in names}, "x")
    if exact:
        return group_quantiles(rows, ["position"], "x", QUARTILES, at_most=t.bound())
    points = F.array(*[F.lit(p) for p in QUARTILES.values()])
    q = rows.groupBy("position").agg(F.percentile_approx("x", points, 10_000).alias("q"))
    return q.select("position", *[F.col("q")[i].alias(n) for i, n in enumerate(QUARTILES)])


# What cells are stored as when columns are stacked.
FAMILIES = ("bigint", "double", "timestamp_ntz", "string")


def distinct_profile(t: PrepTable, exact: bool = True) -> DataFrame:
    """Distinct values of every column, missing left out.

    Exact counts stack the columns of each storage family (whole, floating, time, text) and
    group once for each, so every column is read once and cells travel without padding.
    ``exact=False`` uses a sketch of fixed size inside a single aggregation.
    """
    if not exact:
        aggs = [F.approx_count_distinct(col(c)).alias(f"_{i}") for i, c in enumerate(t.columns)]
        entries = [F.struct(F.lit(i).alias("position"), F.col(f"_{i}").alias("unique")) for i in range(len(aggs))]
        return t.df.agg(*aggs).select(F.inline(F.array(*entries)))
    families: dict[str, dict[str, Column]] = {k: {} for k in FAMILIES}
    for f in t.data.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, NESTED):
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}; drop or flatten it first")
        if isinstance(f.dataType, T.BooleanType):
            family, c = "bigint", c.cast("int")
        elif isinstance(f.dataType, T.IntegralType):
            family = "bigint"
        elif isinstance(f.dataType, FLOATING):
            family = "double"
        elif isinstance(f.dataType, TEMPORAL):
            family = "timestamp_ntz"
        else:
            family = "string"
        families[family][f.name] = c.cast(family)
    parts = [
        _long(t, cells, "cell").distinct().groupBy("position").agg(F.count("*").alias("unique"))
        for cells in families.values()
        if cells
    ]
    return reduce(DataFrame.unionAll, parts)


def profile(t: PrepTable, exact: bool = True) -> DataFrame:
    """One row per column, in column order; null where a statistic does not apply."""
    parts = [numeric_profile(t).drop("name"), quartile_profile(t, exact), distinct_profile(t, exact)]
    out = missing_profile(t)
    for part in parts:
        out = out.join(F.broadcast(part), "position", "left")  # at most one row per column
    return out.select(
        "position", "name", "kind", "rows", "missing_count", "missing_pct",
        F.coalesce("unique", F.lit(0)).alias("unique"),
        "min", "max", "mean", "sum", "median", "std", "variance", "skewness", "q1", "q3",
    )


def top_values(t: PrepTable, name: str, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent labels with their share of all rows; ties by label."""
    t.require(name)
    counts = t.df.groupBy(F.coalesce(t.text(name), F.lit(BLANK)).alias("label")).agg(F.count("*").alias("count"))
    total = t.df.agg(F.count("*")).scalar()
    top = counts.orderBy(F.desc("count"), "label").limit(k)
    return top.withColumn("percentage", _percent(F.col("count"), total))


def skew_label(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < SYMMETRIC, "Symmetric").when(skew > 0, "Right-skewed").when(skew <= 0, "Left-skewed")
    )


def filter_profile(p: DataFrame, search: str = "", kind: str | None = None) -> DataFrame:
    """Profile rows whose column name contains the text and whose kind matches."""
    out = p.filter(F.lower("name").contains(search.lower())) if search else p
    return out.filter(F.col("kind") == kind) if kind else out


def sort_profile(p: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Profile rows in the order of one of their columns, ties by name."""
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return p.orderBy(key, "name")


def completeness(p: DataFrame) -> DataFrame:
    """Share of cells that hold a value, over the whole table; 100 with no cells."""
    filled = 100 * (1 - F.try_divide(F.sum("missing_count"), F.sum("rows")))
    return p.agg(F.coalesce(F.bround(filled, 1), F.lit(100.0)).alias("completeness"))


def column_completeness(p: DataFrame) -> DataFrame:
    return p.select("position", "name", F.bround(100 - F.col("missing_pct"), 1).alias("complete_pct"))


def kind_distribution(p: DataFrame) -> DataFrame:
    return p.groupBy("kind").agg(F.count("*").alias("columns"))
