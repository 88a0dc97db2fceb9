"""Named queries over the star-schema tables, each with the SQL it must agree with.

Every query runs over whole tables. The tables hold no missing cells, so some are
made by rule: a value that stands for 'not known' becomes missing on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish import sinks
from burnish.functions.cells import strip_missing, NA_TOKENS
from burnish.functions.hashing import mix_sql
from burnish.models import attribution, metrics, prep
from burnish.models.train import train
from burnish.operators import charts, clean, edits, grid, profile, rank, report
from burnish.plans.recipe import Recipe
from burnish.plans.session import PrepSession
from burnish.session import scratch_path
from burnish.sources import infer, infer_kinds, read_csv, read_parquet
from burnish.table import ROW_ID, PrepTable

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str, row_ids: bool = True) -> PrepTable:
    return read_parquet(spark, f"{sf}/{name}.parquet", row_ids=row_ids, name=name)


def derive(t: PrepTable, *columns: Column) -> PrepTable:
    """The table with other columns, row ids kept."""
    keep = [F.col(ROW_ID)] if t.has_row_ids else []
    return PrepTable.of(t.df.select(*keep, *columns), t.name, at_most=t.at_most, dense=t.dense)


# --- tables with missing cells -------------------------------------------------

ORDERS_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def orders(spark: SparkSession, sf: str, row_ids: bool = True) -> PrepTable:
    """Unspecified priorities and prices below 60,000 are missing."""
    return derive(
        load(spark, sf, "orders", row_ids),
        F.col("o_orderkey"),
        F.col("o_custkey"),
        F.col("o_orderstatus"),
        F.when(F.col("o_totalprice") >= 60000, F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )


ORDERS = """d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN o_totalprice >= 60000 THEN o_totalprice END AS o_totalprice,
 nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


def part(spark: SparkSession, sf: str, row_ids: bool = True) -> PrepTable:
    """Few columns, so many equal rows; the economy type is missing."""
    return derive(
        load(spark, sf, "part", row_ids),
        F.col("p_brand"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("p_type"),
        F.col("p_size"),
    )


PART = """d AS (SELECT row_number() OVER (ORDER BY p_partkey) AS _rowId, p_brand,
 nullif(p_type, 'ECONOMY') AS p_type, p_size FROM part)"""


def customer(spark: SparkSession, sf: str) -> PrepTable:
    """Negative balances are missing."""
    return derive(
        load(spark, sf, "customer"),
        F.col("c_custkey"),
        F.col("c_name"),
        F.col("c_nationkey"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.col("c_mktsegment"),
    )


CUSTOMER = """d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_custkey, c_name, c_nationkey,
 CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""


def lineitem(spark: SparkSession, sf: str) -> PrepTable:
    return load(spark, sf, "lineitem", row_ids=False)


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_NUMBERS = LINE_COLUMNS[:8]


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round doubles so that two engines' summation orders do not show."""
    return df.select(*[F.round(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- sources and typing --------------------------------------------------------


@register(
    "csv_roundtrip",
    f"WITH {CUSTOMER} SELECT _rowId, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM d",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(customer(spark, sf), path, delimiter=";")
    return read_csv(spark, path, delimiter=";").df


@register(
    "csv_quoted_text",
    "SELECT row_number() OVER (ORDER BY doc_id) AS _rowId, doc_id, text, lang FROM documents",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    t = load(spark, sf, "documents")
    sinks.write_csv(derive(t, F.col("doc_id"), F.col("text"), F.col("lang")), path)
    return read_csv(spark, path).df


@register(
    "csv_no_header",
    """SELECT row_number() OVER (ORDER BY s_suppkey) AS "_rowId", s_suppkey AS "Col0", s_name AS "Col1",
 s_nationkey::BIGINT AS "Col2", s_acctbal AS "Col3" FROM supplier""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(load(spark, sf, "supplier"), path, delimiter="\\t", header=False)
    return read_csv(spark, path, delimiter="\\t", has_header=False).df


@register(
    "csv_many_files",
    f"WITH {CUSTOMER} SELECT _rowId, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM d",
)
def _(spark, sf):
    t = customer(spark, sf)
    path, rows = scratch_path(spark, "csv"), t.df.count()
    # one folder of files whose names follow the row ids
    for k in range(4):
        part = F.floor((F.col(ROW_ID) - 1) * 4 / F.lit(max(rows, 1))) == k
        sinks.write_csv(t.with_df(t.df.filter(part), dense=False), f"{path}/part={k}")
    return read_csv(spark, f"{path}/*").df


@register(
    "csv_one_column",
    """SELECT row_number() OVER (ORDER BY doc_id) AS _rowId, text FROM documents""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(derive(load(spark, sf, "documents"), F.col("text")), path)
    return read_csv(spark, path).df


@register(
    "csv_repeated_header",
    """SELECT row_number() OVER (ORDER BY s_suppkey) AS _rowId, s_suppkey AS name, s_name AS "name.1", s_nationkey::BIGINT AS "name.2" FROM supplier""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    cells = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("s_suppkey", "s_name", "s_nationkey")]
    rows = load(spark, sf, "supplier").df.select(F.concat_ws(",", *cells).alias("value"), ROW_ID)
    head = spark.range(1).select(F.lit("name,name,name").alias("value"), F.lit(0).cast("bigint").alias(ROW_ID))
    rows.unionByName(head).coalesce(1).sortWithinPartitions(ROW_ID).select("value").write.text(path)
    return read_csv(spark, path).df


TOKENS = {"1-URGENT": "N/A", "2-HIGH": "null", "3-MEDIUM": " ", "5-LOW": "n.a."}


@register(
    "na_tokens",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL
 WHEN '3-MEDIUM' THEN NULL WHEN '5-LOW' THEN 'n.a.' ELSE o_orderpriority END AS raw FROM orders""",
)
def _(spark, sf):
    raw = F.col("o_orderpriority")
    for old, new in TOKENS.items():
        raw = F.when(F.col("o_orderpriority") == old, new).otherwise(raw)
    df = load(spark, sf, "orders", row_ids=False).df.select("o_orderkey", raw.alias("raw"))
    return strip_missing(df, NA_TOKENS)


def _orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a delimited file has them: all text, unknown prices spelled out."""
    df = load(spark, sf, "orders", row_ids=False).df
    price = F.when(F.col("o_totalprice") < 60000, "unknown").otherwise(F.col("o_totalprice").cast("string"))
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")],
        price.alias("price_text"),
    )


@register(
    "typed_cast",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
 CASE WHEN o_totalprice < 60000 THEN NULL ELSE o_totalprice END AS price FROM orders""",
)
def _(spark, sf):
    t = infer(_orders_text(spark, sf))
    return t.df.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", t.number("price_text").alias("price"))


@register(
    "infer_kinds",
    """WITH d AS (SELECT CASE WHEN o_totalprice < 60000 THEN 'unknown' ELSE o_totalprice::VARCHAR END AS price_text,
 o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice,
 o_orderdate::VARCHAR AS o_orderdate FROM orders),
u AS (SELECT 'o_orderkey' AS name, o_orderkey AS v FROM d UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM d
 UNION ALL SELECT 'o_totalprice', o_totalprice FROM d UNION ALL SELECT 'o_orderdate', o_orderdate FROM d
 UNION ALL SELECT 'price_text', price_text FROM d),
s AS (SELECT name, count(v) AS present, avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) AS ns,
 avg((TRY_CAST(v AS DOUBLE) IS NULL AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL)::INT) AS ds FROM u GROUP BY name)
SELECT name, CASE WHEN ns > 0.8 THEN 'Numeric' WHEN ds > 0.8 THEN 'Date' ELSE 'Categorical' END AS kind, present,
 round(ns, 6) AS numeric_share, round(ds, 6) AS date_share FROM s""",
)
def _(spark, sf):
    texts = PrepTable(_orders_text(spark, sf))
    return rounded(infer_kinds(texts).drop("position"), numeric_share=6, date_share=6)


@register("row_id", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _rowId, o_orderkey FROM orders")
def _(spark, sf):
    df = load(spark, sf, "orders", row_ids=False).df
    return rank.number_rows(df, [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()]).select(ROW_ID, "o_orderkey")


@register("row_id_file_order", "SELECT row_number() OVER (ORDER BY event_id) AS _rowId, event_id FROM events")
def _(spark, sf):
    return load(spark, sf, "events").df.select(ROW_ID, "event_id")


# --- profile and quality -------------------------------------------------------

SUMMARY = f"""WITH {PART}, c AS (SELECT count(*) AS n, count(*) - count(p_type) AS m,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM d)) AS u FROM d),
s AS (SELECT *, CAST(greatest(0, least(100, round_even(100 - 150.0 * m / (n * 3) - 200.0 * u / n, 0))) AS BIGINT) AS q FROM c)"""
BAND = "CASE WHEN q >= 85 THEN 'good' WHEN q >= 60 THEN 'fair' ELSE 'poor' END"


@register(
    "table_summary",
    f"""{SUMMARY} SELECT n AS "rows", 3 AS "columns", m AS missing_cells, round_even(100.0 * m / (n * 3), 2) AS missing_pct,
 u AS duplicates, q AS quality_score, {BAND} AS quality_band FROM s""",
)
def _(spark, sf):
    return profile.table_summary(part(spark, sf, row_ids=False))


@register(
    "quality_score",
    f"""WITH {ORDERS}, c AS (SELECT count(*) AS n, 2 * count(*) - count(o_totalprice) - count(o_orderpriority) AS m FROM d),
s AS (SELECT CAST(greatest(0, least(100, round_even(100 - 150.0 * m / (n * 5), 0))) AS BIGINT) AS q FROM c)
SELECT q AS quality_score, {BAND} AS quality_band FROM s""",
)
def _(spark, sf):
    return profile.table_summary(orders(spark, sf, row_ids=False)).select("quality_score", "quality_band")


@register(
    "duplicate_count",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents",
)
def _(spark, sf):
    t = load(spark, sf, "documents", row_ids=False)
    return profile.duplicate_count(derive(t, F.col("text"), F.col("lang")))


@register(
    "table_size_kb",
    """SELECT round_even((count(*) * 16 + sum(octet_length(encode(text)) + octet_length(encode(lang))
 + octet_length(encode(source)))) / 1024, 1) AS size_kb FROM documents""",
)
def _(spark, sf):
    return profile.table_size(load(spark, sf, "documents", row_ids=False))


def _per_column(columns, template: str, source: str = "d") -> str:
    return union([template.format(c=c, i=i, t=source) for i, c in enumerate(columns)])


MISSING_SQL = """SELECT {i} AS position, '{c}' AS name, count(*) AS "rows", count(*) - count({c}) AS missing_count,
 round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM {t}"""


@register("profile_missing", f"WITH {ORDERS} {_per_column(ORDERS_COLUMNS, MISSING_SQL)}")
def _(spark, sf):
    return profile.missing_profile(orders(spark, sf, row_ids=False)).drop("kind")


DISTINCT_SQL = "SELECT {i} AS position, count(DISTINCT {c}) AS \"unique\" FROM {t}"


@register("profile_distinct", _per_column(LINE_COLUMNS, DISTINCT_SQL, "lineitem"))
def _(spark, sf):
    return profile.distinct_profile(lineitem(spark, sf))


@register(
    "profile_distinct_approx",
    "SELECT i::INTEGER AS position, true AS near FROM range((SELECT count(*) FROM (DESCRIBE lineitem))) r(i)",
)
def _(spark, sf):
    t = load(spark, sf, "lineitem", row_ids=False)
    exact = profile.distinct_profile(t).withColumnRenamed("unique", "exact")
    near = F.abs(F.col("unique") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.15)
    return profile.distinct_profile(t, exact=False).join(exact, "position").select("position", near.alias("near"))


NUMERIC_SQL = """SELECT {i} AS position, '{c}' AS name, count({c}) AS n, min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max",
 round(avg({c}), 4) AS mean, round(sum({c})::DOUBLE, 1) AS "sum", round(stddev_samp({c}), 4) AS std,
 round(var_samp({c}), 0) AS variance, round(skewness({c}), 5) AS skewness FROM {t}"""


@register("profile_numeric", _per_column(LINE_NUMBERS, NUMERIC_SQL, "lineitem"))
def _(spark, sf):
    return rounded(profile.numeric_profile(lineitem(spark, sf)), mean=4, sum=1, std=4, variance=0, skewness=5)


QUARTILE_SQL = """SELECT {i} AS position, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median,
 round(quantile_cont({c}, 0.75), 4) AS q3 FROM {t}"""


@register("profile_quartiles", _per_column(LINE_NUMBERS, QUARTILE_SQL, "lineitem"))
def _(spark, sf):
    return rounded(profile.quartile_profile(lineitem(spark, sf)), q1=4, median=4, q3=4)


PROFILE_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
_STATS = ("min", "max", "mean", "sum", "median", "std", "variance", "skewness", "q1", "q3")


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(ORDERS_COLUMNS):
        base = f"""SELECT {i} AS position, '{c}' AS name, '{"Numeric" if c in PROFILE_NUMBERS else "Categorical"}' AS kind,
 count(*) AS "rows", count(*) - count({c}) AS missing_count,
 round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique", """
        if c in PROFILE_NUMBERS:
            stats = f"""min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", round(avg({c}), 4) AS mean,
 round(sum({c})::DOUBLE, 1) AS "sum", round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std,
 round(var_samp({c}), 0) AS variance, round(skewness({c}), 5) AS skewness,
 round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3"""
        else:
            stats = ", ".join(f'CAST(NULL AS DOUBLE) AS "{s}"' for s in _STATS)
        parts.append(f"{base}{stats} FROM d")
    return f"WITH {ORDERS} {union(parts)}"


PROFILE_PLACES = dict(mean=4, sum=1, median=4, std=4, variance=0, skewness=5, q1=4, q3=4)


@register("profile", _profile_sql())
def _(spark, sf):
    return rounded(profile.profile(orders(spark, sf, row_ids=False)), **PROFILE_PLACES)


ORDERS_KINDS = {
    "o_orderkey": "Numeric", "o_custkey": "Numeric", "o_orderstatus": "Categorical", "o_totalprice": "Numeric",
    "o_orderdate": "Date", "o_orderpriority": "Categorical",
}


@register(
    "profile_whole_orders",
    union(
        [
            f"""SELECT {i} AS position, '{c}' AS name, '{k}' AS kind, count(*) AS "rows", count(*) - count({c}) AS missing_count,
 round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique" FROM orders"""
            for i, (c, k) in enumerate(ORDERS_KINDS.items())
        ]
    ),
)
def _(spark, sf):
    t = load(spark, sf, "orders", row_ids=False)
    return profile.missing_profile(t).join(profile.distinct_profile(t), "position")


@register("profile_approx")
def _(spark, sf):
    return profile.profile(orders(spark, sf, row_ids=False), exact=False)


@register(
    "profile_filter",
    f"""WITH {ORDERS} {union([f"SELECT '{c}' AS name, 'Numeric' AS kind, count(DISTINCT {c}) AS \"unique\" FROM d"
     for c in ("o_orderkey", "o_custkey")])}""",
)
def _(spark, sf):
    p = profile.profile(orders(spark, sf, row_ids=False))
    return profile.filter_profile(p, search="KEY", kind="Numeric").select("name", "kind", "unique")


@register("profile_sum", f"WITH {ORDERS} SELECT 'o_totalprice' AS name, round(sum(o_totalprice), 1) AS \"sum\" FROM d")
def _(spark, sf):
    p = profile.numeric_profile(orders(spark, sf, row_ids=False)).filter("name = 'o_totalprice'")
    return rounded(p.select("name", "sum"), sum=1)


@register(
    "skew_label",
    union(
        [
            f"""SELECT '{c}' AS name, CASE WHEN abs(skewness({c})) < 0.2 THEN 'Symmetric'
 WHEN skewness({c}) > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS label FROM events"""
            for c in ("event_id", "user_id", "value")
        ]
    ),
)
def _(spark, sf):
    p = profile.numeric_profile(load(spark, sf, "events", row_ids=False))
    return p.select("name", profile.skew_label(F.col("skewness")).alias("label"))


@register(
    "completeness",
    f"""WITH {ORDERS} SELECT round_even(100.0 * (1 - (2 * count(*) - count(o_totalprice) - count(o_orderpriority))
 / (count(*) * 5)::DOUBLE), 1) AS completeness FROM d""",
)
def _(spark, sf):
    return profile.completeness(profile.missing_profile(orders(spark, sf, row_ids=False)))


@register(
    "kind_distribution",
    """SELECT CASE WHEN column_type = 'VARCHAR' THEN 'Categorical' WHEN column_type LIKE 'TIMESTAMP%' THEN 'Date'
 ELSE 'Numeric' END AS kind, count(*) AS "columns" FROM (DESCRIBE lineitem) GROUP BY 1""",
)
def _(spark, sf):
    return profile.kind_distribution(profile.missing_profile(lineitem(spark, sf)))


@register(
    "column_completeness",
    f"""WITH {ORDERS} {_per_column(ORDERS_COLUMNS, '''SELECT {i} AS position, '{c}' AS name,
 round_even(100 - round_even(100.0 * (count(*) - count({c})) / count(*), 2), 1) AS complete_pct FROM {t}''')}""",
)
def _(spark, sf):
    return profile.column_completeness(profile.missing_profile(orders(spark, sf, row_ids=False)))


@register(
    "profile_sorted",
    f"""WITH {ORDERS}, p AS ({_per_column(ORDERS_COLUMNS, "SELECT '{c}' AS name, count(DISTINCT {c}) AS u FROM {t}")})
SELECT row_number() OVER (ORDER BY u DESC, name) AS place, name, u AS "unique" FROM p""",
)
def _(spark, sf):
    p = profile.sort_profile(profile.profile(orders(spark, sf, row_ids=False)), "unique", ascending=False)
    p = p.select("name", "unique").coalesce(1)
    return p.select((F.monotonically_increasing_id() + 1).alias("place"), "name", "unique")


@register(
    "top_values",
    """SELECT p_name AS label, count(*) AS "count", round_even(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS percentage
 FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
)
def _(spark, sf):
    return profile.top_values(load(spark, sf, "part", row_ids=False), "p_name")


@register(
    "top_values_blank",
    f"""WITH {ORDERS} SELECT coalesce(o_orderpriority, '[Blank]') AS label, count(*) AS "count",
 round_even(100.0 * count(*) / (SELECT count(*) FROM d), 2) AS percentage FROM d GROUP BY 1""",
)
def _(spark, sf):
    return profile.top_values(orders(spark, sf, row_ids=False), "o_orderpriority")


# --- rows: search, sort, page, edit --------------------------------------------


@register("grid_page", f"WITH {CUSTOMER} SELECT * FROM d WHERE _rowId BETWEEN 21 AND 30")
def _(spark, sf):
    return grid.page(customer(spark, sf), 3).rows


@register(
    "grid_page_clamped",
    f"""WITH {CUSTOMER}, c AS (SELECT count(*) AS n FROM d)
SELECT d.* FROM d, c WHERE _rowId > (CAST(ceil(n / 7.0) AS BIGINT) - 1) * 7""",
)
def _(spark, sf):
    return grid.page(customer(spark, sf), 999999, 7).rows


@register(
    "grid_page_sorted",
    f"WITH {CUSTOMER} SELECT * FROM d ORDER BY c_acctbal DESC NULLS LAST, _rowId LIMIT 25 OFFSET 100",
)
def _(spark, sf):
    return grid.page(customer(spark, sf), 5, 25, sort_column="c_acctbal", ascending=False).rows


@register(
    "grid_page_last_sorted",
    f"""WITH {ORDERS}, c AS (SELECT count(*) AS n FROM d)
SELECT d.* FROM d ORDER BY o_orderpriority NULLS LAST, _rowId
 LIMIT 20 OFFSET (SELECT (CAST(ceil(n / 20.0) AS BIGINT) - 1) * 20 FROM c)""",
)
def _(spark, sf):
    return grid.page(orders(spark, sf), 999999, 20, sort_column="o_orderpriority").rows


@register(
    "grid_page_deep",
    """WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderkey, o_totalprice FROM orders),
 l AS (SELECT o.o_orderkey, o.o_totalprice, o._rowId, row_number() OVER (ORDER BY o_totalprice, _rowId) AS rank FROM d o)
SELECT rank AS _rank, _rowId, o_orderkey, o_totalprice FROM l WHERE rank BETWEEN (SELECT count(*) // 2 FROM d) AND (SELECT count(*) // 2 + 49 FROM d)""",
)
def _(spark, sf):
    t = derive(load(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_totalprice"))
    half = F.lit(t.at_most // 2)
    out = grid.ranked(t, "o_totalprice").filter((F.col("_rank") >= half) & (F.col("_rank") <= half + 49))
    return out.select("_rank", ROW_ID, "o_orderkey", "o_totalprice")


@register(
    "grid_page_of_search",
    f"""WITH {CUSTOMER}, h AS (SELECT * EXCLUDE (_rowId), row_number() OVER (ORDER BY _rowId) AS _rowId FROM d WHERE c_mktsegment = 'BUILDING')
SELECT * FROM h WHERE _rowId BETWEEN 6 AND 10""",
)
def _(spark, sf):
    return grid.page(grid.filter_equals(customer(spark, sf), "c_mktsegment", "BUILDING"), 2, 5).rows


@register(
    "grid_page_large_of_filter",
    """WITH d AS (SELECT row_number() OVER () AS pos, l_orderkey, l_linenumber, l_extendedprice, l_linestatus FROM lineitem),
f AS (SELECT row_number() OVER (ORDER BY pos) AS _rowId, * EXCLUDE (pos) FROM d WHERE l_linestatus = 'O'),
r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, _rowId) AS place, count(*) OVER () AS total FROM f)
SELECT * EXCLUDE (place, total) FROM r WHERE (place - 1) // 2000 = least(8, greatest(1, (total + 1999) // 2000)) - 1""",
)
def _(spark, sf):
    names = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus")
    t = derive(load(spark, sf, "lineitem"), *[F.col(c) for c in names])
    return grid.page(grid.filter_equals(t, "l_linestatus", "O"), 8, 2_000, sort_column="l_extendedprice", ascending=False).rows


@register(
    "grid_page_after_dedup",
    """WITH p AS (SELECT row_number() OVER () AS pos, p_name, p_brand, p_type FROM part),
u AS (SELECT min(pos) AS pos, p_name, p_brand, p_type FROM p GROUP BY ALL),
d AS (SELECT row_number() OVER (ORDER BY pos) AS _rowId, p_name, p_brand, p_type FROM u)
SELECT * FROM d ORDER BY p_brand DESC, _rowId LIMIT 20 OFFSET 40""",
)
def _(spark, sf):
    t = derive(load(spark, sf, "part"), *[F.col(c) for c in ("p_name", "p_brand", "p_type")])
    return grid.page(clean.remove_duplicates(t), 3, 20, sort_column="p_brand", ascending=False).rows


@register(
    "grid_page_clashing_names",
    """WITH d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey AS _id, c_nationkey AS _cell, c_acctbal AS _rank FROM customer),
h AS (SELECT row_number() OVER (ORDER BY n) AS _rowId, _id, _cell, _rank FROM d WHERE _cell = 3)
SELECT * FROM h ORDER BY _rank, _rowId LIMIT 5""",
)
def _(spark, sf):
    t = load(spark, sf, "customer")
    t = derive(t, F.col("c_custkey").alias("_id"), F.col("c_nationkey").alias("_cell"), F.col("c_acctbal").alias("_rank"))
    return grid.page(grid.filter_equals(t, "_cell", "3").numbered(), 1, 5, sort_column="_rank").rows


@register(
    "grid_search_number",
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderkey, o_totalprice FROM orders QUALIFY contains(o_totalprice::VARCHAR, '77.1')",
)
def _(spark, sf):
    t = derive(load(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_totalprice"))
    return grid.search(t, "77.1", regex=False).df


@register(
    "grid_search_accents",
    """WITH d AS (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) AS _rowId FROM documents)
SELECT _rowId, doc_id FROM d WHERE contains(lower(text), 'été') OR contains(lower(text), 'ñas')""",
)
def _(spark, sf):
    t = derive(load(spark, sf, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"))
    return grid.search(t, "ÉTÉ|ÑAS").df.select(ROW_ID, "doc_id")


@register(
    "grid_search",
    f"""WITH {CUSTOMER} SELECT * FROM d WHERE regexp_matches(c_name, '(?i)(mach.*ry|er#0+1)')
 OR regexp_matches(c_mktsegment, '(?i)(mach.*ry|er#0+1)')""",
)
def _(spark, sf):
    return grid.search(customer(spark, sf), "(mach.*RY|er#0+1)").df


@register("grid_search_plain", f"WITH {CUSTOMER} SELECT * FROM d WHERE contains(lower(c_name), 'mer#00') OR contains(lower(c_mktsegment), 'mer#00')")
def _(spark, sf):
    return grid.search(customer(spark, sf), "mER#00", regex=False).df


@register(
    "grid_sort_numeric",
    f"""WITH {ORDERS} SELECT _rowId, o_orderkey, o_totalprice,
 row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, _rowId) AS place FROM d""",
)
def _(spark, sf):
    t = orders(spark, sf)
    out = rank.number_rows(t.df.withColumn("id", F.col(ROW_ID)), [*grid.sort_key(t, "o_totalprice", False)[:1], F.col("id").asc()])
    return out.select(F.col("id").alias(ROW_ID), "o_orderkey", "o_totalprice", F.col(ROW_ID).alias("place"))


@register(
    "grid_sort_text",
    f"WITH {ORDERS} SELECT _rowId, o_orderkey, o_orderpriority FROM d ORDER BY o_orderpriority NULLS LAST, _rowId",
)
def _(spark, sf):
    return grid.sort(orders(spark, sf), "o_orderpriority").select(ROW_ID, "o_orderkey", "o_orderpriority")


@register(
    "grid_display",
    f"""WITH {ORDERS} SELECT _rowId, o_orderkey::VARCHAR AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus,
 coalesce(o_custkey::VARCHAR, '') AS o_custkey, coalesce(o_totalprice::VARCHAR, '') AS o_totalprice, coalesce(o_orderpriority, '') AS o_orderpriority FROM d""",
)
def _(spark, sf):
    return grid.display(orders(spark, sf).df)


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    """Rich customers are renamed twice, indebted ones lose their segment."""
    t = load(spark, sf, "customer").df
    rich = t.filter("c_acctbal > 9000").select(
        ROW_ID,
        F.explode(
            F.array(
                F.struct(F.lit("c_mktsegment").alias("column"), F.lit("FIRST").alias("value"), F.lit(1).cast("long").alias("seq")),
                F.struct(F.lit("c_mktsegment").alias("column"), F.lit("SECOND").alias("value"), F.lit(2).cast("long").alias("seq")),
                F.struct(F.lit("c_nationkey").alias("column"), F.lit("99").alias("value"), F.lit(3).cast("long").alias("seq")),
                F.struct(F.lit("no_such").alias("column"), F.lit("x").alias("value"), F.lit(4).cast("long").alias("seq")),
            )
        ).alias("e"),
    )
    poor = t.filter("c_acctbal < 0").select(
        ROW_ID, F.struct(F.lit("c_mktsegment").alias("column"), F.lit("[NULL]").alias("value"), F.lit(1).cast("long").alias("seq")).alias("e")
    )
    return rich.unionByName(poor).select(ROW_ID, "e.*")


@register(
    "recipe_with_edits",
    """SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_custkey, c_name,
 CASE WHEN c_acctbal > 9000 THEN 99 ELSE c_nationkey END::BIGINT AS c_nationkey, c_acctbal,
 CASE WHEN c_acctbal > 9000 THEN 'SECOND' WHEN c_acctbal < 0 THEN 'none' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def _(spark, sf):
    s = PrepSession(load(spark, sf, "customer"))
    s.edit(_edits(spark, sf))
    s.apply("fill_missing", column="c_mktsegment", strategy="custom", value="none")
    return Recipe.from_json(s.recipe().to_json()).apply(load(spark, sf, "customer")).df


@register(
    "apply_edits_rejected",
    "SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_custkey, c_acctbal FROM customer",
)
def _(spark, sf):
    t = derive(load(spark, sf, "customer"), F.col("c_custkey"), F.col("c_acctbal"))
    lost = t.df.select((F.col(ROW_ID) + 10**9).alias(ROW_ID), F.lit("c_acctbal").alias("column"), F.lit("text").alias("value"), F.lit(1).cast("long").alias("seq"))
    return edits.apply_edits(t, lost).df


@register(
    "apply_edits",
    """SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_custkey, c_name,
 CASE WHEN c_acctbal > 9000 THEN 99 ELSE c_nationkey END::BIGINT AS c_nationkey, c_acctbal,
 CASE WHEN c_acctbal > 9000 THEN 'SECOND' WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def _(spark, sf):
    return edits.apply_edits(load(spark, sf, "customer"), _edits(spark, sf)).df


@register(
    "rejected_edits",
    """SELECT rn AS _rowId, 'no_such' AS "column", 'unknown column' AS reason FROM
 (SELECT row_number() OVER (ORDER BY c_custkey) AS rn, c_acctbal FROM customer) WHERE c_acctbal > 9000""",
)
def _(spark, sf):
    return edits.rejected_edits(load(spark, sf, "customer"), _edits(spark, sf)).select(ROW_ID, "column", "reason")


# --- cleaning ------------------------------------------------------------------


@register(
    "remove_duplicates",
    f"""WITH {PART}, g AS (SELECT p_brand, p_type, p_size, min(_rowId) AS f FROM d GROUP BY ALL)
SELECT row_number() OVER (ORDER BY f) AS _rowId, p_brand, p_type, p_size FROM g""",
)
def _(spark, sf):
    return clean.remove_duplicates(part(spark, sf)).numbered().df


@register(
    "remove_duplicate_documents",
    """WITH g AS (SELECT text, lang, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT row_number() OVER (ORDER BY f) AS _rowId, text, lang FROM g""",
)
def _(spark, sf):
    t = derive(load(spark, sf, "documents"), F.col("text"), F.col("lang"))
    return clean.remove_duplicates(t).numbered().df


@register(
    "drop_missing",
    f"""WITH {ORDERS} SELECT row_number() OVER (ORDER BY _rowId) AS _rowId, o_orderkey, o_custkey, o_orderstatus,
 o_totalprice, o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL""",
)
def _(spark, sf):
    return clean.drop_missing(orders(spark, sf), "o_orderpriority").numbered().df


def _fill(strategy: str, value=None) -> Query:
    def run(spark, sf):
        column = "o_orderpriority" if strategy == "mode" else "o_totalprice"
        t = clean.fill_missing(orders(spark, sf, row_ids=False), column, strategy, value)
        out = t.df.select("o_orderkey", column)
        return out if strategy == "mode" else rounded(out, o_totalprice=4)

    return run


register(
    "fill_mean",
    f"WITH {ORDERS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM d)), 4) AS o_totalprice FROM d",
)(_fill("mean"))
register(
    "fill_median",
    f"WITH {ORDERS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM d)), 4) AS o_totalprice FROM d",
)(_fill("median"))
register(
    "fill_mode",
    f"""WITH {ORDERS}, m AS (SELECT o_orderpriority AS v FROM d WHERE o_orderpriority IS NOT NULL GROUP BY 1
 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT o_orderkey, coalesce(o_orderpriority, m.v) AS o_orderpriority FROM d, m""",
)(_fill("mode"))
register(
    "fill_custom",
    f"WITH {ORDERS} SELECT o_orderkey, round(coalesce(o_totalprice, 1234.5), 4) AS o_totalprice FROM d",
)(_fill("custom", "1234.5"))


@register(
    "fill_custom_text",
    f"WITH {CUSTOMER} SELECT c_custkey, coalesce(c_acctbal::VARCHAR, 'in debt') AS c_acctbal FROM d",
)
def _(spark, sf):
    return clean.fill_missing(customer(spark, sf), "c_acctbal", "custom", "in debt").df.select("c_custkey", "c_acctbal")


@register("drop_column", f"WITH {PART} SELECT _rowId, p_brand, p_size FROM d")
def _(spark, sf):
    return clean.drop_column(part(spark, sf), "p_type").df


@register("rename_column", f"WITH {PART} SELECT _rowId, p_brand, p_type AS \"kind of part\", p_size FROM d")
def _(spark, sf):
    return clean.rename_column(part(spark, sf), "p_type", "kind of part").df


@register(
    "replace_text",
    f"WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority FROM d",
)
def _(spark, sf):
    t = clean.replace_values(orders(spark, sf, False), "o_orderpriority", "5-LOW", "LOW")
    return t.df.select("o_orderkey", "o_orderpriority")


@register("replace_numeric", f"WITH {PART} SELECT _rowId, CASE WHEN p_size = 11 THEN 11.5 ELSE p_size END::DOUBLE AS p_size FROM d")
def _(spark, sf):
    return clean.replace_values(part(spark, sf), "p_size", "11.0", "11.5").df.select(ROW_ID, "p_size")


@register("replace_to_null", f"WITH {PART} SELECT _rowId, nullif(p_size, 7) AS p_size FROM d")
def _(spark, sf):
    return clean.replace_values(part(spark, sf), "p_size", "7", "").df.select(ROW_ID, "p_size")


def _cased(case: str) -> Query:
    def run(spark, sf):
        padded = F.concat(F.lit("\t "), F.lower("p_type"), F.lit("-"), F.col("p_name"), F.lit(" \n"))
        t = derive(load(spark, sf, "part", row_ids=False), F.col("p_partkey"), padded.alias("s"))
        return clean.standardize_strings(t, "s", case).df

    return run


_S = r"(chr(9) || ' ' || lower(p_type) || '-' || p_name || ' ' || chr(10))"
register("str_trim", rf"SELECT p_partkey, regexp_replace({_S}, '^\s+|\s+$', '', 'g') AS s FROM part")(_cased("trim"))
register("str_upper", f"SELECT p_partkey, upper({_S}) AS s FROM part")(_cased("upper"))
register("str_lower", f"SELECT p_partkey, lower({_S}) AS s FROM part")(_cased("lower"))
register(
    "str_title",
    rf"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower({_S}), '[\p{{L}}]+|[^\p{{L}}]+'),
 lambda w: upper(w[1]) || w[2:]), '') AS s FROM part""",
)(_cased("title"))

BOUNDS = """b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
 f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b)"""


@register("outlier_bounds", f"WITH {BOUNDS} SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper FROM f")
def _(spark, sf):
    b = clean.outlier_bounds(load(spark, sf, "events", row_ids=False), "value")
    return rounded(b, q1=6, q3=6, lower=6, upper=6)


@register(
    "remove_outliers",
    f"""WITH {BOUNDS} SELECT row_number() OVER (ORDER BY event_id) AS _rowId, event_id, value FROM events, f
 WHERE value BETWEEN lower AND upper""",
)
def _(spark, sf):
    t = load(spark, sf, "events")
    return clean.remove_outliers(t, "value").numbered().df.select(ROW_ID, "event_id", "value")


@register(
    "remove_outliers_keeps_missing",
    f"""WITH {ORDERS}, b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM d)
SELECT o_orderkey, o_totalprice FROM d, b
 WHERE o_totalprice IS NULL OR o_totalprice BETWEEN q1 - 0.1 * (q3 - q1) AND q3 + 0.1 * (q3 - q1)""",
)
def _(spark, sf):
    return clean.remove_outliers(orders(spark, sf, False), "o_totalprice", 0.1).df.select("o_orderkey", "o_totalprice")


@register(
    "clean_audit",
    f"""WITH {ORDERS}, {BOUNDS} SELECT 'drop_missing' AS action, (SELECT count(*) FROM d WHERE o_orderpriority IS NULL) AS affected
UNION ALL SELECT 'fill_missing', (SELECT count(*) FROM d WHERE o_totalprice IS NULL)
UNION ALL SELECT 'replace_values', (SELECT count(*) FROM d WHERE o_orderstatus = 'F')
UNION ALL SELECT 'remove_outliers', (SELECT count(*) FROM events, f WHERE value NOT BETWEEN lower AND upper)
UNION ALL SELECT 'remove_duplicates', (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, nullif(p_type, 'ECONOMY'), p_size FROM part))""",
)
def _(spark, sf):
    o, e, p = orders(spark, sf, False), load(spark, sf, "events", row_ids=False), part(spark, sf, False)
    made = [
        clean.affected(o, "drop_missing", column="o_orderpriority").withColumn("action", F.lit("drop_missing")),
        clean.affected(o, "fill_missing", column="o_totalprice", strategy="median").withColumn("action", F.lit("fill_missing")),
        clean.affected(o, "replace_values", column="o_orderstatus", find="F", substitute="X").withColumn("action", F.lit("replace_values")),
        clean.affected(e, "remove_outliers", column="value").withColumn("action", F.lit("remove_outliers")),
        clean.affected(p, "remove_duplicates").withColumn("action", F.lit("remove_duplicates")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


# --- history and recipes -------------------------------------------------------


def _session(spark: SparkSession, sf: str, audit: bool = False) -> PrepSession:
    s = PrepSession(orders(spark, sf), audit=audit)
    s.apply("drop_missing", column="o_orderpriority")
    s.apply("fill_missing", column="o_totalprice", strategy="custom", value="0")
    s.apply("drop_column", column="o_custkey")
    return s


_AFTER_ONE = f"""WITH {ORDERS}, k AS (SELECT row_number() OVER (ORDER BY _rowId) AS _rowId, o_orderkey, o_custkey, o_orderstatus,
 o_totalprice, o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL)"""


@register("undo_chain", f"{_AFTER_ONE} SELECT * FROM k")
def _(spark, sf):
    s = _session(spark, sf)
    s.undo()
    s.undo()
    return s.table.numbered().df


@register(
    "redo_chain",
    f"""{_AFTER_ONE} SELECT _rowId, o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, 0) AS o_totalprice,
 o_orderpriority FROM k""",
)
def _(spark, sf):
    s = _session(spark, sf)
    s.undo()
    s.undo()
    s.redo()
    return s.table.numbered().df


@register("reset_chain", f"WITH {ORDERS} SELECT * FROM d")
def _(spark, sf):
    s = _session(spark, sf)
    s.reset()
    return s.table.numbered().df


LOG_SQL = f"""WITH {ORDERS}, n AS (SELECT count(*) FILTER (o_orderpriority IS NULL) AS a,
 count(*) FILTER (o_orderpriority IS NOT NULL AND o_totalprice IS NULL) AS b,
 count(*) FILTER (o_orderpriority IS NOT NULL) AS c FROM d),
l AS (SELECT 1::BIGINT AS id, 'Table loaded' AS title, 'orders: 5 columns' AS description
UNION ALL SELECT 2, 'Drop missing rows', 'column=o_orderpriority; affected ' || a FROM n
UNION ALL SELECT 3, 'Fill missing cells', 'column=o_totalprice, strategy=custom, value=0; affected ' || b FROM n
UNION ALL SELECT 4, 'Drop column', 'column=o_custkey; affected ' || c FROM n)"""


@register("operation_log", f"{LOG_SQL} SELECT * FROM l")
def _(spark, sf):
    return report.report_activity(_session(spark, sf, audit=True).log_table()).drop("at")


@register("recent_operations", f"{LOG_SQL} SELECT * FROM l ORDER BY id DESC LIMIT 3")
def _(spark, sf):
    return _session(spark, sf, audit=True).recent(3).drop("at")


@register(
    "operation_ledger",
    f"{LOG_SQL} SELECT 'Step #' || id || ' - at - ' || title || ' - ' || description AS value FROM l",
)
def _(spark, sf):
    lines = _session(spark, sf, audit=True).ledger()
    return lines.select(F.regexp_replace("value", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "at").alias("value"))


def recipe() -> Recipe:
    """Seven of the eight actions, as a user would chain them."""
    return (
        Recipe()
        .then("remove_duplicates")
        .then("fill_missing", column="p_type", strategy="mode")
        .then("replace_values", column="p_size", find="1", substitute="")
        .then("drop_missing", column="p_size")
        .then("standardize_strings", column="p_type", case="title")
        .then("remove_outliers", column="p_size", multiplier=0.25)
        .then("rename_column", column="p_brand", new_name="brand")
    )


@register(
    "recipe_replay",
    f"""WITH {PART}, u AS (SELECT p_brand, p_type, p_size, min(_rowId) AS f FROM d GROUP BY ALL),
m AS (SELECT p_type AS v FROM u WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT f, p_brand, coalesce(p_type, m.v) AS p_type, p_size FROM u, m WHERE p_size <> 1),
b AS (SELECT quantile_cont(p_size, 0.25) AS q1, quantile_cont(p_size, 0.75) AS q3 FROM k)
SELECT row_number() OVER (ORDER BY f) AS _rowId, p_brand AS brand, upper(p_type[1]) || lower(p_type[2:]) AS p_type, p_size
 FROM k, b WHERE p_size BETWEEN q1 - 0.25 * (q3 - q1) AND q3 + 0.25 * (q3 - q1)""",
)
def _(spark, sf):
    return Recipe.from_json(recipe().to_json()).apply(part(spark, sf)).numbered().df


# --- charts --------------------------------------------------------------------


@register("chart_bar_mean", "SELECT event_type AS x, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(charts.bar(load(spark, sf, "events", row_ids=False), "event_type", "value"), mean=6)


@register("chart_bar_count", f"WITH {ORDERS} SELECT o_orderpriority AS x, count(*) AS \"count\" FROM d WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return charts.bar(orders(spark, sf, False), "o_orderpriority")


@register(
    "chart_filter",
    "SELECT l_linestatus AS x, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity = 24 GROUP BY 1",
)
def _(spark, sf):
    return rounded(charts.bar(charts.where(lineitem(spark, sf), "l_quantity", "24"), "l_linestatus", "l_extendedprice"), mean=4)


@register(
    "chart_filter_blank",
    f"WITH {ORDERS} SELECT o_orderstatus AS x, count(*) AS \"count\" FROM d WHERE o_orderpriority IS NULL GROUP BY 1",
)
def _(spark, sf):
    return charts.bar(charts.where(orders(spark, sf, False), "o_orderpriority", "[Blank]"), "o_orderstatus")


@register(
    "chart_histogram",
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
 h AS (SELECT CAST(least(9, floor((value - lo) / ((hi - lo) / 10))) AS BIGINT) AS bin, count(*) AS n FROM events, r GROUP BY 1)
SELECT b.bin, round(lo + b.bin * (hi - lo) / 10, 6) AS "from", round(lo + (b.bin + 1) * (hi - lo) / 10, 6) AS "to", coalesce(n, 0) AS "count"
 FROM range(10) b(bin) CROSS JOIN r LEFT JOIN h ON b.bin = h.bin""",
)
def _(spark, sf):
    return rounded(charts.histogram(load(spark, sf, "events", row_ids=False), "value"), **{"from": 6, "to": 6})


@register(
    "chart_filter_double",
    "SELECT l_returnflag AS x, count(*) AS count FROM lineitem WHERE l_discount = 0.05 GROUP BY 1",
)
def _(spark, sf):
    return charts.bar(charts.where(lineitem(spark, sf), "l_discount", "0.05"), "l_returnflag")


@register("chart_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def _(spark, sf):
    return charts.scatter(lineitem(spark, sf), "l_quantity", "l_extendedprice")


@register(
    "chart_scatter_binned",
    """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem)
SELECT CAST(least(19, floor((l_quantity - a) / ((b - a) / 20))) AS BIGINT) AS x_bin,
 CAST(least(19, floor((l_extendedprice - c) / ((e - c) / 20))) AS BIGINT) AS y_bin, count(*) AS "count" FROM lineitem, r GROUP BY 1, 2""",
)
def _(spark, sf):
    return charts.scatter_binned(lineitem(spark, sf), "l_quantity", "l_extendedprice", bins=20)


@register("chart_line", f"WITH {ORDERS} SELECT _rowId, o_custkey::DOUBLE AS x, o_totalprice AS y FROM d WHERE o_totalprice IS NOT NULL ORDER BY x, _rowId")
def _(spark, sf):
    return charts.line(orders(spark, sf), "o_custkey", "o_totalprice")


@register("chart_line_dates", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, o_totalprice AS y FROM orders")
def _(spark, sf):
    out = charts.line(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select(F.date_format("x", "yyyy-MM-dd").alias("x"), "y")


@register(
    "chart_pie",
    """SELECT event_type AS x, count(*) AS "count", round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share
 FROM events GROUP BY 1""",
)
def _(spark, sf):
    return rounded(charts.pie(load(spark, sf, "events", row_ids=False), "event_type"), share=6)


BOX = """q AS (SELECT event_type AS x, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
 FROM events GROUP BY 1), e AS (SELECT q.*, value AS y, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
 FROM events JOIN q ON event_type = x)"""


@register(
    "chart_box",
    f"""WITH {BOX} SELECT x, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
 min(y) FILTER (inside) AS whisker_low, max(y) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
 FROM e GROUP BY x""",
)
def _(spark, sf):
    return rounded(charts.box(load(spark, sf, "events", row_ids=False), "value", "event_type"), q1=4, median=4, q3=4)


@register("chart_box_outliers", f"WITH {BOX} SELECT x, y FROM e WHERE NOT inside")
def _(spark, sf):
    return charts.box_outliers(load(spark, sf, "events", row_ids=False), "value", "event_type")


@register(
    "chart_box_overall",
    f"""WITH {BOUNDS} SELECT 'all' AS x, round(any_value(q1), 4) AS q1, round(median(value), 4) AS median,
 round(any_value(q3), 4) AS q3, min(value) FILTER (value BETWEEN lower AND upper) AS whisker_low,
 max(value) FILTER (value BETWEEN lower AND upper) AS whisker_high,
 count(*) FILTER (value NOT BETWEEN lower AND upper) AS outliers FROM events, f""",
)
def _(spark, sf):
    return rounded(charts.box(load(spark, sf, "events", row_ids=False), "value"), q1=4, median=4, q3=4)


CORR_COLUMNS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(
    "correlation_matrix",
    "WITH d AS (SELECT l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)\n"
    + union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM d"
            for a in CORR_COLUMNS
            for b in CORR_COLUMNS
        ]
    ),
)
def _(spark, sf):
    t = derive(
        lineitem(spark, sf),
        *[F.nullif(F.col(c), F.lit(0.0)).alias(c) if c == "l_discount" else F.col(c) for c in CORR_COLUMNS],
    )
    return rounded(charts.correlation(t), r=6)


# More pairs than are aggregated side by side; zeros are missing.
WIDE_COLUMNS = {
    **{c: c for c in CORR_COLUMNS},
    **{f"m{k}": f"(l_orderkey * {k} + l_linenumber * {k % 5}) % {k + 5}" for k in range(1, 25)},
}


@register(
    "correlation_wide",
    "WITH d AS (SELECT "
    + ", ".join(f"nullif({e}, 0)::DOUBLE AS {c}" for c, e in WIDE_COLUMNS.items())
    + " FROM lineitem)\nSELECT unnest(["
    + ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'r': round(corr({a}, {b}), 6) + 0}}" for a in WIDE_COLUMNS for b in WIDE_COLUMNS
    )
    + "], max_depth := 2) FROM d",
)
def _(spark, sf):
    t = derive(
        load(spark, sf, "lineitem"), *[F.expr(f"nullif({e}, 0)").cast("double").alias(c) for c, e in WIDE_COLUMNS.items()]
    )
    return charts.correlation(t).select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


# --- model preparation ---------------------------------------------------------


@register(
    "ml_complete_cases",
    f"WITH {ORDERS} SELECT _rowId, o_totalprice, o_orderpriority FROM d WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def _(spark, sf):
    return prep.complete_cases(orders(spark, sf), ["o_totalprice"], "o_orderpriority").df


SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register(
    "ml_one_hot",
    "SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_nationkey::DOUBLE AS c_nationkey, "
    + ", ".join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS c_mktsegment_{s}" for s in SEGMENTS)
    + " FROM customer",
)
def _(spark, sf):
    return prep.one_hot(load(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@register(
    "ml_label_encode",
    "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS label FROM customer",
)
def _(spark, sf):
    t = load(spark, sf, "customer")
    label = prep.encode_label(t, "c_mktsegment", prep.class_labels(t, "c_mktsegment"))
    return t.df.select("c_custkey", "c_mktsegment", label.alias("label"))


@register("ml_target_coerce", "SELECT o_orderkey, CASE WHEN o_totalprice < 60000 THEN 0 ELSE o_totalprice END AS label FROM orders")
def _(spark, sf):
    t = infer(_orders_text(spark, sf))
    return t.df.select("o_orderkey", prep.numeric_target(t, "price_text").alias("label"))


def _split_sql(source: str, ratio: float = 0.8) -> str:
    return f"""h AS (SELECT *, {mix_sql("_rowId")} AS h FROM {source}),
 s AS (SELECT *, row_number() OVER (ORDER BY h, _rowId) AS place,
 row_number() OVER (ORDER BY h, _rowId) <= floor({ratio} * (SELECT count(*) FROM {source})) AS train FROM h)"""


@register("ml_split", f"WITH {ORDERS}, {_split_sql('d')} SELECT _rowId, train FROM s")
def _(spark, sf):
    df = orders(spark, sf).df
    return df.select(ROW_ID, prep.split_flag(df, 0.8).alias("train"))


@register(
    "ml_split_counts",
    """SELECT 'linear' AS model, 'regression' AS task, CAST(floor(0.75 * count(*)) AS BIGINT) AS train_rows,
 count(*) - CAST(floor(0.75 * count(*)) AS BIGINT) AS test_rows FROM orders""",
)
def _(spark, sf):
    return train(load(spark, sf, "orders"), "linear", ["o_custkey"], "o_totalprice", 0.75).split_counts()


@register(
    "ml_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
 round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem""",
)
def _(spark, sf):
    df = lineitem(spark, sf).df.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(prep.scale_columns(df, ["l_quantity", "l_tax"]), l_quantity=6, l_tax=6)


# --- models --------------------------------------------------------------------

ORDERS_PLAIN = "d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_custkey, o_totalprice, o_orderstatus FROM orders)"
CUSTOMER_PLAIN = "d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, * FROM customer)"


@register(
    "ml_linear",
    f"""WITH {ORDERS_PLAIN}, {_split_sql('d')} SELECT 'o_custkey' AS term, round(regr_slope(o_totalprice, o_custkey), 4) AS weight FROM s WHERE train
UNION ALL SELECT 'intercept', round(regr_intercept(o_totalprice, o_custkey), 4) FROM s WHERE train""",
)
def _(spark, sf):
    return rounded(train(load(spark, sf, "orders"), "linear", ["o_custkey"], "o_totalprice").coefficients(), weight=4)


@register(
    "ml_ridge",
    f"""WITH {ORDERS_PLAIN}, {_split_sql('d')}, m AS (SELECT avg(o_custkey) AS mx, stddev_pop(o_custkey) AS sx, avg(o_totalprice) AS my,
 covar_pop(o_custkey, o_totalprice) * count(*) / (stddev_pop(o_custkey) * (count(*) + 500.0)) / stddev_pop(o_custkey) AS w FROM s WHERE train)
SELECT 'o_custkey' AS term, round(w, 3) AS weight FROM m UNION ALL SELECT 'intercept', round(my - w * mx, 3) FROM m""",
)
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "ridge", ["o_custkey"], "o_totalprice", params={"alpha": 500.0})
    return rounded(r.coefficients(), weight=3)


def _evaluated(model: str, table: str, features: list[str], target: str) -> Query:
    def run(spark, sf):
        return train(load(spark, sf, table), model, features, target).metrics()

    return run


for _name, _table, _features, _target in (
    ("logistic", "lineitem", ["l_quantity", "l_extendedprice"], "l_linestatus"),
    ("tree_class", "lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"),
    ("tree_reg", "lineitem", ["l_quantity", "l_discount", "l_returnflag"], "l_extendedprice"),
    ("forest_class", "customer", ["c_nationkey", "c_acctbal"], "c_mktsegment"),
    ("forest_reg", "customer", ["c_nationkey", "c_mktsegment"], "c_acctbal"),
    ("svm_class", "orders", ["o_custkey", "o_totalprice"], "o_orderstatus"),
    ("svm_reg", "customer", ["c_nationkey", "c_mktsegment"], "c_acctbal"),
):
    register(f"ml_{_name}")(_evaluated(_name, _table, _features, _target))


KNN_SQL = f"""{CUSTOMER_PLAIN}, {_split_sql('d')}, k AS (SELECT t._rowId, t.{{y}} AS label, n.{{y}} AS y,
 row_number() OVER (PARTITION BY t._rowId ORDER BY (t.c_nationkey - n.c_nationkey) ** 2, n._rowId) AS place
 FROM s t JOIN s n ON n.train AND NOT t.train)"""


@register(
    "ml_knn_reg",
    f"""WITH {KNN_SQL.format(y='c_acctbal')} SELECT _rowId, any_value(label) AS label, round(avg(y), 4) AS prediction
 FROM k WHERE place <= 5 GROUP BY _rowId""",
)
def _(spark, sf):
    r = train(load(spark, sf, "customer"), "knn_reg", ["c_nationkey"], "c_acctbal", scale=False)
    return rounded(r.predictions.select(ROW_ID, "label", "prediction"), prediction=4)


@register(
    "ml_knn_class",
    f"""WITH e AS (SELECT c_custkey, c_nationkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS seg FROM customer),
 {KNN_SQL.replace("* FROM customer", "* FROM e").format(y="seg")},
 v AS (SELECT _rowId, any_value(label) AS label, y, count(*) AS n FROM k WHERE place <= 5 GROUP BY _rowId, y)
SELECT _rowId, any_value(label) AS label, arg_max(y, n * 1000 - y) AS prediction FROM v GROUP BY _rowId""",
)
def _(spark, sf):
    r = train(load(spark, sf, "customer"), "knn_class", ["c_nationkey"], "c_mktsegment", scale=False)
    return r.predictions.select(ROW_ID, "label", "prediction")


@register(
    "ml_linear_labels",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, lpad((o_orderkey % 600)::VARCHAR, 3, '0') AS k, o_totalprice FROM orders), {_split_sql('d')},
m AS (SELECT k, avg(o_totalprice) AS v FROM s WHERE train GROUP BY k)
SELECT _rowId, o_totalprice AS label, round(0.0013 + coalesce(m.v, (SELECT v FROM m ORDER BY k LIMIT 1)), 2) AS prediction FROM s LEFT JOIN m USING (k) WHERE NOT train""",
)
def _(spark, sf):
    k = F.lpad((F.col("o_orderkey") % 600).cast("string"), 3, "0")
    t = derive(load(spark, sf, "orders"), k.alias("k"), F.col("o_totalprice"))
    r = train(t, "linear", ["k"], "o_totalprice")
    # means of few prices end in half a cent; the addend keeps them off the edge of rounding
    return rounded(r.predictions.select(ROW_ID, "label", (F.col("prediction") + 0.0013).alias("prediction")), prediction=2)


@register(
    "ml_tree_reg_groups",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderstatus, o_totalprice FROM orders), {_split_sql('d')},
m AS (SELECT o_orderstatus, avg(o_totalprice) AS prediction FROM s WHERE train GROUP BY 1)
SELECT _rowId, o_totalprice AS label, round(prediction, 3) AS prediction FROM s JOIN m USING (o_orderstatus) WHERE NOT train""",
)
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "tree_reg", ["o_orderstatus"], "o_totalprice")
    return rounded(r.predictions.select(ROW_ID, "label", "prediction"), prediction=3)


@register(
    "ml_tree_class_groups",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderstatus,
 (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS y FROM orders), {_split_sql('d')},
c AS (SELECT o_orderstatus, y, count(*) AS n FROM s WHERE train GROUP BY ALL),
m AS (SELECT o_orderstatus, arg_max(y, n * 1000 - y) AS prediction FROM c GROUP BY 1)
SELECT _rowId, y AS label, prediction FROM s JOIN m USING (o_orderstatus) WHERE NOT train""",
)
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "tree_class", ["o_orderstatus"], "o_orderpriority")
    return r.predictions.select(ROW_ID, "label", "prediction")


# A class that leans clearly to one side in each status, and a number that most rows of a
# status share: any fitted model of the status must give the larger side, the shared number.
LEANING = "CASE WHEN (o_orderkey * 7 + o_custkey) % 10 < CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 7 ELSE 9 END THEN 'yes' ELSE 'no' END"
SHARED = "CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 30 ELSE 60 END + CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 7 - 3 ELSE 0 END"
LEANING_SQL = f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderstatus,
 CASE WHEN {LEANING} = 'yes' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM orders), {_split_sql('d')},
m AS (SELECT o_orderstatus, round(avg(y))::DOUBLE AS prediction FROM s WHERE train GROUP BY 1)
SELECT _rowId, y AS label, prediction FROM s JOIN m USING (o_orderstatus) WHERE NOT train"""


def _leaning(spark, sf, model, **params):
    t = derive(load(spark, sf, "orders"), F.col("o_orderstatus"), F.expr(LEANING).alias("leans"))
    return train(t, model, ["o_orderstatus"], "leans", params=params).predictions.select(ROW_ID, "label", "prediction")


@register("ml_logistic_groups", LEANING_SQL)
def _(spark, sf):
    return _leaning(spark, sf, "logistic")


@register("ml_forest_class_groups", LEANING_SQL)
def _(spark, sf):
    return _leaning(spark, sf, "forest_class", trees=20)


@register("ml_svm_class_groups", LEANING_SQL)
def _(spark, sf):
    return _leaning(spark, sf, "svm_class")


@register(
    "ml_svm_reg_groups",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, o_orderstatus, ({SHARED})::DOUBLE AS y FROM orders), {_split_sql('d')},
m AS (SELECT o_orderstatus, median(y) AS prediction FROM s WHERE train GROUP BY 1)
SELECT _rowId, y AS label, prediction FROM s JOIN m USING (o_orderstatus) WHERE NOT train""",
)
def _(spark, sf):
    t = derive(load(spark, sf, "orders"), F.col("o_orderstatus"), F.expr(SHARED).cast("double").alias("y"))
    r = train(t, "svm_reg", ["o_orderstatus"], "y")
    return r.predictions.select(ROW_ID, "label", F.round("prediction").alias("prediction"))


@register("ml_knn_scaled")
def _(spark, sf):
    t = load(spark, sf, "part")
    r = train(t, "knn_reg", ["p_size", "p_brand", "p_type"], "p_retailprice")
    return r.predictions.select(ROW_ID, "label", "prediction")


@register(
    "ml_naive_bayes",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS _rowId, c_acctbal AS x, c_nationkey::DOUBLE AS z,
 (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS y FROM customer), {_split_sql('d')},
a AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, stddev_pop(z) AS sz FROM s WHERE train),
w AS (SELECT _rowId, y, train, (x - mx) / sx AS x, (z - mz) / sz AS z FROM s, a),
c AS (SELECT y, ln(count(*)) AS p, avg(x) AS ax, var_pop(x) + 1e-9 AS vx, avg(z) AS az, var_pop(z) + 1e-9 AS vz FROM w WHERE train GROUP BY y),
l AS (SELECT _rowId, w.y AS label, c.y AS cls, p - 0.5 * (ln(vx) + (x - ax) ** 2 / vx + ln(vz) + (z - az) ** 2 / vz) AS ll
 FROM w JOIN c ON NOT train)
SELECT _rowId, any_value(label) AS label, arg_max(cls, ll) AS prediction FROM l GROUP BY _rowId""",
)
def _(spark, sf):
    r = train(load(spark, sf, "customer"), "naive_bayes", ["c_acctbal", "c_nationkey"], "c_mktsegment")
    return r.predictions.select(ROW_ID, "label", "prediction")


# --- evaluation ----------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Return flags as the label, guessed from the tax and discount."""
    guess = F.when(F.col("l_tax") > 0.05, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    return lineitem(spark, sf).df.select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


JUDGED = """d AS (SELECT l_returnflag AS y, CASE WHEN l_tax > 0.05 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END AS p FROM lineitem)"""


def _metrics_sql(source: str) -> str:
    return f"""WITH {source}, c AS (SELECT y, p, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT DISTINCT y AS k FROM c UNION SELECT DISTINCT p FROM c),
m AS (SELECT k, coalesce(sum(n) FILTER (y = k AND p = k), 0) AS tp, coalesce(sum(n) FILTER (y = k), 0) AS sup,
 coalesce(sum(n) FILTER (p = k), 0) AS prd FROM c, k GROUP BY k)
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * coalesce(tp / nullif(prd, 0), 0)) / sum(sup), 6) AS precision,
 round(sum(sup * coalesce(tp / nullif(sup, 0), 0)) / sum(sup), 6) AS recall,
 round(sum(sup * coalesce(2 * tp / nullif(sup + prd, 0), 0)) / sum(sup), 6) AS f1 FROM m"""


_METRIC_PLACES = dict(accuracy=6, precision=6, recall=6, f1=6)


@register("metrics_classification", _metrics_sql(JUDGED))
def _(spark, sf):
    return rounded(metrics.classification(_judged(spark, sf)), **_METRIC_PLACES)


@register("metrics_labels", _metrics_sql("d AS (SELECT quality AS y, toxic AS p FROM labels)"))
def _(spark, sf):
    df = load(spark, sf, "labels", row_ids=False).df
    return rounded(metrics.classification(df.select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))), **_METRIC_PLACES)


@register("confusion_matrix", f"WITH {JUDGED} SELECT y AS label, p AS prediction, count(*) AS n FROM d GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(_judged(spark, sf))


@register(
    "confusion_matrix_wide",
    f"""WITH {JUDGED} SELECT y AS label, count(*) FILTER (p = 'A') AS "A", count(*) FILTER (p = 'N') AS "N",
 count(*) FILTER (p = 'R') AS "R" FROM d GROUP BY 1""",
)
def _(spark, sf):
    return metrics.confusion_matrix(_judged(spark, sf), ["A", "N", "R"])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders", row_ids=False).df
    return df.select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score"))


ROC = """g AS (SELECT o_totalprice AS score, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n
 FROM orders GROUP BY 1), c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg
 FROM g WINDOW w AS (ORDER BY score DESC))"""


@register(
    "roc_curve",
    f"WITH {ROC} SELECT score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM c UNION ALL SELECT NULL, 0.0, 0.0",
)
def _(spark, sf):
    return rounded(metrics.roc_curve(_scored(spark, sf)), fpr=6, tpr=6)


@register("roc_auc", f"WITH {ROC} SELECT round(sum(n * (tp - p / 2)) / max(pos * neg), 6) AS auc FROM c")
def _(spark, sf):
    return rounded(metrics.roc_auc(_scored(spark, sf)), auc=6)


def _guessed(spark: SparkSession, sf: str) -> DataFrame:
    df = lineitem(spark, sf).df
    return df.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))


@register(
    "metrics_regression",
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT round(avg((y - p) ** 2), 1) AS mse, round(avg(abs(y - p)), 4) AS mae,
 round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM d""",
)
def _(spark, sf):
    return rounded(metrics.regression(_guessed(spark, sf)), mse=1, mae=4, r2=6)


@register(
    "actual_vs_predicted",
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT y AS actual, p AS predicted, least(min(y) OVER (), min(p) OVER ()) AS line_from,
 greatest(max(y) OVER (), max(p) OVER ()) AS line_to FROM d""",
)
def _(spark, sf):
    return metrics.actual_vs_predicted(_guessed(spark, sf))


@register("ml_importances")
def _(spark, sf):
    return train(load(spark, sf, "lineitem"), "tree_reg", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice").importances()


@register(
    "ml_importances_linear",
    f"""WITH {ORDERS_PLAIN}, {_split_sql('d')} SELECT 'o_custkey' AS feature,
 round(abs(regr_slope(o_totalprice, o_custkey)) * stddev_pop(o_custkey), 4) AS importance FROM s WHERE train""",
)
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "linear", ["o_custkey"], "o_totalprice")
    return rounded(r.importances(), importance=4)


SHAP = f"""WITH {ORDERS_PLAIN}, {_split_sql('d')}, m AS (SELECT avg(o_custkey) AS mx, stddev_pop(o_custkey) AS sx,
 regr_slope(o_totalprice, o_custkey) AS w FROM s WHERE train),
b AS (SELECT avg(o_custkey) AS base FROM s WHERE train),
e AS (SELECT _rowId, o_custkey FROM s WHERE NOT train),
x AS (SELECT _rowId, 'o_custkey' AS feature, (o_custkey - mx) / sx AS value, w * (o_custkey - base) AS phi FROM e, m, b)"""


@register("shap_linear", f"{SHAP} SELECT _rowId, feature, round(value, 6) AS value, round(phi, 3) AS phi FROM x")
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "linear", ["o_custkey"], "o_totalprice")
    return rounded(attribution.linear_attribution(r), value=6, phi=3)


@register("shap_summary", f"{SHAP} SELECT feature, round(avg(abs(phi)), 3) AS mean_abs FROM x GROUP BY 1")
def _(spark, sf):
    r = train(load(spark, sf, "orders"), "linear", ["o_custkey"], "o_totalprice")
    return rounded(attribution.attribution_summary(attribution.attribution(r)), mean_abs=3)


@register("shap_tree")
def _(spark, sf):
    r = train(load(spark, sf, "lineitem"), "tree_reg", ["l_quantity", "l_discount", "l_returnflag"], "l_extendedprice")
    return attribution.attribution(r)


@register(
    "shap_tree_two_levels",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS _rowId, (o_totalprice > 200000)::INTEGER AS a, o_custkey % 2 AS b,
 100 * (o_totalprice > 200000)::INTEGER + 10 * (o_custkey % 2) + o_orderkey % 3 AS y FROM orders), {_split_sql('d')},
t AS (SELECT a, b, avg(y) AS f, count(*) AS n FROM s WHERE train GROUP BY ALL),
ka AS (SELECT a, sum(f * n) / sum(n) AS v, sum(n) AS n FROM t GROUP BY a),
kb AS (SELECT t.b, sum(t.f * ka.n) / sum(ka.n) AS v FROM t JOIN ka ON t.a = ka.a GROUP BY t.b),
k0 AS (SELECT sum(f * n) / sum(n) AS v FROM t),
x AS (SELECT _rowId, (t.f - kb.v + ka.v - k0.v) / 2 AS pa, (t.f - ka.v + kb.v - k0.v) / 2 AS pb
 FROM s JOIN t ON s.a = t.a AND s.b = t.b JOIN ka ON ka.a = s.a JOIN kb ON kb.b = s.b, k0 WHERE NOT train)
SELECT _rowId, 'a' AS feature, round(pa, 6) AS phi FROM x UNION ALL SELECT _rowId, 'b', round(pb, 6) FROM x""",
)
def _(spark, sf):
    a, b = (F.col("o_totalprice") > 200000).cast("int"), F.col("o_custkey") % 2
    y = a * 100 + b * 10 + F.col("o_orderkey") % 3
    t = derive(load(spark, sf, "orders"), a.alias("a"), b.alias("b"), y.alias("y"))
    return rounded(attribution.attribution(train(t, "tree_reg", ["a", "b"], "y")), phi=6)


@register("shap_any_model")
def _(spark, sf):
    r = train(load(spark, sf, "customer"), "naive_bayes", ["c_acctbal", "c_nationkey"], "c_mktsegment")
    return attribution.attribution(r)


# --- reports and exports -------------------------------------------------------


@register(
    "report_summary",
    f"""{SUMMARY} SELECT n AS "rows", 3 AS "columns", m AS missing_cells, round_even(100.0 * m / (n * 3), 2) AS missing_pct,
 u AS duplicates, q AS quality_score, {BAND} AS quality_band,
 (SELECT round_even((count(*) * 4 + sum(octet_length(encode(p_brand)) + coalesce(octet_length(encode(p_type)), 0))) / 1024, 1) FROM d) AS size_kb,
 round_even(100 - round_even(100.0 * m / (n * 3), 2), 2) AS completeness_pct FROM s""",
)
def _(spark, sf):
    return report.report_summary(part(spark, sf, False))


@register(
    "report_schema",
    f"""WITH {ORDERS} """
    + union(
        [
            f"""SELECT {i + 1} AS number, '{c}' AS name, '{"Numeric" if c in PROFILE_NUMBERS else "Categorical"}' AS kind,
 round_even(100 - round_even(100.0 * (count(*) - count({c})) / count(*), 2), 1) AS complete_pct, count(DISTINCT {c}) AS "unique",
 {f"round_even(avg({c}), 4)" if c in PROFILE_NUMBERS else "CAST(NULL AS DOUBLE)"} AS mean FROM d"""
            for i, c in enumerate(ORDERS_COLUMNS)
        ]
    ),
)
def _(spark, sf):
    return report.report_schema(orders(spark, sf, False))


@register(
    "export_csv",
    f"""WITH {CUSTOMER} SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
 c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM d""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(customer(spark, sf), path)
    return spark.read.csv(path, header=True)


@register("export_json", f"WITH {CUSTOMER} SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM d")
def _(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(customer(spark, sf), path)
    return spark.read.json(path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register(
    "export_sql",
    f"""WITH {CUSTOMER} SELECT 'INSERT INTO customers (`c_custkey`, `c_name`, `c_nationkey`, `c_acctbal`, `c_mktsegment`) VALUES (' || c_custkey
 || ', ''' || c_name || ''', ' || c_nationkey || ', ' || coalesce(c_acctbal::VARCHAR, 'NULL') || ', ''' || c_mktsegment || ''');' AS value FROM d
UNION ALL SELECT '-- SQL insert script' UNION ALL SELECT '-- Table name: customers' UNION ALL SELECT '-- Rows: ' || count(*) FROM d""",
)
def _(spark, sf):
    path = scratch_path(spark, "sql")
    sinks.write_sql(customer(spark, sf), path, "customers")
    return spark.read.text(path)


@register(
    "export_preview",
    f"""WITH {CUSTOMER} SELECT c_custkey || ',' || c_name || ',' || c_nationkey || ',' || coalesce(c_acctbal::VARCHAR, '') || ',' || c_mktsegment AS value
 FROM d WHERE _rowId <= 10 UNION ALL SELECT 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment'""",
)
def _(spark, sf):
    return sinks.preview(customer(spark, sf), "csv")


@register(
    "export_preview_filtered",
    f"""WITH {CUSTOMER} SELECT value FROM (SELECT c_custkey || ',' || c_name || ',' || c_nationkey || ',' || coalesce(c_acctbal::VARCHAR, '') || ',' || c_mktsegment AS value
 FROM d WHERE c_mktsegment = 'BUILDING' ORDER BY _rowId LIMIT 10) UNION ALL SELECT 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment'""",
)
def _(spark, sf):
    return sinks.preview(grid.filter_equals(customer(spark, sf), "c_mktsegment", "BUILDING"), "csv")


@register(
    "export_preview_json",
    f"""WITH {CUSTOMER} SELECT '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
 || ',"c_acctbal":' || coalesce(c_acctbal::VARCHAR, 'null') || ',"c_mktsegment":"' || c_mktsegment || '"}}' AS value
 FROM d WHERE _rowId <= 10""",
)
def _(spark, sf):
    return sinks.preview(customer(spark, sf), "json")


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in REGISTRY.items() if e.sql}
