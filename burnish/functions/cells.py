"""What one cell holds: missing, a number, a date or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean a missing cell in delimited files.
NA_TOKENS = (
    "",
    " ",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Spark's cast also takes 1d and 1f, which are not numbers in a data file.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

# Dates in digits, rewritten to year-month-day before one cast. Month comes first
# unless the first number cannot be a month or the parts are split by dots.
DIGIT_DATE = r"^\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4}([ T][0-9:.+Zz-]+)?)?$"
YEAR_FIRST = r"^\d{4}-"
DATE_ORDERS = (
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})\b", "$1-$2-$3"),
    (r"^(1[3-9]|2\d|3[01])[-/](\d{1,2})[-/](\d{4})\b", "$3-$2-$1"),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b", "$3-$1-$2"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\b", "$3-$2-$1"),
)

# Dates with a month's name: the shape a text must have, and its format. A failed
# parse costs far more than a failed match.
NAMED_DATES = (
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLOATING = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for working columns that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def parse_number(value: Column) -> Column:
    """A double where the text is a number, else null."""
    return F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double"))


def parse_date(value: Column) -> Column:
    """A timestamp where the text is a date, else null."""
    value = F.trim(value)
    iso = value
    for order, rewritten in DATE_ORDERS:
        iso = F.regexp_replace(iso, order, rewritten)
    iso = F.when(value.rlike(YEAR_FIRST), value).otherwise(iso)  # nothing to rewrite
    out = F.when(value.rlike(DIGIT_DATE), iso.try_cast("timestamp_ntz"))
    for shape, form in NAMED_DATES:
        out = out.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form)).cast("timestamp_ntz"))
    return out


def number(name: str, dtype: T.DataType) -> Column:
    """A column read as a double; null where it holds no number.

    Tables hold no NaN (see ``strip_missing``), so numbers are taken as they are.
    """
    c = col(name)
    if isinstance(dtype, T.StringType):
        return parse_number(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def strip_missing(df: DataFrame, tokens: tuple[str, ...] = ()) -> DataFrame:
    """One notion of missing: NaN becomes null, and so do the given texts."""
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, FLOATING):
            c = F.nullif(c, F.lit(float("nan")).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType) and tokens:
            c = F.when(~c.isin(*tokens), c)
        out.append(c.alias(field.name, metadata=field.metadata))
    return df.select(*out)
