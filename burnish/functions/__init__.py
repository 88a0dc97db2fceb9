"""Column expressions: parsing, text and hashing."""

from burnish.functions.cells import NA_TOKENS, col, fresh, number, parse_date, parse_number, strip_missing
from burnish.functions.hashing import mix
from burnish.functions.text import plain_number, sql_literal, title_case, trim_all

__all__ = [
    "NA_TOKENS",
    "col",
    "mix",
    "number",
    "parse_date",
    "parse_number",
    "plain_number",
    "sql_literal",
    "strip_missing",
    "fresh",
    "title_case",
    "trim_all",
]
