"""Data preparation, profiling and modelling on Spark DataFrames."""

from burnish.session import build_session, tune
from burnish.table import CATEGORICAL, DATE, NUMERIC, ROW_ID, PrepTable

__all__ = [
    "CATEGORICAL",
    "DATE",
    "NUMERIC",
    "ROW_ID",
    "PrepTable",
    "build_session",
    "tune",
]
