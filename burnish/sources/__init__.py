"""Reading tables and finding out what their columns hold."""

from burnish.sources.delimited import read_csv
from burnish.sources.inference import infer, infer_kinds
from burnish.sources.files import read_parquet

__all__ = ["infer", "infer_kinds", "read_csv", "read_parquet"]
