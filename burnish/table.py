"""The table every operator takes and returns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from burnish.functions.cells import FLOATING, NESTED, TEMPORAL, col, number, strip_missing
from burnish.functions.text import plain_number

ROW_ID = "_rowId"

NUMERIC = "Numeric"
DATE = "Date"
CATEGORICAL = "Categorical"


def kind_of_type(dtype: T.DataType) -> str:
    """The kind a typed column has without looking at its values."""
    if isinstance(dtype, NESTED):
        raise ValueError(f"a {dtype.simpleString()} column has no kind; drop or flatten it first")
    if isinstance(dtype, TEMPORAL):
        return DATE
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return NUMERIC
    return CATEGORICAL


@dataclass(frozen=True)
class PrepTable:
    """A DataFrame, the kind of each column, and whether row ids are known to run 1..n.

    Operators that remove rows leave gaps in ``_rowId`` and set ``dense`` to
    False. ``numbered()`` closes the gaps, so a chain of removals pays for one
    renumbering, and only when row ids are looked at.

    ``at_most`` bounds the row count. It is known from loading and stays true, as
    no operator adds rows; operators use it to choose a plan.
    """

    df: DataFrame
    kinds: Mapping[str, str] = field(default_factory=dict)
    name: str = ""
    dense: bool = True
    at_most: int | None = None

    @staticmethod
    def of(
        df: DataFrame,
        name: str = "",
        kinds: Mapping[str, str] | None = None,
        at_most: int | None = None,
        dense: bool = False,
    ) -> PrepTable:
        """Wrap a typed DataFrame; kinds come from the column types.

        ``dense`` vouches for row ids that run 1..n; others are closed up when used.
        """
        if kinds is None:
            kinds = {f.name: kind_of_type(f.dataType) for f in df.schema.fields if f.name != ROW_ID}
        return PrepTable(strip_missing(df), dict(kinds), name, dense, at_most)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    @property
    def has_row_ids(self) -> bool:
        return ROW_ID in self.df.columns

    @property
    def data(self) -> DataFrame:
        """The data columns, without the row id."""
        return self.df.drop(ROW_ID) if self.has_row_ids else self.df

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def kind(self, name: str) -> str:
        return self.kinds.get(name, CATEGORICAL)

    def columns_of(self, kind: str) -> list[str]:
        return [c for c in self.columns if self.kind(c) == kind]

    def require(self, *names: str) -> None:
        for n in names:
            if n not in self.columns:
                raise ValueError(f"unknown column: {n}")

    def require_row_ids(self) -> None:
        if not self.has_row_ids:
            raise ValueError("the table has no row ids; read it with row ids or use rank.number_rows")

    def col(self, name: str) -> Column:
        return col(name)

    def number(self, name: str) -> Column:
        return number(name, self.dtype(name))

    def text(self, name: str) -> Column:
        """Cells as users see them: numbers without an exponent where they are of usual size."""
        dtype = self.dtype(name)
        return plain_number(col(name), dtype) if isinstance(dtype, FLOATING) else col(name).cast("string")

    def with_df(self, df: DataFrame, **changes) -> PrepTable:
        return replace(self, df=df, **changes)

    def bound(self) -> int:
        """A bound on the row count; counts the rows where loading did not."""
        return self.df.count() if self.at_most is None else self.at_most

    def numbered(self) -> PrepTable:
        """The same rows with ``_rowId`` running 1..n again."""
        if self.dense or not self.has_row_ids:
            return self
        from burnish.operators.rank import renumber

        return self.with_df(renumber(self.df), dense=True)
