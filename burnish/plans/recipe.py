"""A cleaning recipe: named steps that replay on any table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from burnish.operators import clean
from burnish.operators.edits import apply_edits
from burnish.session import checkpointed
from burnish.table import PrepTable



def edit_cells(t: PrepTable, path: str) -> PrepTable:
    """Apply the batch of edits that is kept as a table at ``path``."""
    return apply_edits(t, t.df.sparkSession.read.parquet(path))


ACTIONS = {
    "edit_cells": edit_cells,
    "remove_duplicates": clean.remove_duplicates,
    "drop_missing": clean.drop_missing,
    "fill_missing": clean.fill_missing,
    "drop_column": clean.drop_column,
    "rename_column": clean.rename_column,
    "replace_values": clean.replace_values,
    "standardize_strings": clean.standardize_strings,
    "remove_outliers": clean.remove_outliers,
}

TITLES = {
    "edit_cells": "Edit cells",
    "remove_duplicates": "Remove duplicates",
    "drop_missing": "Drop missing rows",
    "fill_missing": "Fill missing cells",
    "drop_column": "Drop column",
    "rename_column": "Rename column",
    "replace_values": "Replace values",
    "standardize_strings": "Standardize text",
    "remove_outliers": "Remove outliers",
}


@dataclass(frozen=True)
class Step:
    action: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unsupported operation: {self.action}")

    @property
    def title(self) -> str:
        return TITLES[self.action]

    def describe(self) -> str:
        if not self.params:
            return "all columns"
        return ", ".join(f"{k}={v}" for k, v in self.params.items())


def apply_step(t: PrepTable, step: Step) -> PrepTable:
    return ACTIONS[step.action](t, **step.params)


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()

    def then(self, action: str, **params) -> Recipe:
        return Recipe((*self.steps, Step(action, params)))

    def apply(self, t: PrepTable, cut_every: int | None = None) -> PrepTable:
        """Run the steps one after the other; rows are computed when asked for.

        ``cut_every`` writes the table to the shared folder every so many steps, so that
        a later step's statistic does not run all earlier steps again.
        """
        for number, step in enumerate(self.steps, 1):
            t = apply_step(t, step)
            if cut_every and number % cut_every == 0:
                t = t.with_df(checkpointed(t.df))
        return t

    def to_json(self) -> str:
        return json.dumps([asdict(s) for s in self.steps])

    @staticmethod
    def from_json(text: str) -> Recipe:
        return Recipe(tuple(Step(s["action"], s["params"]) for s in json.loads(text)))
