"""A cleaning session: current table, undo, redo, reset and the operation log.

Versions are references to lazy tables, so history costs no copies of data.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators import clean
from burnish.plans.recipe import Recipe, Step, apply_step
from burnish.session import checkpointed, scratch_path
from burnish.sources.inference import reinfer
from burnish.table import PrepTable

# Versions kept for undo, and entries shown as recent.
UNDO_DEPTH = 25
RECENT = 5

LOG_SCHEMA = "id long, title string, description string, at timestamp"


class PrepSession:
    def __init__(
        self, table: PrepTable, max_depth: int = UNDO_DEPTH, audit: bool = False, cut_every: int | None = None
    ):
        """``audit`` counts what each step touches; ``cut_every`` writes the table
        to the shared folder every so many steps, to keep long lineage short."""
        self.original = table
        self.table = table
        self.max_depth = max_depth
        self.audit = audit
        self.cut_every = cut_every
        self.steps: list[Step] = []
        self._undo: list[tuple] = []
        self._redo: list[tuple] = []
        self.log: list[dict] = []
        self._write("Table loaded", f"{table.name or 'table'}: {len(table.columns)} columns")

    def _write(self, title: str, description: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.log = [*self.log, {"id": len(self.log) + 1, "title": title, "description": description, "at": now}]

    def _state(self) -> tuple:
        return self.table, self.log, self.steps

    def _restore(self, state: tuple) -> None:
        self.table, self.log, self.steps = state

    def _push(self) -> None:
        self._undo = [*self._undo, self._state()][-self.max_depth :]
        self._redo = []

    def apply(self, action: str, **params) -> PrepTable:
        """Run a cleaning step on the current table."""
        step = Step(action, params)
        after = apply_step(self.table, step)
        note = step.describe()
        if self.audit or action == "fill_missing":
            touched = clean.affected(self.table, action, **params).first()["affected"]
            if action == "fill_missing" and not touched:
                return self.table  # nothing to fill: no step, no log entry
        if self.audit:
            note = f"{note}; affected {touched}"
        self._push()
        if self.cut_every and (len(self.steps) + 1) % self.cut_every == 0:
            after = after.with_df(checkpointed(after.df))
        self.table = after
        self.steps = [*self.steps, step]
        self._write(step.title, note)
        return self.table

    def edit(self, edits: DataFrame) -> PrepTable:
        """Apply a batch of cell edits to the current table.

        The batch is kept as a table in the shared folder, which the recipe's step names.
        """
        path = scratch_path(self.table.df.sparkSession, "edits")
        edits.write.parquet(path)
        step = Step("edit_cells", {"path": path})
        after = apply_step(self.table, step)
        self._push()
        if self.cut_every and (len(self.steps) + 1) % self.cut_every == 0:
            after = after.with_df(checkpointed(after.df))
        self.table = after
        self.steps = [*self.steps, step]
        self._write(step.title, "a batch of cell edits")
        return self.table

    def undo(self) -> bool:
        if not self._undo:
            return False
        self._redo = [*self._redo, self._state()]
        self._restore(self._undo[-1])
        self._undo = self._undo[:-1]
        return True

    def redo(self) -> bool:
        if not self._redo:
            return False
        self._undo = [*self._undo, self._state()]
        self._restore(self._redo[-1])
        self._redo = self._redo[:-1]
        return True

    def reset(self) -> bool:
        """Back to the loaded table, with kinds decided anew; can itself be undone."""
        self._push()
        self.table = reinfer(self.original)
        self.steps = []
        self.log = []
        self._write("Reset", "all steps and edits taken back")
        return True

    def recipe(self) -> Recipe:
        """The steps that lead from the loaded table to the current one."""
        return Recipe(tuple(self.steps))

    def log_table(self) -> DataFrame:
        spark = self.original.df.sparkSession
        rows = [(e["id"], e["title"], e["description"], e["at"]) for e in self.log]
        return spark.createDataFrame(rows, LOG_SCHEMA)

    def recent(self, k: int = RECENT) -> DataFrame:
        return self.log_table().orderBy(F.desc("id")).limit(k)

    def ledger(self) -> DataFrame:
        """The log as lines of text."""
        step = F.concat_ws(
            " - ", F.concat(F.lit("Step #"), F.col("id")), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "title", "description"
        )
        return self.log_table().orderBy("id").select(step.alias("value"))

    def write_ledger(self, path: str) -> None:
        self.ledger().coalesce(1).write.text(path)
