"""Delimited text files, read in blocks even where quoted cells hold line breaks.

Files are split into lines by byte ranges, as text is. Whether a line break ends a record
depends on all quotes before it, so each line is a function of the state it starts in
(between records, or inside quotes) to the one it ends in. A task composes those of its
block for either start and writes its lines with both outcomes. The blocks' functions,
composed in file order, give each block's true start, its first record's number and with
them every line's record. Lines that are a record are parsed where they are; only those
of records of several lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.functions.cells import NA_TOKENS, strip_missing
from burnish.operators.rank import BROADCAST_FILES
from burnish.session import checkpointed
from burnish.sources.inference import infer
from burnish.table import ROW_ID, PrepTable


def header_names(found: list[str | None]) -> list[str]:
    """Column names from a header: a repeated one gets .1, .2; an empty one its position."""
    names: list[str] = []
    for i, name in enumerate(found):
        name = name if name else f"Unnamed: {i}"
        base, k = name, 0
        while name in names:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
    return names


class Grammar:
    """Patterns of records whose fields end at a delimiter; quotes are doubled inside quotes."""

    def __init__(self, delimiter: str):
        self.delimiter = "\t" if delimiter == "\\t" else delimiter
        end = "".join(f"\\x{{{ord(c):x}}}" for c in self.delimiter)
        plain = f"[^{end}]" if len(self.delimiter) == 1 else f"(?:(?!{end})[\\s\\S])"
        closed = f'[^"]*+(?:""[^"]*+)*+"{plain}*+'  # what follows an opening quote, and up to the field's end
        field = f'(?:"{closed}|(?!"){plain}++|)'
        #: Lines that end between records, if they start there or inside quotes.
        self.whole = f"\\A{field}(?:{end}{field})*+\\z"
        self.closing = f"\\A{closed}(?:{end}{field})*+\\z"
        #: Each field of a record is group 1.
        self.fields = f"(?:\\A|{end})({field})"

    def options(self) -> dict[str, str]:
        return {
            "sep": self.delimiter, "quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": "true",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "inferSchema": "false",
        }


LINES = (
    "file bigint, path string, block bigint, line bigint, value string, blank boolean, "
    "in_a boolean, out_a boolean, n_a bigint, in_b boolean, out_b boolean, n_b bigint"
)


def passed(whole: np.ndarray, closing: np.ndarray, blank: np.ndarray, inside: bool, n: int) -> tuple[np.ndarray, ...]:
    """For lines in a row from a known start: whether each starts and ends inside quotes, and its record's number.

    ``whole`` and ``closing`` say whether a line ends between records if it starts
    between them or inside quotes. A line on which both agree settles the state; one
    that ends as it starts keeps it, and of the others every one turns it round.
    """
    at = np.arange(len(whole))
    turns = np.cumsum(~whole & closing)
    settled = np.maximum.accumulate(np.where(whole == closing, at, -1))
    known = settled >= 0
    base = np.where(known, ~whole[settled], inside)
    since = turns - np.where(known, turns[settled], 0)
    out = base ^ (since % 2 == 1)
    into = np.concatenate([[inside], out[:-1]])
    return into, out, n + np.cumsum(~into & ~blank)


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each block with their states for a start between records (a) and inside quotes (b)."""
    now, line, state = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        whole, closing, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "closing", "blank"))
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            if (file[a], block[a]) != now:
                now, line, state = (file[a], block[a]), 0, [(False, 0), (True, 0)]
            both = [passed(whole[a:b], closing[a:b], blank[a:b], *s) for s in state]
            state = [(bool(out[-1]), int(n[-1])) for _, out, n in both]
            parts.append((np.arange(line, line + b - a), *both[0], *both[1]))
            line += b - a
        number, *rest = (np.concatenate(x) for x in zip(*parts))
        first = pa.array(number != 0)
        path = pc.if_else(first, pa.scalar(None, pa.string()), batch.column("path").cast(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch["file"], path, batch["block"], pa.array(number), batch["value"], batch["blank"], *map(pa.array, rest)],
            names=[f.split()[0] for f in LINES.split(", ")],
        )


def lines_of(spark: SparkSession, path: str, grammar: Grammar, multi_line: bool) -> DataFrame:
    """All lines of the files, written once with what a start in either state makes of them."""
    value = F.col("value")
    text = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    quoted = value.contains('"') if multi_line else F.lit(False)
    seen = text.select(
        F.xxhash64("path").alias("file"), "path", "block", "value",
        value.isin("", "\r").alias("blank"),
        (~quoted | value.rlike(grammar.whole)).alias("whole"),
        (quoted & value.rlike(grammar.closing)).alias("closing"),
    )
    return checkpointed(seen.mapInArrow(follow, LINES), "lines")


def block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, path, inside, before): a block's true start, and its file's records before it."""
    ends = [F.max_by(F.col(c), F.col("line")).alias(c) for c in ("out_a", "n_a", "out_b", "n_b")]
    blocks = lines.groupBy("file", "block").agg(F.max("path").alias("path"), *ends)

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        part, out, inside, before = part.sort_values("block"), [], False, 0
        for r in part.itertuples():
            out.append((r.file, r.block, r.path, inside, before))
            inside, before = (r.out_b, before + r.n_b) if inside else (r.out_a, before + r.n_a)
        return pd.DataFrame(out, columns=["file", "block", "path", "inside", "before"]).assign(total=before)

    schema = "file bigint, block bigint, path string, inside boolean, before bigint, total bigint"
    return checkpointed(blocks.groupBy("file").applyInPandas(compose, schema), "blocks")


def records_of(lines: DataFrame, has_header: bool) -> tuple[DataFrame, int]:
    """(_rowId, record, header, own) of each record in file order, headers having no id, and the rows."""
    blocks = block_starts(lines)
    headers = 1 if has_header else 0
    rows = F.greatest(F.col("total") - headers, F.lit(0))
    files = blocks.groupBy("file").agg(F.max("path").alias("path"), F.max("total").alias("total")).withColumn("rows", rows)
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("shift"), "rows")
    known = checkpointed(blocks.join(files, "file").select("file", "block", "inside", "before", "shift", "rows"), "blocks")
    size = known.agg(F.count("*").alias("blocks")).first().blocks
    total = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    starts = known.drop("rows")
    met = lines.join(F.broadcast(starts) if size <= BROADCAST_FILES else starts, ["file", "block"])
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    told = pick("in").alias("into"), pick("out").alias("out"), (F.col("before") + pick("n")).alias("n")
    met = met.select("file", "block", "line", "value", "blank", "shift", *told)
    # checks that raise must not see other lines, in whatever order conditions are tested
    own = ~F.col("into") & ~F.col("out") & ~F.col("blank")
    alone = met.filter(own).select("n", "shift", "value", own.alias("own"))
    run = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    parts = met.filter("into OR out").groupBy("file", "n", "shift").agg(run.alias("p"))
    parts = parts.select("n", "shift", F.array_join(F.col("p.value"), "\n").alias("value"), F.lit(True).alias("own"))
    records = alone.unionByName(parts)
    header = F.col("n") == 1 if has_header else F.lit(False)
    number = F.when(~header, F.col("shift") + F.col("n") - headers)
    record = F.regexp_replace("value", "\r\\z", "")
    return records.select(number.alias(ROW_ID), record.alias("record"), header.alias("header"), "own"), total


def parsed(records: DataFrame, names: list[str], found: list[str | None], grammar: Grammar) -> DataFrame:
    """The fields of the records as text; wrong headers and rows with surplus fields raise when they are read."""
    record = F.col("record")
    fields = F.regexp_extract_all(record, F.lit(grammar.fields), F.lit(1))
    schema = ", ".join(f"f{i} string" for i in range(len(names))) + ", bad string"
    cells = F.from_csv(record, schema, {**grammar.options(), "columnNameOfCorruptRecord": "bad"})
    told = records.select(ROW_ID, "record", "header", "own", cells.alias("cells"))
    same = F.size(fields) == len(found)
    for i, name in enumerate(found):
        same = same & F.col("cells")[f"f{i}"].eqNullSafe(F.lit(name))
    other = F.raise_error(F.concat(F.lit("a file has another header: "), record)).cast("boolean")
    beyond = F.slice(fields, len(names) + 1, F.greatest(F.size(fields) - len(names), F.lit(0)))
    more = F.exists(beyond, lambda f: ~f.isin("", '""'))
    surplus = F.raise_error(F.concat(F.lit(f"a row has more than {len(names)} fields: "), record)).cast("boolean")
    row = F.when(F.col("cells")["bad"].isNotNull() & more, surplus).otherwise(F.lit(True))
    kept = F.when(~F.col("own"), F.lit(False)).when(F.col("header"), F.when(same, F.lit(False)).otherwise(other)).otherwise(row)
    return told.filter(kept).select(ROW_ID, *[F.col("cells")[f"f{i}"].alias(n) for i, n in enumerate(names)])


def scan_csv(
    spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, multi_line: bool = True
) -> tuple[DataFrame, int]:
    """Row ids in file order and all columns as text, named by the header or ``Col0..ColN``; and the row count.

    Every file must have the header of the first. A row with more fields than the header
    raises when it is read, unless what it has more is empty; a shorter one is filled
    with nulls. Blank lines between records are no rows. Records end with a line feed,
    with or without a carriage return before it; those inside quotes are kept as they are.
    """
    grammar = Grammar(delimiter)
    first = spark.read.csv(path, header=False, **{**grammar.options(), "multiLine": str(multi_line).lower()}).first()
    found = [] if first is None else list(first)
    names = header_names(found) if has_header else [f"Col{i}" for i in range(len(found))]
    if not names:
        return spark.createDataFrame([], f"{ROW_ID} bigint"), 0
    records, rows = records_of(lines_of(spark, path, grammar, multi_line), has_header)
    return parsed(records, names, found if has_header else [], grammar), rows


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    has_header: bool = True,
    multi_line: bool = True,
    name: str = "",
) -> PrepTable:
    """Load delimited files: missing tokens to null, types and kinds by value.

    Large files are read by many tasks. ``multi_line`` keeps quoted line breaks whole;
    turn it off to take every line for a record.
    """
    df, rows = scan_csv(spark, path, delimiter, has_header, multi_line)
    return infer(strip_missing(df, NA_TOKENS), name or path.rstrip("/").split("/")[-1], at_most=rows)
