"""Line dedup: lines that several documents share go, but for one document's copy.

Two Bloom filters find the line hashes that may be in two or more documents. Only
those lines' 128-bit digests and document ids are shuffled, to count documents exactly
and to choose the document that keeps the line. Texts move once, to meet the lines to
drop.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import attach, column, packed, repeat_filter, send_suspects, unpacked
from burnish.session import checkpointed

BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for lines whose key is short."""
    keys = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANK)
        keys.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None)
    return keys


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    filter_bits: int = 1 << 26,
) -> DataFrame:
    """All rows and columns, the text without repeated lines, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more found in ``min_docs`` (at least 2)
    documents or more lose all their lines except in the largest id holding them.

    Null text is an empty text, one empty line. Rows with a null id keep every line
    and count for no other. Rows of one id are one document. n_lines counts lines
    before dropping. Extra columns pass through; columns named n_lines or n_dropped
    are replaced. An empty table gives an empty table.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def hashes(batch: pd.DataFrame) -> np.ndarray:
        found = []
        for text in batch["text"]:
            found.extend({k for k in line_keys(text, min_chars) if k})
        return np.frombuffer(b"".join(found), dtype="<u8")[::2]

    suspected = send_suspects(texts, repeat_filter(texts, hashes, filter_bits))

    def occurrences(batches):
        suspects = suspected.value
        for batch in batches:
            keys, ids = [], []
            for i, text in zip(batch["id"], batch["text"]):
                own = {k for k in line_keys(text, min_chars) if k}
                keys.extend(own)
                ids.extend([i] * len(own))
            if keys:
                hit = suspects(np.frombuffer(b"".join(keys), dtype="<u8")[::2])
                yield pd.DataFrame({"key": keys, "id": ids})[hit]

    kind = docs.schema[id_col].dataType.simpleString()
    seen = checkpointed(texts.mapInPandas(occurrences, f"key binary, id {kind}").distinct(), "lines")
    suspected.destroy()
    repeated = checkpointed(
        seen.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "repeated"
    )
    gone = attach(seen, repeated, "key", "n", seen.count()).filter("id <> keeper")
    by_doc = gone.groupBy("id").agg(F.collect_list("key").alias("_gone"))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def cut(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(text, drop):
            if d is None or not len(d):
                out.append((t or "", (t or "").count("\n") + 1, 0))
                continue
            d, lines = set(d), t.split("\n")
            kept = [x for x, k in zip(lines, line_keys(t, min_chars)) if k not in d]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    rest = docs.select(packed(docs, (text_col,)).alias("row"), column(id_col).alias("id"), column(text_col).alias("text"))
    joined = rest.join(by_doc, "id", "left").select("row", cut("text", "_gone").alias("cut"))
    done = unpacked(joined, "row", {text_col: F.col("cut.text"), "n_lines": F.col("cut.n_lines"), "n_dropped": F.col("cut.n_dropped")})
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return joined.select(*done).select(*map(column, order))
