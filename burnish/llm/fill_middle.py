"""Fill-in-middle: texts cut in three and put together with the middle last.

The bytes of many texts form one sequence of character classes, held in a wavelet
matrix. Ranks of the classes a unit is made of add up to the number of its boundaries
before any byte, which gives each text's length in units; the byte of the k-th boundary
is found by bisection on those ranks, for all cuts of all texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import column, packed, unpacked

#: Classes of the bytes of UTF-8: inside a character; a line feed; other ASCII white
#: space; the first byte of a character inside a word, and of one that begins a word.
INSIDE, BREAK, BLANK, INNER, WORD = range(5)
BITS = 3
#: Bytes of text that share a matrix; a longer text has one of its own.
SHARED_BYTES = 1 << 22

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")


@dataclass(frozen=True)
class Unit:
    """What a text is cut into: the classes whose bytes mark a boundary, before or behind it."""

    classes: tuple[int, ...]
    behind: bool = False


UNITS = {
    "codepoint": Unit((BREAK, BLANK, INNER, WORD)),
    "word": Unit((WORD,)),
    "line": Unit((BREAK,), behind=True),
}


def _class_table() -> np.ndarray:
    table = np.full(256, INNER, dtype=np.uint8)
    table[0x80:0xC0] = INSIDE
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    table[0x0A] = BREAK
    return table


CLASS_OF = _class_table()


def classes_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; ``starts`` are the first bytes of texts, where a word may begin."""
    out = CLASS_OF[data]
    blank = (out == BREAK) | (out == BLANK)
    opens = np.empty(len(out), dtype=bool)
    opens[1:] = blank[:-1]
    opens[starts[starts < len(out)]] = True
    out[opens & (out == INNER)] = WORD
    return out


class WaveletMatrix:
    """Counts of symbols before any position, from one bit vector for each bit of a symbol.

    Each level keeps a bit of every symbol, in the order that sorting by the bits above
    leaves them, and the number of ones before every 64th place.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b) & 1 == 1
            words = np.zeros(self.n // 64 + 1, dtype=np.uint64)
            packed_bits = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed_bits)] = packed_bits
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, self.n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        low = words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return before[word] + np.bitwise_count(low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each of the positions."""
        low, high = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for (words, before, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1)):
            ones_low, ones_high = self._ones(words, before, low), self._ones(words, before, high)
            if symbol >> b & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of any of the symbols occur before each of the positions."""
        others = tuple(s for s in range(1 << self.bits) if s not in symbols)
        if len(others) < len(symbols):
            return at - self.count(others, at)
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), dtype=np.int64))

    def select(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 1, over all) of the symbols, known to be in [low, high)."""
        low, high = low.astype(np.int64), high - 1
        while (low < high).any():
            half = (low + high) >> 1
            enough = self.count(symbols, half + 1) >= k
            high, low = np.where(enough, half, high), np.where(enough, low, np.minimum(half + 1, high))
        return low


def hash_words(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits from the seed and a document's id; no id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(
    ids: list, texts: list[bytes], unit: Unit, seed: int, fim_percent: int, spm_percent: int
) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """(units, form, prefix_chars, middle_chars, text) of each of the texts."""
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    matrix = WaveletMatrix(classes_of(np.frombuffer(b"".join(texts), dtype=np.uint8), starts), BITS)
    before = matrix.count(unit.classes, starts)
    units = matrix.count(unit.classes, ends) - before
    if unit.behind:  # what follows the last boundary is one more
        last = matrix.count(unit.classes, np.maximum(ends - 1, starts))
        units += (ends > starts) & (before + units == last)
    h = np.array([hash_words(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (units + 1), h[:, 1] % (units + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = np.where(k >= units, np.where(units > 0, ends, starts), starts)
        inner = np.flatnonzero((k > 0) & (k < units))
        found = matrix.select(unit.classes, before[inner] + k[inner] + (not unit.behind), starts[inner], ends[inner])
        at[inner] = found + unit.behind
        places.append(at)
    chars = UNITS["codepoint"].classes
    edges = [matrix.count(chars, p) for p in (starts, *places)]
    for i, text in enumerate(texts):
        marked = any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE))
        if not text or marked or h[i, 2] % 100 >= fim_percent:
            yield int(units[i]), "plain", None, None, text
            continue
        p, q = (int(x[i] - starts[i]) for x in places)
        head, body, tail = text[:p], text[p:q], text[q:]
        form = "spm" if h[i, 3] % 100 < spm_percent else "psm"
        head, tail = PREFIX.encode() + head, SUFFIX.encode() + tail
        out = b"".join([*((tail, head) if form == "spm" else (head, tail)), MIDDLE.encode(), body])
        yield int(units[i]), form, int(edges[1][i] - edges[0][i]), int(edges[2][i] - edges[1][i]), out


def fill_in_middle(
    docs: DataFrame,
    unit: str = "codepoint",
    seed: int = 1,
    fim_percent: int = 90,
    spm_percent: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns, with fim_units, fim_form, fim_prefix_chars, fim_middle_chars, fim_text.

    Each whole text is cut at two boundaries of its units (codepoint, word or line; a
    word goes with the white space behind it, a line with its line feed) that two hashes
    of the id choose. ``fim_text`` is prefix, suffix, middle (form psm) or suffix,
    prefix, middle (form spm, ``spm_percent`` of them), each behind its sentinel, or the
    text itself (form plain): of 100 - ``fim_percent`` percent of the rows, of empty
    texts and of those that hold a sentinel. fim_prefix_chars and fim_middle_chars are
    code points, null where the form is plain. restore() gives the text back.

    Null texts are empty. Rows with a null id are cut as if it were empty. Repeated rows
    and rows of one id are cut alike. Texts of any length are cut whole. Extra columns
    pass through; columns named like the new ones are replaced. An empty table gives an
    empty table.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    @F.pandas_udf("fim_units bigint, fim_form string, fim_prefix_chars bigint, fim_middle_chars bigint, fim_text string")
    def cuts(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out, some, have = [], ([], []), 0
        for i, t in zip(ids, texts):
            data = (t or "").encode()
            if some[0] and have + len(data) > SHARED_BYTES:
                out += cut(*some, UNITS[unit], seed, fim_percent, spm_percent)
                some, have = ([], []), 0
            some[0].append(i)
            some[1].append(data)
            have += len(data)
        if some[0]:
            out += cut(*some, UNITS[unit], seed, fim_percent, spm_percent)
        found = pd.DataFrame(out, columns=list(NEW)).astype({c: "Int64" for c in ("fim_prefix_chars", "fim_middle_chars")})
        found["fim_text"] = [t.decode() for t in found["fim_text"]]
        return found

    rows = docs.select(packed(docs).alias("_row"), cuts(column(id_col).cast("string"), column(text_col)).alias("_cut"))
    return rows.select(*unpacked(rows, "_row", {c: F.col(f"_cut.{c}") for c in NEW}))


def restore(text: Column, form: Column) -> Column:
    """The text that was cut, from what it became and its form."""
    part = F.split(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # a cut text holds none of them itself
    first, second, third = (F.try_element_at(part, F.lit(i)) for i in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(text)
    )
