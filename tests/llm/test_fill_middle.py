"""Fill-in-middle against slices of Python strings."""

import hashlib
import random
import re

import numpy as np
import pytest

from burnish.llm.fill_middle import BITS, WaveletMatrix, cut, fill_in_middle, restore, UNITS
from pyspark.sql import functions as F


def units_of(text, unit):
    """The text in pieces, one a unit; words take the white space behind them, the first also what is before it."""
    if unit == "codepoint":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [text[a if k else 0 : b] for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]


def by_hand(doc_id, text, unit="codepoint"):
    text = text or ""
    pieces = units_of(text, unit)
    n = len(pieces)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((a % (n + 1), b % (n + 1)))
    if n:
        head, body, tail = "".join(pieces[:p]), "".join(pieces[p:q]), "".join(pieces[q:])
    else:
        head, body, tail = "", "", text
    if d % 100 < 20:
        return n, "spm", len(head), len(body), f"<S>{tail}<P>{head}<M>{body}"
    return n, "psm", len(head), len(body), f"<P>{head}<S>{tail}<M>{body}"


def random_text(rng, n):
    return "".join(rng.choice(["a", "bc", " ", "\n", "\t", "é", "漢字", "🤦🏼", "x y", "<", "<S"]) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_ranks_and_places_are_those_of_a_scan(n):
    symbols = np.random.default_rng(n).integers(0, 5, n).astype(np.uint8)
    m = WaveletMatrix(symbols, BITS)
    at = np.arange(n + 1)
    for some in ((0,), (4,), (1, 3), (1, 2, 3, 4), (0, 1, 2, 3, 4)):
        hit = np.isin(symbols, some)
        assert (m.count(some, at) == np.concatenate([[0], np.cumsum(hit)])).all()
        places = np.flatnonzero(hit)
        k = np.arange(1, len(places) + 1)
        assert (m.select(some, k, np.zeros(len(k), int), np.full(len(k), n)) == places).all()


@pytest.mark.parametrize("unit", list(UNITS))
def test_cuts_are_those_of_slices(spark, docs_of, unit):
    rng = random.Random(3)
    rows = [(i, random_text(rng, rng.randint(0, 60))) for i in range(400)]
    rows += [(None, "no id at all"), (5, None), (6, ""), (7, "has <M> in it"), (8, " \n\t "), (9, "\n\n"), (10, "x" * 9)] * 2
    df = docs_of(rows)
    out = fill_in_middle(df, unit=unit)
    assert out.columns == [*df.columns, "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    got = [
        (r.doc_id, r.text, (r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text), r.back)
        for r in out.withColumn("back", restore(F.col("fim_text"), F.col("fim_form"))).collect()
    ]
    assert sorted((i is None, i or 0, t or "") for i, t, _, _ in got) == sorted((i is None, i or 0, t or "") for i, t in rows)
    for i, t, found, back in got:
        assert found == by_hand(i, t, unit)
        assert back == (t or "")
    assert {f[1] for _, _, f, _ in got} == {"plain", "psm", "spm"}


def test_long_texts_have_a_matrix_of_their_own(docs_of):
    rng = random.Random(4)
    long = random_text(rng, 3_000_000)
    rows = [(i, t) for i, t in enumerate(["before", long, "behind", long[:100]])]
    for r in fill_in_middle(docs_of(rows)).collect():
        assert (r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == by_hand(r.doc_id, rows[r.doc_id][1])


def test_shares_follow_the_percentages():
    found = list(cut(list(range(2000)), [b"some words"] * 2000, UNITS["word"], 1, 50, 80))
    forms = [f[1] for f in found]
    assert 900 < forms.count("plain") < 1100 and forms.count("spm") > 3 * forms.count("psm")


def test_other_units_are_refused(docs_of):
    with pytest.raises(ValueError, match="unit must be one of"):
        fill_in_middle(docs_of([(1, "x")]), unit="page")


def test_columns_of_these_names_are_replaced_and_empty_tables_stay_empty(docs_of):
    df = docs_of([(1, "a text")]).withColumn("fim_text", F.lit(1))
    out = fill_in_middle(df)
    assert out.columns.count("fim_text") == 1 and out.first().fim_text == by_hand(1, "a text")[-1]
    assert fill_in_middle(df.filter("doc_id > 1")).count() == 0
