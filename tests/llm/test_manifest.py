"""The Merkle manifest against one built by hand, and its proofs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from burnish.llm.manifest import FANOUT, folded, merkle_manifest, prove, sha

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, s int, r int, n int, leaf string, digest int, root int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows], SCHEMA)


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_by_hand(leaves):
    """The root of some digests and, for each, the segments of its proof with its place in each run."""
    proofs = [[] for _ in leaves]
    at, nodes = list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for proof, i in zip(proofs, at):
            run, j = runs[i // 16], i % 16
            proof.append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, nodes = [i // 16 for i in at], [H("".join(run)) for run in runs]
    return nodes[0], proofs


def by_hand(rows, tampered=()):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        trees[s] = (own, *tree_by_hand([leaf_by_hand(r) for r in own]))
    root, above = tree_by_hand([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above):
        own, subroot, proofs = trees[s]
        for row, low in zip(own, proofs):
            h = leaf = leaf_by_hand(row)
            if row[0] in tampered and row[4] is not None:
                h = leaf_by_hand((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for before, behind in low + up:
                h = H(before + h + behind)
            out.append((row[0], leaf, subroot, root, H("".join(a + b for a, b in low + up)), h, h == root))
    return sorted(out, key=str)


def found(df, tampered=()):
    out = merkle_manifest(df, tampered=F.col("doc_id").isin(*tampered) if tampered else None)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 3)
            text = rng.choice(["Some Text", "no capitals", "É only", "漢字 A"]) + str(i)
            rows.append((i, source, rng.choice(["en", None, ""]), rng.choice([None, 5]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 300, "b": 1, None: 17, "": 16, "é": 33, "z": 257},  # up to three levels, lone leaves, short last runs
        {f"s{i}": 1 + i % 3 for i in range(40)},  # two levels of sources, trees of one leaf
        {"only": 40},  # no tree above
        {"only": 1},
    ],
)
def test_digests_and_proofs_are_those_built_by_hand(spark, sizes):
    rows = rows_of(sizes)
    tampered = {r[0] for r in rows[::3]}
    got = found(table(spark, rows), tampered)
    assert got == by_hand(rows, tampered)
    if len(rows) > 40:
        assert {r[-1] for r in got} == {True, False}


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [(None, "a", None, None, None), (None, "a", "en", 1, "x"), (1, "a", "en", 0, ""), (1, "a", "en", 0, ""), (1, "a", "en", None, None)]
    rows += [(2, None, "en", 7, "Word " * 400_000), (3, None, "en", 7, None)] + [(9, "copies", "en", 3, "Same")] * 600
    assert found(table(spark, rows), {1, 2, 3}) == by_hand(rows, {1, 2, 3})


def test_one_source_over_many_partitions(spark):
    rows = rows_of({"hot": 2000, "b": 3, "c": 400}, seed=5)
    assert found(table(spark, rows).repartition(7)) == by_hand(rows)


def test_an_empty_table_gives_an_empty_table(spark):
    assert found(table(spark, [(1, "a", "b", 2, "c")]).filter("doc_id > 1")) == []


def test_a_proof_fails_for_any_other_leaf():
    leaves = [sha(bytes([i]) * 32) for i in range(FANOUT)]
    proofs, roots = prove(leaves, [], [], b"".join(leaves), list(range(FANOUT)))
    assert set(roots) == {sha(b"".join(leaves)).hex()} and len(set(proofs)) == FANOUT
    others = b"".join(leaves[1:])
    assert folded(leaves[0], [others], [0]).hex() == roots[0]
    assert folded(leaves[1], [others], [0]).hex() != roots[0] and folded(leaves[0], [others], [1]).hex() != roots[0]
