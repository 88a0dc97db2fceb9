"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Rotations learnt by iterative quantisation turn unit vectors into binary codes whose
Hamming distance follows the angle. Each code is cut into 16-bit substrings, and each
substring is indexed. Two codes within Hamming radius r agree in at least one of m
substrings up to r // m bits, so probing each index for the near substring values finds
every code within r. Those within r are ranked by their exact cosine.

Only the rotations and the radius are fitted on a bounded sample; every row is indexed.
The index is cut into blocks of bounded size, and each query visits all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import meet, vectors_in_use
from burnish.llm.topk_search import matrix
from burnish.session import checkpointed

SUBSTRING = 16
BLOCK = 8192
AT_ONCE = 128
POPCOUNT = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)).astype(np.uint8)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 25) -> np.ndarray:
    """Orthogonal matrices side by side, each turned until signs lose least (width x bits)."""
    width = sample.shape[1]
    rng, found = np.random.default_rng(7), []
    for _ in range(math.ceil(bits / width)):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(sample) > width else 0):
            u, _, v = np.linalg.svd(sample.T @ np.sign(sample @ turn))
            turn = u @ v
        found.append(turn)
    return np.concatenate(found, 1)[:, :bits]


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Binary codes, as 16-bit substrings."""
    bits = np.packbits(x @ rotations > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every code of a to every code of b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for j in range(a.shape[1]):
        out += POPCOUNT[a[:, j, None] ^ b[None, :, j]]
    return out


def learn_radius(sample: np.ndarray, rotations: np.ndarray, k: int, share: float) -> int:
    """The radius that holds ``share`` of the sample's own true neighbours.

    A sample is sparser than the table, so its neighbours lie further away and the
    radius errs on the wide side.
    """
    asked = sample[:256]
    if len(sample) <= k + 1:
        return rotations.shape[1]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    c = codes(sample, rotations)
    far = np.take_along_axis(hamming(c[: len(asked)], c), best, axis=1)
    return int(np.quantile(far, share, method="higher"))


class MultiIndex:
    """One table from substring values to rows for each substring position."""

    def __init__(self, code: np.ndarray):
        self.code, self.tables = code, []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, starts = np.unique(code[order, j], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """True for every pair of codes within the radius (asked x rows)."""
        n, m = len(self.code), self.code.shape[1]
        hit = np.zeros((len(asked), n), dtype=bool)
        for j, (values, starts, order) in enumerate(self.tables):
            near = POPCOUNT[asked[:, j, None] ^ values[None, :]] <= radius // m
            hit[:, order] |= np.repeat(near, np.diff(starts), axis=1)
        if hit.mean() > 0.25:
            return hit & (hamming(asked, self.code) <= radius)
        qi, xi = np.nonzero(hit)
        far = POPCOUNT[asked[qi] ^ self.code[xi]].sum(1, dtype=np.int64)
        hit[qi, xi] = far <= radius
        return hit


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    bits: int = 256,
    share: float = 0.98,
    fit_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by cosine.

    Queries are the rows for which ``is_query``, a condition on the id column, holds;
    candidates all rows with another id. The score is the cosine in double precision of
    the original vectors; ties go to the smaller id. ``fit_rows`` bounds the sample on
    which rotations and radius are fitted; ``share`` is the share of the sample's true
    neighbours inside the radius. Where fewer than k rows of a block are within it, the
    radius grows for that query until k are or all rows have been taken.

    Vectors that are null, zero or hold a null, NaN or infinite component, and rows
    with a null id, take no part. Repeated rows count once; an id with several vectors
    has each as a candidate and, if a query, a result for each. Vectors of different
    lengths compare as if padded with zeros. Extra columns are ignored; an empty table
    gives an empty result.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    use = F.col(id_col).isNotNull() & vectors_in_use(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0)
    rows = vectors.filter(use).select(F.col(id_col).alias("id"), wide.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = checkpointed(rows.distinct().withColumn("h", F.xxhash64("id", "v")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size.width or 1)
    bits = math.ceil(bits / 64) * 64
    n_blocks = max(1, math.ceil(size.n / block_rows))
    sample = unit(matrix([r.v for r in rows.orderBy(F.xxhash64("h"), "id").limit(fit_rows).select("v").collect()], width))
    rotations = learn_rotations(sample, bits)
    radius = learn_radius(sample, rotations, k, share)

    def load(block: pd.DataFrame):
        x = matrix(block["v"], width)
        return block["id"].to_numpy(), x, np.linalg.norm(x, axis=1), MultiIndex(codes(unit(x), rotations))

    def probe(block, queries: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([answer(block, queries.iloc[a : a + AT_ONCE]) for a in range(0, len(queries), AT_ONCE)])

    def answer(block, queries: pd.DataFrame) -> pd.DataFrame:
        ids, x, norms, index = block
        q = matrix(queries["v"], width)
        own, asked = queries["id"].to_numpy(), codes(unit(q), rotations)
        other = own[:, None] != ids[None, :]
        need = np.minimum(k, other.sum(1))
        hit = index.within(asked, radius) & other
        reach = radius
        while (short := np.flatnonzero(hit.sum(1) < need)).size:
            reach += max(1, bits // 16)
            hit[short] = index.within(asked[short], reach) & other[short]
        qi, xi = np.nonzero(hit)
        score = np.empty(len(qi))
        for a in range(0, len(qi), 65536):
            i, j = qi[a : a + 65536], xi[a : a + 65536]
            score[a : a + 65536] = np.einsum("ij,ij->i", q[i], x[j]) / (np.linalg.norm(q[i], axis=1) * norms[j])
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi] < k
        qi, xi, score = qi[best], xi[best], score[best]
        return pd.DataFrame({"query_id": own[qi], "h": queries["h"].to_numpy()[qi], "vec_id": ids[xi], "score": score})

    kind = rows.schema["id"].dataType.simpleString()
    members = rows.select("id", "v", "h", F.pmod("h", F.lit(n_blocks)).cast("int").alias("block"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    probes = rows.filter("q").select("id", "v", "h", everywhere)
    schema = f"query_id {kind}, h bigint, vec_id {kind}, score double"
    found = meet(members, probes, load, probe, schema, partitions=n_blocks)
    by_query = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
