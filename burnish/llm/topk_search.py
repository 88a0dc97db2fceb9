"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; each has a mean and a deviation. For two segments of
length L, the inner product is L * (m1 * m2 + r * s1 * s2) with a correlation r of at
most 1, so L * (m1 * m2 + s1 * s2) bounds it from above. (With |q - x|^2 =
|q|^2 + |x|^2 - 2 <q, x> the same sum bounds the distance from below.) The bounds are
tried with one segment, then with more; what still may reach the k best is scored
exactly, in integers.

Vectors live in blocks of bounded size; every query visits every block, one block at a
time in a task. Before that each query visits one block alone, which gives it a first
threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import meet, vectors_in_use
from burnish.session import checkpointed

LEVELS = (1, 4, 16)
#: Vectors of one block, and queries compared with it at once.
BLOCK = 8192
AT_ONCE = 256
LONG = 2**63


def matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def outline(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each vector's segments, scaled so that a product of two is the bound."""
    parts = x.reshape(len(x), segments, -1)
    mean, dev = parts.mean(2), parts.std(2)
    return np.concatenate([mean, dev], 1) * math.sqrt(parts.shape[2])


def exact(q: list, x: list, qi: np.ndarray, xi: np.ndarray, qm: np.ndarray, xm: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (qi, xi)."""
    if np.abs(qm).max(initial=0) * np.abs(xm).max(initial=0) * max(qm.shape[1], 1) < 2**53:
        out = np.empty(len(qi), dtype=np.int64)
        for a in range(0, len(qi), 65536):
            part = slice(a, a + 65536)
            out[part] = np.einsum("ij,ij->i", qm[qi[part]], xm[xi[part]]).astype(np.int64)
        return out
    whole = [sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for i, j in zip(qi, xi)]
    return np.array([min(max(v, -LONG), LONG - 1) for v in whole], dtype=np.int64)


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products.

    Components become floor(scale * x), x as double. Queries are the rows for which
    ``is_query``, a condition on the id column, holds; candidates all rows with another
    id. Ties go to the smaller id; fewer than k candidates give fewer rows.

    Vectors that are null or hold a null, NaN or infinite component, and rows with a
    null id, take no part. Repeated rows count once; an id with several vectors has
    each as a candidate and, if a query, a result for each. Vectors of different
    lengths compare as if padded with zeros. Components beyond the range of a long,
    and scores, are held at its ends. Extra columns are ignored; an empty table gives
    an empty result.
    """
    use = F.col(id_col).isNotNull() & vectors_in_use(F.col(vector_col))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.filter(use).select(F.col(id_col).alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = checkpointed(rows.distinct().withColumn("h", F.xxhash64("id", "v")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    step = LEVELS[-1]
    width = max(step, math.ceil((size.width or 0) / step) * step)
    n_blocks = max(1, math.ceil(size.n / block_rows))
    home = F.pmod("h", F.lit(n_blocks)).cast("int")

    def load(block: pd.DataFrame):
        x = matrix(block["v"], width)
        return block["id"].to_numpy(), list(block["v"]), x, [outline(x, s) for s in LEVELS]

    def probe(block, queries: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([answer(block, queries.iloc[a : a + AT_ONCE]) for a in range(0, len(queries), AT_ONCE)])

    def answer(block, queries: pd.DataFrame) -> pd.DataFrame:
        ids, x_list, x, outlines = block
        q_list, q = list(queries["v"]), matrix(queries["v"], width)
        own = queries["id"].to_numpy()
        floor = queries["least"].to_numpy(dtype=float)  # NaN: none known yet
        floor = np.where(np.isnan(floor), -np.inf, floor)
        slack = 1e-9 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) + 1e-6
        alive = own[:, None] != ids[None, :]
        for s, seen in zip(LEVELS, outlines):
            bound = outline(q, s) @ seen.T + slack
            alive &= bound >= floor[:, None]
            if s == LEVELS[0] and x.shape[0] > k:
                # the most promising ones give the first exact threshold
                first = np.argpartition(np.where(alive, -bound, np.inf), k, axis=1)[:, : k + 1].ravel()
                qi = np.repeat(np.arange(len(q)), k + 1)
                got = exact(q_list, x_list, qi, first, q, x).astype(float)
                got = np.where(alive[qi, first], got, -np.inf).reshape(len(q), k + 1)
                floor = np.maximum(floor, np.sort(got, axis=1)[:, 1])
        qi, xi = np.nonzero(alive)
        score = exact(q_list, x_list, qi, xi, q, x)
        keep = score.astype(float) >= floor[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        order = np.lexsort((ids[xi], -score.astype(object) if len(score) and score.min() == -LONG else -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        starts = np.searchsorted(qi, np.arange(len(q)))
        best = np.arange(len(qi)) - starts[qi] < k
        qi, xi, score = qi[best], xi[best], score[best]
        return pd.DataFrame({"query_id": own[qi], "h": queries["h"].to_numpy()[qi], "vec_id": ids[xi], "score": score})

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, h bigint, vec_id {kind}, score bigint"
    none = F.lit(None).cast("bigint")
    members = rows.select("id", "v", "h", none.alias("least"), home.alias("block"))
    queries = rows.filter("q")

    def ask(probes: DataFrame) -> DataFrame:
        return meet(members, probes, load, probe, schema, partitions=n_blocks)

    by_query = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    first = ask(queries.select("id", "v", "h", none.alias("least"), home.alias("block")))
    least = first.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k)
    known = queries.join(least.select(F.col("query_id").alias("id"), "h", F.col("score").alias("least")), ["id", "h"], "left")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    found = ask(known.select("id", "v", "h", "least", everywhere))
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
