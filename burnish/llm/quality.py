"""Quality classifier: regularised quadratic discriminant over document statistics.

Class means and covariances are sums that tasks pre-aggregate, so training reads any
number of labelled rows and the driver gets two small matrices. Covariances shrink
towards the pooled one and a scaled identity; their Cholesky factors are computed once
and go to the tasks, which score with two triangular products per batch.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.session import checkpointed

FEATURES = (
    "log_chars", "upper", "digit", "symbol", "exclaim", "pipe", "mean_word", "long_word", "distinct_words",
    "doubled_words", "top_word", "repeated_lines", "words_per_line", "stop_per_word", "shout_words", "odd_ends",
)

_WORD_SYMBOLS = re.compile(r"[^\W_]")


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, with half a count added so that 0 and 1 stay finite."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; an empty text has them all at no evidence."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    chars, words, lines = len(text), text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    doubled = sum(map(str.__eq__, words, words[1:]))
    shout = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    odd = sum(k for w, k in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:?)\"'"))
    # upper-case letters of all scripts; in ASCII text these are A-Z
    letters_upper = int(raw[65:91].sum()) if text.isascii() else sum(k for c, k in Counter(text).items() if c.isupper())
    letters = int(raw[65:91].sum() + raw[97:123].sum() + (raw[194:245].sum()))
    symbols = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    marks = int(raw[44] + raw[46])
    return [
        np.log1p(chars),
        _logit(letters_upper, letters),
        _logit(int(raw[48:58].sum()), chars),
        _logit(symbols - marks, chars),
        _logit(int(raw[33]), chars),
        _logit(int(raw[124]), chars),
        np.log1p(sum(len(w) * k for w, k in counts.items()) / n if n else 0),
        _logit(sum(k for w, k in counts.items() if len(w) > 12), n),
        np.log((len(counts) + 1) / np.sqrt(n + 1)),
        _logit(doubled, n),
        _logit(max(counts.values(), default=0), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        np.log((n + 1) / (len(lines) + 1)),
        _logit(marks, n),
        _logit(shout, n),
        _logit(odd, n),
    ]


def table_of(texts) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


@dataclass
class Discriminant:
    """Class means, cached inverse Cholesky factors, log determinants and log priors."""

    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray
    temper: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        dens = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.whiten[c].T
            dens.append(self.prior[c] - 0.5 * (self.logdet[c] + np.einsum("ij,ij->i", z, z)))
        return (dens[1] - dens[0]) / self.temper

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def fit(labelled: DataFrame, shrink: float, ridge: float, temper: float) -> Discriminant:
    """Sums of x and xx' by class over all rows (x, label); two rows reach the driver."""
    d = len(FEATURES)

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch["x"].to_numpy()).astype(float), batch["label"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                q[c] += own.T @ own
        yield pd.DataFrame({"label": [0, 1], "values": [np.concatenate([[n[c]], s[c], q[c].ravel()]) for c in (0, 1)]})

    width = 1 + d + d * d
    total = (
        labelled.filter("label IN (0, 1)")
        .mapInPandas(sums, "label int, values array<double>")
        .groupBy("label")
        .agg(*[F.sum(F.element_at("values", i + 1)).alias(f"v{i}") for i in range(width)])
        .collect()
    )
    found = {r.label: np.array([r[f"v{i}"] for i in range(width)], dtype=float) for r in total}
    if any(c not in found or found[c][0] == 0 for c in (0, 1)):
        # without both labels there is nothing to tell apart: every score is one half
        flat = np.zeros((2, d, d)) + np.eye(d)
        return Discriminant(np.zeros((2, d)), flat, np.zeros(2), np.zeros(2), temper)
    n = np.array([found[c][0] for c in (0, 1)])
    mean = np.stack([found[c][1 : 1 + d] / n[c] for c in (0, 1)])
    cov = np.stack([found[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = np.tensordot(n / n.sum(), cov, 1)
    whiten, logdet = [], []
    for c in (0, 1):
        one = (1 - shrink) * cov[c] + shrink * pooled
        one = (1 - ridge) * one + ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
        low = np.linalg.cholesky(one + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(whiten), np.array(logdet), np.log(n / n.sum()), temper)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    shrink: float = 0.5,
    ridge: float = 0.02,
    temper: float = 4.0,
) -> DataFrame:
    """All rows and columns, with score (0 to 1, higher: label 1 likelier) and predicted.

    Learns from every labelled row for which ``train``, a condition on the id column, holds; scores use the
    text alone. ``shrink`` moves each covariance towards the pooled one, ``ridge``
    towards its diagonal; ``temper`` divides the log odds, which correlated statistics
    overstate.

    Null and empty texts are scored alike. Rows with a null id are scored but not
    learnt from; labels other than 0 and 1 are ignored; several labels of one id count
    each, repeated rows too. Without rows of both labels every score is 0.5. Extra
    columns pass through; columns named score or predicted are replaced.
    """
    texts = docs.filter(train) if train is not None else docs

    @F.pandas_udf("array<float>")
    def x(text: pd.Series) -> pd.Series:
        return pd.Series(list(table_of(text).astype(np.float32)))

    # the statistics meet the labels, so that no text is shuffled
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = texts.select(F.col(id_col).alias("id"), x(F.col(text_col)).alias("x")).filter("id IS NOT NULL")
    # written between: a task that made statistics and summed them would run two Python workers, and Spark keeps those
    known = checkpointed(known, "statistics")
    model = fit(known.join(marks, "id"), shrink, ridge, temper)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(table_of(text)))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
