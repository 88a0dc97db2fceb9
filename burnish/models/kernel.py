"""Random Fourier features (Rahimi and Recht 2007) for the RBF kernel.

Spark has no kernel machine. A linear model on these features approaches the
kernel machine as their number grows; results are close to it, not equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 256


def default_gamma(spreads: list[float], means: list[float]) -> float:
    """One over (features x variance of all training cells)."""
    d = len(spreads)
    overall = sum(means) / d
    variance = sum(s * s + (m - overall) ** 2 for s, m in zip(spreads, means)) / d
    return 1.0 / (d * variance) if variance > 0 else 1.0


def fourier(df: DataFrame, width_in: int, gamma: float, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """Replace ``features`` by ``width`` cosine features."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (width_in, width))
    shifts = rng.uniform(0.0, 2 * np.pi, width)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()) @ weights + shifts
        return pd.Series(list(np.sqrt(2.0 / width) * np.cos(z)))

    return df.withColumn("features", array_to_vector(lift(vector_to_array("features"))))
