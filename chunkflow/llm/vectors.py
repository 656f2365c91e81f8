"""Which vectors take part in the vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(v: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and has only finite components; adds dim. Components become doubles."""
    v = v.withColumn("vec", F.col("embedding").cast("array<double>"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(finite & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centres of rows; fewer than k where there are fewer different rows. Deterministic for a seed."""
    rng = np.random.default_rng(seed)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds if len(x) > k else 0):
        near = nearest(x, c)[0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        s = squared(x[i : i + 4096], c)
        at[i : i + 4096] = s.argmin(1)
        d[i : i + 4096] = s.min(1)
    return at, d
