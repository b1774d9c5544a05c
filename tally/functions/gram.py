"""Centred cross products of a few columns: two aggregates, a small matrix on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Rows that have every column, the columns' means and the sums of products about them."""

    n: int
    means: np.ndarray
    products: np.ndarray

    def inverse(self) -> np.ndarray:
        """Inverse of the products (least-norm where columns depend on each other), from columns scaled to one."""
        scale = np.sqrt(np.diag(self.products))
        scale[scale == 0] = 1.0
        return np.linalg.pinv(self.products / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)

    def form(self, columns: Sequence[Column], matrix: np.ndarray) -> Column:
        """``(x - mean)' matrix (x - mean)`` as plain arithmetic."""
        z = [c - F.lit(float(m)) for c, m in zip(columns, self.means)]
        out = F.lit(0.0)
        for i in range(len(z)):
            for j in range(i, len(z)):
                out = out + F.lit(float(matrix[i, j]) * (1 if i == j else 2)) * z[i] * z[j]
        return out


def moments(rows: DataFrame, columns: Sequence[Column]) -> Moments:
    """Of rows without missing values; the means come first, so that the products do not cancel."""
    k = len(columns)
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = np.array([first[f"m{i}"] if first["n"] else 0.0 for i in range(k)], dtype=float)
    z = [c - F.lit(float(m)) for c, m in zip(columns, means)]
    sums = rows.agg(*[F.coalesce(F.sum(z[i] * z[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    products = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return Moments(int(first["n"]), means, products)
