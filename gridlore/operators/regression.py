"""Weighted least squares from one pass of sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Gram:
    """Weighted cross products of y and the columns x; a single row reaches the driver."""

    def __init__(self, df: DataFrame, x: list[str], y: str, w: str):
        self.x = x
        columns = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
        n = len(columns)
        row = df.agg(*(F.sum(F.col(w) * columns[i] * columns[j]) for i in range(n) for j in range(i, n))).first()
        self.sums, values = np.zeros((n, n)), iter(row)
        for i in range(n):
            for j in range(i, n):
                self.sums[i, j] = self.sums[j, i] = next(values) or 0.0

    def solve(self, target: int, use: list[int]) -> tuple[np.ndarray, float]:
        """Coefficients and R2 of column `target` on the columns `use` (0 is the constant)."""
        s = self.sums
        a, b = s[np.ix_(use, use)], s[use, target]
        coef = np.linalg.lstsq(a, b, rcond=None)[0]
        rest = s[target, target] - 2 * coef @ b + coef @ a @ coef
        mean = s[0, target] / s[0, 0]
        whole = s[target, target] - mean * mean * s[0, 0]
        return coef, 1 - rest / whole if whole > 0 else 0.0

    def report(self) -> list[tuple[str, float, float, float]]:
        """(factor, coefficient, partial R2, variance inflation); partial is R2 less R2 without the factor."""
        k, y = len(self.x), len(self.x) + 1
        coef, full = self.solve(y, list(range(k + 1)))
        out = []
        for i, name in enumerate(self.x, 1):
            others = [j for j in range(k + 1) if j != i]
            out.append((name, float(coef[i]), full - self.solve(y, others)[1], 1 / max(1e-9, 1 - self.solve(i, others)[1])))
        return out
