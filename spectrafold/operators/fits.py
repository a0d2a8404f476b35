"""Least squares with several regressors for all groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _solve(matrix: list[list[Column]], rhs: list[Column]) -> list[Column]:
    """Gaussian elimination written as columns; the matrices here are positive definite."""
    n = len(rhs)
    rows = [list(r) + [b] for r, b in zip(matrix, rhs)]
    for i in range(n):
        pivot = F.when(F.abs(rows[i][i]) > 0, rows[i][i])
        rows[i] = [c / pivot for c in rows[i]]
        for j in range(n):
            if j != i:
                factor = rows[j][i]
                rows[j] = [a - factor * b for a, b in zip(rows[j], rows[i])]
    return [r[n] for r in rows]


def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Coefficients c0 (constant), c1.. and r2 per group, from centred cross moments in one aggregation."""
    names = list(xs)
    moments = [F.avg(y).alias("_my"), F.var_pop(y).alias("_yy")]
    for i, a in enumerate(names):
        moments += [F.avg(a).alias(f"_m{i}"), F.covar_pop(a, y).alias(f"_y{i}")]
        moments += [F.covar_pop(a, b).alias(f"_s{i}_{j}") for j, b in enumerate(names) if j >= i]
    table = df.groupBy(*keys).agg(*moments)
    n = len(names)
    matrix = [[F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(n)] for i in range(n)]
    beta = _solve(matrix, [F.col(f"_y{i}") for i in range(n)])
    table = table.select("*", *[b.alias(f"c{i + 1}") for i, b in enumerate(beta)])
    constant, explained = F.col("_my"), F.lit(0.0)
    for i in range(n):
        constant = constant - F.col(f"c{i + 1}") * F.col(f"_m{i}")
        explained = explained + F.col(f"c{i + 1}") * F.col(f"_y{i}")
    r2 = F.when(F.col("_yy") > 0, explained / F.col("_yy")).otherwise(0.0)
    return table.select(*keys, constant.alias("c0"), *[f"c{i + 1}" for i in range(n)], r2.alias("r2"))
