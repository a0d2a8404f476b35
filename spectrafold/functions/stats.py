"""Aggregate expressions; all combine on the map side, none buffers its input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spectrafold.functions.fixed import EPS, TINY
from spectrafold.functions.scalar import as_col


def cv(x) -> Column:
    x = as_col(x)
    return F.stddev_pop(x) / (F.avg(x) + F.lit(EPS))


def excess_kurtosis(x) -> Column:
    """Population excess kurtosis; 0 below 4 values or without spread."""
    x = as_col(x)
    return F.when((F.count(x) < 4) | (F.stddev_pop(x) < F.lit(EPS)), 0.0).otherwise(F.kurtosis(x))


def entropy(weight) -> Column:
    """Shannon entropy of weight / sum(weight), without a second pass: ln S - sum(w ln w) / S."""
    w = as_col(weight)
    total = F.sum(w)
    inner = F.sum(F.when(w > 0, w * F.ln(w)).otherwise(0.0))
    return F.when(total < F.lit(TINY), 0.0).otherwise(
        F.ln(F.when(total > 0, total)) - inner / F.when(total > 0, total)
    )


def flatness(x, floor: float = TINY) -> Column:
    """Geometric over arithmetic mean; values are raised to floor inside the logarithm."""
    x = as_col(x)
    return F.exp(F.avg(F.ln(F.greatest(x, F.lit(floor))))) / (F.avg(x) + F.lit(floor))


def rms(x) -> Column:
    x = as_col(x)
    return F.sqrt(F.avg(x * x))


def crest(x) -> Column:
    return F.max(as_col(x)) / (rms(x) + F.lit(EPS))


def centroid(weight, x, eps: float = EPS) -> Column:
    return F.sum(as_col(weight) * as_col(x)) / (F.sum(as_col(weight)) + F.lit(eps))


def slope(y, x) -> Column:
    return F.regr_slope(as_col(y), as_col(x))


def fit_rmse(y, x) -> Column:
    """Root mean square residual of the line fit."""
    y, x = as_col(y), as_col(x)
    n = F.regr_count(y, x)
    rest = F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
    return F.sqrt(F.greatest(rest, F.lit(0.0)) / F.when(n > 0, n))


def share(condition: Column) -> Column:
    """Fraction of rows that satisfy the condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def effective_count(weight) -> Column:
    """1 / sum(p^2)."""
    w = as_col(weight)
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def sum_if(condition: Column, x) -> Column:
    return F.sum(F.when(condition, as_col(x)).otherwise(0.0))


def pearson(x, y) -> Column:
    """Pearson correlation; NULL where a side is constant (the built-in one fails there in ANSI mode)."""
    x, y = as_col(x), as_col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(scale > 0, scale)
