"""Profiles of partial quotients, per sequence and for pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spectrafold.functions import scalar
from spectrafold.operators.quotients import sequence_rows
from spectrafold.operators.ranks import row_rank_corr
from spectrafold.session import share_package
from spectrafold.sources.tables import is_prime

FEATURES = (
    "gk_deviation levy_exponent large_a_freq adic2_depth odd_even_ratio prime_fraction consec_corr run_length_1 max_coeff digit_mod"
).split()
PAIR_FEATURES = "cross_corr shared_large gcd_coprime mod_mutual_info".split()
TAIL = 200


def _pmf(k: int) -> float:
    return math.log2(1 + 1.0 / (k * (k + 2)))


def reference_shares() -> tuple[list[float], list[float]]:
    """Expected shares of quotients 1..10 and 11+, and of residues 0, 1, 2 mod 3, with the tail cut at 200."""
    bins = [_pmf(k) for k in range(1, 11)] + [sum(_pmf(k) for k in range(11, TAIL + 1))]
    residues = [sum(_pmf(k) for k in range(1, TAIL + 1) if k % 3 == r) for r in range(3)]
    return bins, [r / sum(residues) for r in residues]


def _chi_square(shares, counts, n, keep):
    """Sum of (count - expected)^2 / expected over the kept cells, and the number of kept cells."""
    chi, cells = F.lit(0.0), F.lit(0)
    for share, count in zip(shares, counts):
        expected = n * F.lit(share)
        used = keep(expected)
        chi = chi + F.when(used, (count - expected) ** 2 / expected).otherwise(0.0)
        cells = cells + F.when(used, 1).otherwise(0)
    return chi, cells


def _count(values: Column, condition) -> Column:
    return F.size(F.filter(values, condition)).cast("double")


def _equal(values: Column, wanted: int, modulus: int | None = None) -> Column:
    """How many entries, or their residues, equal a number."""
    return _count(values, lambda x: (x if modulus is None else x % modulus) == wanted)


def cf_profile(quotients: DataFrame) -> DataFrame:
    """One row per seq_id from (seq_id, k, a, q); a_0 is left out, below three terms the features are NULL."""
    return cf_profile_rows(sequence_rows(quotients))


def cf_profile_rows(sequences: DataFrame) -> DataFrame:
    """The profile of rows (seq_id, a, q), each computed in its row: a sequence of 64-bit quotients has at most 91 terms."""
    a, n = F.col("a"), F.col("n")
    starts = lambda x, i: (x == 1) & (F.coalesce(F.get(a, i - 1), F.lit(0)) != 1)
    rest = F.greatest(F.size(a) - 1, F.lit(0))
    table = sequences.select(
        "seq_id", "q", "a", F.size(a).cast("double").alias("n"), F.slice(a, 1, rest).alias("_x"), F.slice(a, 2, rest).alias("_y"),
        *[_equal(a, i).alias(f"_b{i}") for i in range(1, 11)], _count(a, lambda x: x > 10).alias("_b11"),
        *[_equal(a, r, 3).alias(f"_m{r}") for r in range(3)], _count(a, starts).alias("_runs"))
    bins, residues = reference_shares()
    chi, cells = _chi_square(bins, [F.col(f"_b{i}") for i in range(1, 12)], n, lambda e: e >= 3)
    chi3, cells3 = _chi_square(residues, [F.col(f"_m{r}") for r in range(3)], n, lambda e: e > 3)
    features = {
        "gk_deviation": F.when(cells >= 3, chi / F.greatest(cells - 1, F.lit(1))),
        "levy_exponent": F.when(F.col("q") > 0, F.log2(F.col("q").cast("double")) / n).otherwise(0.0),
        "large_a_freq": F.col("_b11") / n,
        "adic2_depth": F.aggregate(a, F.lit(0.0), lambda s, x: s + scalar.valuation2(x)) / n,
        "odd_even_ratio": _count(a, lambda x: x % 2 == 1) / n,
        "prime_fraction": _count(a, is_prime) / n,
        "consec_corr": F.when(n > 3, row_rank_corr(F.col("_x"), F.col("_y"))).otherwise(0.0),
        "run_length_1": F.when(F.col("_runs") > 0, F.col("_b1") / F.col("_runs")).otherwise(0.0),
        "max_coeff": F.array_max(a).cast("double"),
        "digit_mod": F.when(cells3 >= 2, chi3),
    }
    return table.select("seq_id", *[F.when(n >= 3, features[f]).alias(f) for f in FEATURES])


def cf_cross(quotients: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per requested pair (a, b) from (seq_id, k, a, q): features of the quotients at equal depth, the longer one cut."""
    return cf_cross_rows(sequence_rows(quotients), pairs)


def _centred_ranks(values: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Average ranks of values within their rows of n values, less the middle rank."""
    order = np.lexsort((values, row))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(values)))
    place = np.repeat(first + (size - 1) / 2, size) - (np.cumsum(n) - n)[row]
    out = np.empty(len(values))
    out[order] = place + 1 - (n[row] + 1) / 2
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank sums and counts of rows (a, b, x, y), x and y of one length; sums of half ranks are exact in any order."""
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in "abxy")
        n = np.diff(x.offsets.to_numpy()).astype(np.int64)
        x, y = x.flatten().to_numpy(), y.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        total = lambda w: np.bincount(row, w, len(n))
        u, v = _centred_ranks(x, row, n), _centred_ranks(y, row, n)
        cell = np.fmod(x, 3) * 3 + np.fmod(y, 3)
        told = (cell >= 0) & (cell < 9)
        cells = np.bincount(row[told] * 9 + cell[told], minlength=9 * len(n)).reshape(-1, 9).astype(np.float64)
        columns = [total(u * v), total(u * u), total(v * v), total((x > 10) & (y > 10)), total(np.gcd(x, y) == 1), *cells.T]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(n.astype(np.float64)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["a", "b", *COMPARED])


COMPARED = ["n", "_xy", "_xx", "_yy", "_large", "_coprime", *[f"_c{i}{j}" for i in range(3) for j in range(3)]]


def cf_cross_rows(sequences: DataFrame, pairs: DataFrame) -> DataFrame:
    """The features of pairs from rows (seq_id, a, q): two joins bring two arrays together, the rest is per batch of rows.

    Pairs with a sequence that has no term after a_0 are left out; a pair requested twice has two rows.
    """
    share_package(pairs.sparkSession)
    left = sequences.select(F.col("seq_id").alias("a"), F.col("a").alias("x"))
    right = sequences.select(F.col("seq_id").alias("b"), F.col("a").alias("y"))
    depth = F.least(F.size("x"), F.size("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").where(depth > 0)
    rows = rows.select("a", "b", F.slice("x", 1, depth).alias("x"), F.slice("y", 1, depth).alias("y"))
    ids = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in "ab")
    rows = rows.mapInArrow(_compare, ids + "".join(f", {c} double" for c in COMPARED))
    n = F.col("n")
    joint = [[F.col(f"_c{i}{j}") / n for j in range(3)] for i in range(3)]
    information = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            apart = sum(joint[i]) * sum(line[j] for line in joint)
            information = information + F.when(joint[i][j] > 0, joint[i][j] * F.log2(joint[i][j] / F.when(joint[i][j] > 0, apart))).otherwise(0.0)
    flat = F.least("_xx", "_yy") <= 1e-20 * n
    features = {
        "cross_corr": F.when(flat, 0.0).otherwise(F.col("_xy") / F.sqrt(F.when(~flat, F.col("_xx") * F.col("_yy")))),
        "shared_large": F.col("_large") / n, "gcd_coprime": F.col("_coprime") / n, "mod_mutual_info": information,
    }
    return rows.select("a", "b", *[F.when(n >= 3, features[f]).alias(f) for f in PAIR_FEATURES])
