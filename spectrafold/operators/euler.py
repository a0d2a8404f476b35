"""Points against the first K primes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def character_coefficients(primes: DataFrame, values: DataFrame, modulus: int) -> DataFrame:
    """Attach coef = chi(p mod modulus) from (residue, coef); residues not listed give 0."""
    return (
        primes.withColumn("residue", F.col("p") % modulus)
        .join(F.broadcast(values), "residue", "left")
        .withColumn("coef", F.coalesce("coef", F.lit(0.0)))
        .drop("residue")
    )


def point_terms(points: DataFrame, primes: DataFrame) -> DataFrame:
    """One row per point and k <= kmax.

    K is expanded inside the row and looked up by k, so the prime table (at most a
    few thousand rows, fixed by its limit) is an ordinary broadcast hash join.
    """
    ks = points.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("kmax"))))
    return ks.join(F.broadcast(primes), "k")


def envelope(terms: DataFrame, keys: tuple[str, ...] | list[str] = ("point_id",)) -> DataFrame:
    """fb = b / (1 + b) with b = w / running sum of w; a point has kmax rows at most."""
    weight = F.exp(-F.col("sigma") * F.col("ln_p"))
    upto = W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    b = F.col("_w") / F.sum("_w").over(upto)
    return terms.withColumn("_w", weight).withColumn("_b", b).withColumn("fb", F.col("_b") / (1 + F.col("_b"))).drop("_w", "_b")
