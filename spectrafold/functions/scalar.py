"""Scalar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from spectrafold.functions.fixed import EPS, TINY


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def ratio(top, bottom, eps: float = EPS) -> Column:
    """top / (bottom + eps), the guarded quotient used throughout."""
    return as_col(top) / (as_col(bottom) + F.lit(eps))


def flag(condition: Column) -> Column:
    """A predicate as 0.0 / 1.0; NULL counts as false."""
    return F.when(condition, 1.0).otherwise(0.0)


def neighbour_ratio(a, b) -> Column:
    """Smaller over larger of two adjacent spacings; NULL if one is missing."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b) / (F.greatest(a, b) + F.lit(EPS)))


def prime_power(p, ln_p, sigma, t) -> tuple[Column, Column]:
    """Real and imaginary part of p^-(sigma + i t)."""
    size = F.exp(-as_col(sigma) * as_col(ln_p))
    angle = as_col(t) * as_col(ln_p)
    return size * F.cos(angle), -size * F.sin(angle)


def local_factor(re, im, coef=1.0) -> tuple[Column, Column]:
    """1 / (1 - c z) for z = re + i im."""
    dr, di = 1 - as_col(coef) * re, -as_col(coef) * im
    size = dr * dr + di * di
    return dr / size, -di / size


def quadratic_factor(re, im, p, ap) -> tuple[Column, Column]:
    """1 / (1 - a z + p z^2), the local factor of a curve."""
    dr = 1 - as_col(ap) * re + as_col(p) * (re * re - im * im)
    di = -as_col(ap) * im + as_col(p) * 2 * re * im
    size = dr * dr + di * di
    return dr / size, -di / size


def log_derivative(re, im, ln_p, coef=1.0) -> tuple[Column, Column]:
    """ln p * c z / (1 - c z); 0 where the denominator vanishes."""
    nr, ni = as_col(coef) * re, as_col(coef) * im
    dr, di = 1 - nr, -ni
    size = dr * dr + di * di
    safe = F.when(size > F.lit(TINY), size)
    return (
        F.coalesce(as_col(ln_p) * (nr * dr + ni * di) / safe, F.lit(0.0)),
        F.coalesce(as_col(ln_p) * (ni * dr - nr * di) / safe, F.lit(0.0)),
    )


def quadratic_log_derivative(re, im, p, ln_p, ap) -> tuple[Column, Column]:
    """(a ln p z - 2 p ln p z^2) / (1 - a z + p z^2); 0 where the denominator vanishes."""
    p, ap, ln_p = as_col(p), as_col(ap), as_col(ln_p)
    sr, si = re * re - im * im, 2 * re * im
    nr, ni = ln_p * (ap * re - 2 * p * sr), ln_p * (ap * im - 2 * p * si)
    dr, di = 1 - ap * re + p * sr, -ap * im + p * si
    size = dr * dr + di * di
    safe = F.when(F.sqrt(size) >= F.lit(TINY), size)
    return F.coalesce((nr * dr + ni * di) / safe, F.lit(0.0)), F.coalesce((ni * dr - nr * di) / safe, F.lit(0.0))


def torus_point(size, angle_a, angle_b, big_radius: float = 1.5) -> tuple[Column, Column, Column]:
    ring = F.lit(big_radius) + size * F.cos(angle_a)
    return ring * F.cos(angle_b), ring * F.sin(angle_b), size * F.sin(angle_a)


def compactified(radius) -> Column:
    """r / (1 + r), 0 for a vanishing radius."""
    r = as_col(radius)
    return F.when(r > F.lit(EPS), r / (1 + r)).otherwise(0.0)


def taper(k0, size) -> Column:
    """exp(-pi (k/K)^2) with k counted from 0."""
    x = as_col(k0) / as_col(size)
    return F.exp(F.lit(-math.pi) * x * x)


def valuation2(n) -> Column:
    """Exponent of 2 in a BIGINT; 0 for 0."""
    n = as_col(n).cast("long")
    low = n.bitwiseAND(-n)
    return F.when(n == 0, 0.0).otherwise(F.rint(F.log2(F.abs(low.cast("double")))))


def multiplicative_order(base, modulus, bound) -> Column:
    """Smallest k <= bound with base^k = 1 (mod modulus), else NULL."""
    base, modulus = as_col(base).cast("long"), as_col(modulus).cast("long")
    start = F.struct(F.lit(1).cast("long").alias("power"), F.lit(None).cast("long").alias("found"))

    def step(state, k):
        # products of factors under 3.0e9 fit a BIGINT; larger ones are taken in exact decimals
        wide = ((state["power"].cast("decimal(19,0)") * base.cast("decimal(19,0)")) % modulus.cast("decimal(19,0)")).cast("long")
        power = F.when((modulus < 3_000_000_000) & (F.abs(base) < 3_000_000_000), (state["power"] * base) % modulus).otherwise(wide)
        return F.struct(
            F.when(state["found"].isNull(), power).otherwise(state["power"]).alias("power"),
            F.coalesce(state["found"], F.when(power == 1, k)).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(1).cast("long"), as_col(bound).cast("long")), start, step, lambda s: s["found"])


def embedding_degree(p, order, bound: int = 100) -> Column:
    """Smallest k <= bound with p^k = 1 (mod order); bound when there is none or order <= 1."""
    safe = F.when(as_col(order) > 1, as_col(order))
    return F.coalesce(multiplicative_order(p, safe, F.lit(bound)), F.lit(bound).cast("long"))


def order_ratio(p) -> Column:
    """ord_2(p) / (p - 1), 0 for p = 2."""
    p = as_col(p).cast("long")
    return F.when(p % 2 == 0, 0.0).otherwise(
        F.coalesce(multiplicative_order(F.lit(2), p, p), F.lit(0)).cast("double") / (p - 1)
    )


def gcd(a, b) -> Column:
    """Euclid on BIGINTs; the number of steps follows from the smaller number (at most 4.8 per decimal digit)."""
    a, b = as_col(a).cast("long"), as_col(b).cast("long")
    start = F.struct(a.alias("a"), b.alias("b"))
    digits = F.log10(F.least(F.abs(a), F.abs(b)).cast("double") + 1)
    return F.aggregate(
        F.sequence(F.lit(1), (F.ceil(4.8 * digits) + 2).cast("int")),
        start,
        lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))
        ),
        lambda s: F.abs(s["a"]),
    )


def gauss_kuzmin(k) -> Column:
    """Probability of partial quotient k."""
    k = as_col(k)
    return F.log2(1 + 1.0 / (k * (k + 2)))


def gauss_kuzmin_cdf(k) -> Column:
    """Probability of a partial quotient of at most k."""
    return 1 - F.log2(1 + 1.0 / (as_col(k) + 1))


def decibel(magnitude) -> Column:
    return 20 * F.log10(as_col(magnitude) + F.lit(EPS))


def magnitude(re, im) -> Column:
    return F.sqrt(as_col(re) * as_col(re) + as_col(im) * as_col(im))


def wrapped(angle) -> Column:
    """Angle moved to (-pi, pi]."""
    a = as_col(angle)
    return a - 2 * F.lit(math.pi) * F.ceil((a - F.lit(math.pi)) / F.lit(2 * math.pi))


def near_harmonic(freq, base, tolerance: float = 0.05) -> Column:
    """Is freq within tolerance * base of a multiple of base (half-even rounding)?"""
    freq, base = as_col(freq), as_col(base)
    return F.abs(freq - F.rint(freq / base) * base) < base * tolerance


def discriminant_mod(a, b, p) -> Column:
    """-16 (4 a^3 + 27 b^2) mod p, not negative; operands are reduced first to stay in BIGINT."""
    p = as_col(p).cast("long")
    a, b = F.pmod(as_col(a).cast("long"), p), F.pmod(as_col(b).cast("long"), p)
    cube = (a * a % p) * a % p
    return F.pmod(-16 * (4 * cube + 27 * (b * b % p)), p)
