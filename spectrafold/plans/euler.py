"""Euler product profile of (sigma, t, K) points, trajectories, valley scan and weighted residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spectrafold.functions import scalar, stats
from spectrafold.functions.fixed import EPS
from spectrafold.functions.scalar import prime_power, quadratic_log_derivative
from spectrafold.operators.blocks import halo_window, in_parts
from spectrafold.operators.euler import envelope, point_terms
from spectrafold.operators.ranks import guarded_corr, quantiles, tied_rank
from spectrafold.plans.curves import curve_orders
from spectrafold.session import saved, share_package

FEATURES = (
    "sigma t K torus_radius torus_xy torus_z torus_z_xy_ratio V grad_sigma grad_t grad_mag laplacian harmonicity weil_lambda_min "
    "weil_lambda_2 weil_gap weil_lambda_max weil_trace fb_mean fb_max fb_decay phase_cos phase_sin phase_coherence poincare_r "
    "poincare_gap ortho_AB ortho_AC ortho_BC euler_arg euler_darg_dt"
).split()
STEP, ARG_STEP = 0.003, 0.01
#: Points whose terms, some tens each, one task sorts and adds up.
POINTS_A_TASK = 8_192


#: The coefficient table of L-functions: a row per function and prime, a gap ends the function's terms.
COEFFICIENTS = "lfunc string, degree int, modulus int, p long, coef double"


def constant_coefficients(primes: DataFrame, lfunc: str = "zeta") -> DataFrame:
    """COEFFICIENTS of the function whose coefficients are all 1."""
    return primes.select(F.lit(lfunc).alias("lfunc"), F.lit(1).alias("degree"), F.lit(None).cast("int").alias("modulus"), "p", F.lit(1.0).alias("coef"))


def character_rows(primes: DataFrame, values: DataFrame) -> DataFrame:
    """COEFFICIENTS of characters given as values (lfunc, modulus, residue, coef); residues not listed give 0.

    A character's values are one map, so a prime looks its residue up inside the row.
    """
    listed = values.groupBy("lfunc", "modulus").agg(F.map_from_entries(F.collect_list(F.struct(F.col("residue").cast("long"), "coef"))).alias("_of"))
    rows = _every_prime(listed, primes)
    coef = F.coalesce(F.try_element_at("_of", F.col("p") % F.col("modulus")), F.lit(0.0))
    return rows.select("lfunc", F.lit(1).alias("degree"), F.col("modulus").cast("int").alias("modulus"), "p", coef.alias("coef"))


def curve_rows(primes: DataFrame, curves: DataFrame) -> DataFrame:
    """COEFFICIENTS p + 1 - n_points of curves (lfunc, a, b), counted over every prime; 0 where the curve is singular, and at 2 and 3."""
    rows = _every_prime(curves.select("lfunc", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), primes)
    counted = curve_orders(rows.select(F.pmod("a", "p").alias("a"), F.pmod("b", "p").alias("b"), "p"))
    counted = counted.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("p").alias("_p"), "n_points")
    same = (F.pmod("a", "p") == F.col("_a")) & (F.pmod("b", "p") == F.col("_b")) & (F.col("p") == F.col("_p"))
    bad = (F.col("p") <= 3) | (scalar.discriminant_mod("a", "b", "p") == 0)
    coef = F.when(bad, 0.0).otherwise((F.col("p") + 1 - F.col("n_points")).cast("double"))
    return rows.join(counted, same).select("lfunc", F.lit(2).alias("degree"), F.lit(None).cast("int").alias("modulus"), "p", coef.alias("coef"))


def _every_prime(functions: DataFrame, primes: DataFrame) -> DataFrame:
    """Every function once per prime; the primes, fixed by their limit, travel as one array."""
    listed = primes.groupBy(F.lit(0).alias("_one")).agg(F.collect_list("p").alias("_primes"))
    return functions.withColumn("_one", F.lit(0)).join(F.broadcast(listed), "_one").withColumn("p", F.explode("_primes")).drop("_one", "_primes")


def coefficient_table(coefficients: DataFrame, primes: DataFrame) -> DataFrame:
    """COEFFICIENTS with k, ln_p, the next prime's logarithm (NULL at the last) and the arithmetic channel; new functions are new rows.

    The channel is (2-adic depth of p - 1, relative order of 2) without a modulus, (coef, p mod modulus) with one, and
    (coef, coef / 2 sqrt p) in degree 2.
    """
    following = primes.select((F.col("k") - 1).alias("k"), F.col("ln_p").alias("ln_next"))
    rows = coefficients.join(F.broadcast(primes.join(following, "k", "left")), "p")
    plain = F.col("modulus").isNull() & (F.col("degree") == 1)
    second = F.when(F.col("degree") == 2, F.col("coef") / (2 * F.sqrt(F.col("p").cast("double"))))
    second = second.when(plain, scalar.order_ratio("p")).otherwise((F.col("p") % F.col("modulus")).cast("double"))
    first = F.when(plain, scalar.valuation2(F.col("p") - 1)).otherwise(F.col("coef"))
    return rows.select("lfunc", "degree", "k", "p", "ln_p", "ln_next", "coef", first.alias("channel_1"), second.alias("channel_2"))


def _square() -> Column:
    """The coefficient of z^2 in a local factor 1 - c z + q z^2: p in degree 2, none in degree 1."""
    return F.when(F.col("degree") == 2, F.col("p").cast("double")).otherwise(0.0)


def zeta_table(primes: DataFrame) -> DataFrame:
    """The coefficient table of zeta alone."""
    return coefficient_table(constant_coefficients(primes), primes)


def channel_ranks(table: DataFrame, k_limit: int) -> DataFrame:
    """Ranks of the arithmetic channel among the first K primes, for every function and K.

    They depend on function and K only, so they are worked out once (at most k_limit^2 / 2 rows a function), not per point.
    """
    spread = table.where(F.col("k") <= k_limit).withColumn("kmax", F.explode(F.sequence(F.col("k"), F.lit(k_limit))))
    return spread.select("lfunc", "kmax", "k", *[tied_rank(["lfunc", "kmax"], f"channel_{i}").alias(f"_ra{i}") for i in (1, 2)])


def channel_sizes(ranked: DataFrame) -> DataFrame:
    """(lfunc, kmax, ortho_AB): correlation of the channel with size."""
    largest = F.greatest(*[F.abs(guarded_corr(f"_ra{i}", F.col("k").cast("double"))) for i in (1, 2)])
    return ranked.groupBy("lfunc", "kmax").agg(largest.alias("ortho_AB"))


def euler_atlas(points: DataFrame, table: DataFrame, k_limit: int) -> DataFrame:
    """lfunc_atlas for points without lfunc, on the table of a single function."""
    one = F.lit("one").alias("lfunc")
    return lfunc_atlas(points.select(one, "*"), table.select(one, *[c for c in table.columns if c != "lfunc"]), k_limit).drop("lfunc")


def lfunc_atlas(points: DataFrame, table: DataFrame, k_limit: int) -> DataFrame:
    """One row per (lfunc, point_id) of points (lfunc, point_id, sigma, t, kmax): 31 features, mu1 and mu2 of the interaction matrix.

    All functions are worked on in one job: their terms are joined by (lfunc, k), and the ten evaluations of the potential
    and three of the phase are sums in one aggregation over points x primes. The lookup table is written first, so that
    Spark decides by its size, which grows with the number of functions, whether to broadcast it. Points are dealt before
    they are expanded, so their terms stay where they are and a task has a bounded number of them.
    """
    table = table.where("ln_next IS NOT NULL")
    ranked = channel_ranks(table, k_limit)
    lookup = saved(table.join(ranked, ["lfunc", "k"]).join(channel_sizes(ranked), ["lfunc", "kmax"]))
    points = in_parts(points.select("lfunc", "point_id", "sigma", "t", "kmax"), ["point_id"], POINTS_A_TASK)
    rows = points.select("*", F.explode(F.sequence(F.lit(1), F.col("kmax"))).alias("k"))
    rows = rows.join(lookup, ["lfunc", "kmax", "k"], "left")
    # a point beyond its function's terms would lose some; it stops the job instead of going missing
    short = F.raise_error(F.format_string("%s: kmax %d is above the table's terms", F.col("lfunc"), F.col("kmax"))).cast("double")
    rows = rows.withColumn("ln_p", F.coalesce("ln_p", short))
    terms = envelope(rows, ["lfunc", "point_id"]).withColumn("_square", _square())
    phase = F.col("t") * F.col("ln_p")
    terms = terms.withColumns({"_cos": F.cos(phase), "_sin": F.sin(phase)})
    terms = terms.withColumns({"_rc": tied_rank(["lfunc", "point_id"], "_cos"), "_rs": tied_rank(["lfunc", "point_id"], "_sin")})
    aggregates: list[Column] = []
    for name, ds, dt in (("c", 0, 0), ("sp", STEP, 0), ("sm", -STEP, 0), ("tp", 0, STEP), ("tm", 0, -STEP)):
        re, im = prime_power("p", "ln_p", F.col("sigma") + F.lit(float(ds)), F.col("t") + F.lit(float(dt)))
        for part, value in zip("ri", quadratic_log_derivative(re, im, "_square", "ln_p", "coef")):
            aggregates.append(F.sum(value).alias(f"_{part}_{name}"))
    taper = scalar.taper(F.col("k") - 1, "kmax")
    for name, dt in (("0", 0.0), ("p", ARG_STEP), ("m", -ARG_STEP)):
        re, im = prime_power("p", "ln_p", "sigma", F.col("t") + F.lit(dt))
        aggregates.append(F.sum(taper * F.atan2(-im, 1 - re)).alias(f"_arg_{name}"))
    radius = F.exp(-F.col("sigma") * F.col("ln_p"))
    weight = radius * F.exp(-F.col("sigma") * F.col("ln_next"))
    x, y, z = scalar.torus_point(radius, phase, F.col("t") * F.col("ln_next"))
    strength = F.sqrt("ln_p") * F.exp(-0.25 * F.col("ln_p"))
    u, v = strength * F.col("_cos"), strength * F.col("_sin")
    rho = lambda a, b: F.abs(guarded_corr(a, b))
    flat_c, flat_s = F.stddev_pop("_cos") < 1e-10, F.stddev_pop("_sin") < 1e-10
    against = lambda a: F.greatest(F.when(flat_c, 0.0).otherwise(rho(a, "_rc")), F.when(flat_s, 0.0).otherwise(rho(a, "_rs")))
    aggregates += [
        F.sum(weight).alias("_w"), F.sum(weight * x).alias("_x"), F.sum(weight * y).alias("_y"), F.sum(weight * z).alias("_z"),
        F.sum(u * u).alias("_uu"), F.sum(u * v).alias("_uv"), F.sum(v * v).alias("_vv"),
        F.avg("fb").alias("fb_mean"), F.max("fb").alias("fb_max"),
        stats.slope(F.ln(F.col("fb") + F.lit(EPS)), F.ln(F.col("k").cast("double"))).alias("fb_decay"),
        F.avg("_cos").alias("phase_cos"), F.avg("_sin").alias("phase_sin"),
        F.greatest(against("_ra1"), against("_ra2")).alias("ortho_AC"), against(F.col("k").cast("double")).alias("ortho_BC"),
    ]
    sums = terms.groupBy("lfunc", "point_id", "sigma", "t", "kmax", "ortho_AB").agg(*aggregates)
    return _atlas_features(sums)


def _atlas_features(sums: DataFrame) -> DataFrame:
    c = F.col
    level = lambda n: -F.ln(scalar.magnitude(f"_r_{n}", f"_i_{n}") + F.lit(1e-300))
    table = sums.withColumns({f"_v_{n}": level(n) for n in ("c", "sp", "sm", "tp", "tm")})
    px, py, pz = (c(a) / c("_w") for a in ("_x", "_y", "_z"))
    trace, half = c("_uu") + c("_vv"), F.sqrt((c("_uu") - c("_vv")) ** 2 + 4 * c("_uv") ** 2)
    table = table.withColumns({
        "K": c("kmax").cast("double"), "torus_xy": F.sqrt(px * px + py * py), "torus_z": F.abs(pz),
        "torus_radius": F.sqrt(px * px + py * py + pz * pz), "V": c("_v_c"),
        "grad_sigma": (c("_v_sp") - c("_v_sm")) / (2 * STEP), "grad_t": (c("_v_tp") - c("_v_tm")) / (2 * STEP),
        "laplacian": (c("_v_sp") - 2 * c("_v_c") + c("_v_sm")) / STEP**2 + (c("_v_tp") - 2 * c("_v_c") + c("_v_tm")) / STEP**2,
        "mu1": (trace + half) / 2, "mu2": F.greatest((trace - half) / 2, F.lit(0.0)),
        "phase_coherence": F.sqrt(c("phase_cos") ** 2 + c("phase_sin") ** 2),
        "euler_arg": c("_arg_0"), "euler_darg_dt": (c("_arg_p") - c("_arg_m")) / (2 * ARG_STEP),
    })
    k, mu1, mu2 = c("kmax"), c("mu1"), c("mu2")
    # the matrix has rank two: of its eigenvalues in ascending order the first K - 2 are exactly zero
    first = F.when(k > 2, 0.0).when(k == 2, mu2).otherwise(mu1)
    second = F.when(k > 3, 0.0).when(k == 3, mu2).when(k == 2, mu1)
    table = table.withColumns({
        "torus_z_xy_ratio": c("torus_z") / (c("torus_xy") + F.lit(EPS)), "grad_mag": F.sqrt(c("grad_sigma") ** 2 + c("grad_t") ** 2),
        "harmonicity": F.abs("laplacian") / (F.abs("V") + F.lit(EPS)), "weil_lambda_min": first, "weil_lambda_2": second,
        "weil_gap": second - first, "weil_lambda_max": F.when(k >= 7, 0.0).when(k == 6, mu2).otherwise(mu1),
        "weil_trace": F.when(k >= 7, 0.0).when(k == 6, mu2).when(k == 1, mu1).otherwise(mu1 + mu2),
        "poincare_r": scalar.compactified("torus_radius"), "poincare_gap": 1 - scalar.compactified("torus_radius"),
    })
    return table.select("lfunc", "point_id", *FEATURES, "mu1", "mu2")


SCALE_FEATURES = ("drift_rate", "spiral_alpha", "coherence_N", "drift_x", "drift_y", "drift_z", "final_dev_mag", "median_cos")


def trajectory_scales(points: DataFrame, primes: DataFrame, window: int = 50, prime_count: int = 239) -> DataFrame:
    """Drift, spiral and coherence of the torus trajectory over N = 2..min(4 K, 500, #primes - 2).

    Prefix sums along the primes give every embedding of one point at once; a trajectory has 500 steps at most.
    """
    limit = F.least(F.col("kmax") * 4, F.lit(500), F.lit(prime_count - 2))
    following = primes.select((F.col("k") - 1).alias("k"), F.col("ln_p").alias("ln_next"))
    points = in_parts(points.withColumn("kmax", limit), ["point_id"], POINTS_A_TASK)
    terms = point_terms(points, primes.join(following, "k"))
    radius = F.exp(-F.col("sigma") * F.col("ln_p"))
    weight = radius * F.exp(-F.col("sigma") * F.col("ln_next"))
    coords = scalar.torus_point(radius, F.col("t") * F.col("ln_p"), F.col("t") * F.col("ln_next"))
    by_point = W.partitionBy("point_id").orderBy("k")
    upto = by_point.rowsBetween(W.unboundedPreceding, 0)
    terms = terms.select("point_id", "k", "kmax", weight.alias("w"), *[(weight * c).alias(a) for a, c in zip("xyz", coords)])
    path = terms.select("point_id", "k", "kmax", *[(F.sum(a).over(upto) / F.sum("w").over(upto)).alias(a) for a in "xyz"]).where("k >= 2")
    back = by_point.rowsBetween(-window, -1)
    full = F.col("k") >= window + 2
    path = path.select(
        "*", *[F.when(full, F.avg(a).over(back)).alias(f"c{a}") for a in "xyz"],
        *[(F.col(a) - F.lag(a).over(by_point)).alias(f"s{a}") for a in "xyz"],
    )
    length = lambda parts: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    dot = sum((F.col(f"s{a}") * F.lag(f"s{a}").over(by_point) for a in "yz"), F.col("sx") * F.lag("sx").over(by_point))
    path = path.withColumn("_step", length([F.col(f"s{a}") for a in "xyz"])).select(
        "*", F.lag("_step").over(by_point).alias("_before"), dot.alias("_dot"),
        length([F.col(f"c{a}") - F.lag(f"c{a}").over(by_point) for a in "xyz"]).alias("_drift"),
        length([F.col(a) - F.col(f"c{a}") for a in "xyz"]).alias("_dev"),
    )
    valid = (F.col("_step") > F.lit(EPS)) & (F.col("_before") > F.lit(EPS))
    cosine = F.when(valid, F.least(F.greatest(F.col("_dot") / (F.col("_step") * F.col("_before")), F.lit(-1.0)), F.lit(1.0)))
    path = path.withColumn("_cos", cosine)
    angles = path.where("_cos IS NOT NULL").withColumn("_i", F.row_number().over(by_point) - 1)
    last_ten = F.array_sort(F.collect_list("_cos").over(by_point.rowsBetween(-10, -1)))
    angles = angles.select("point_id", "_i", "_cos", ((F.get(last_ten, F.lit(4)) + F.get(last_ten, F.lit(5))) / 2).alias("_m10"))
    count = angles.groupBy("point_id").agg(F.count("*").alias("_nc"))
    angles = angles.join(count, "point_id")
    coherent = angles.groupBy("point_id").agg(
        F.coalesce(F.min(F.when((F.col("_i") >= 10) & (F.col("_m10") > 0.9), F.col("_i") + 2)), F.max("_nc")).cast("double").alias("coherence_N"),
        F.when(F.max("_nc") > 50, F.percentile(F.when(F.col("_i") >= F.col("_nc") - 50, F.col("_cos")), 0.5)).alias("median_cos"),
    )
    log_dev = F.when(F.col("_dev") > 1e-10, F.ln("_dev"))
    ends = [(F.max_by(f"c{a}", "k") - F.min_by(f"c{a}", F.when(full, F.col("k")))).alias(f"drift_{a}") for a in "xyz"]
    table = path.groupBy("point_id").agg(
        F.percentile("_drift", 0.5).alias("drift_rate"),
        F.when(F.count(log_dev) > 10, stats.slope(log_dev, F.ln(F.col("k").cast("double")))).alias("spiral_alpha"), *ends,
        F.max_by("_dev", "k").alias("final_dev_mag"), F.count("*").alias("_n"),
    )
    table = table.join(coherent, "point_id", "left")
    enough = (F.col("_n") >= 60) & (F.col("_n") - window >= 20)
    return table.select("point_id", *[F.when(enough, F.col(f)).alias(f) for f in SCALE_FEATURES], enough.alias("scales_valid"))


#: Up to these t the alternating sums are used: plain ones for the scan, accelerated ones for refinement.
PLAIN_UP_TO, SERIES_UP_TO = 80.0, 200.0
WEIGHTS = 256


def _main_sum(t: np.ndarray) -> np.ndarray:
    """Z(t), the size of zeta on the critical line up to sign: floor(sqrt(t / 2 pi)) terms and two corrections.

    The error is of the order of 0.01 (t / 2 pi)^(-5/4).
    """
    a = np.sqrt(t / (2 * math.pi))
    count = np.floor(a)
    theta = t * np.log(a) - t / 2 - math.pi / 8 + 1 / (48 * t) + 7 / (5760 * t * t * t)
    terms = np.zeros_like(t)
    for n in range(1, int(np.nanmax(count, initial=0)) + 1):
        terms += np.where(n <= count, np.cos(theta - t * math.log(n)) / math.sqrt(n), 0.0)
    part, h = a - count, 0.01

    def psi(p: np.ndarray) -> np.ndarray:
        arch, below = 2 * math.pi * (p * p - p - 1 / 16), np.cos(2 * math.pi * p)
        # at a zero of the denominator, the quotient of the derivatives
        return np.where(np.abs(below) < 1e-6, np.sin(arch) * (2 * p - 1) / np.sin(2 * math.pi * p), np.cos(arch) / below)

    bend = (psi(part + 2 * h) - 2 * psi(part + h) + 2 * psi(part - h) - psi(part - 2 * h)) / (2 * h**3)
    rest = (psi(part) - bend / (96 * math.pi**2 * a)) / np.sqrt(a)
    return 2 * terms + np.where(count % 2 == 1, rest, -rest)


def _eta_of_main_sum(t: np.ndarray) -> np.ndarray:
    """|eta| = |1 - 2^(1-s)| |zeta| on the critical line."""
    return np.sqrt(3 - 2 * math.sqrt(2) * np.cos(t * math.log(2))) * np.abs(_main_sum(t))


def _alternating(t: np.ndarray, weights: list[float]) -> np.ndarray:
    """|sum over n of weights[n - 1] (-1)^(n+1) n^-(1/2 + i t)|."""
    re, im = np.zeros_like(t), np.zeros_like(t)
    for n, weight in enumerate(weights, 1):
        size = weight * (1.0 if n % 2 == 1 else -1.0) * math.exp(-0.5 * math.log(n))
        re += size * np.cos(t * math.log(n))
        im += size * np.sin(t * math.log(n))
    return np.sqrt(re * re + im * im)


def _by_range(t: np.ndarray, low: np.ndarray, weights: list[float]) -> np.ndarray:
    """|eta|: the alternating sum where ``low`` holds, the main sum elsewhere; rows of a batch are added up term by term."""
    eta = np.empty_like(t)
    with np.errstate(all="ignore"):
        eta[low], eta[~low] = _alternating(t[low], weights), _eta_of_main_sum(t[~low])
    return eta


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all partitions, for work in Python: a row is heavy beside its size, by which files are cut and partitions merged."""
    share_package(df.sparkSession)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def eta_scan(grid: DataFrame, terms: int = 80) -> DataFrame:
    """Add |eta(1/2 + i t)| to a grid with column t and a unique key pos: the plain sum of ``terms`` terms up to t = 80,
    sqrt(t / 2 pi) terms of the main sum above."""
    weights, dealt = [1.0] * terms, _dealt(grid.select("pos", "t"), "pos")

    @F.pandas_udf("double")
    def eta(t: pd.Series) -> pd.Series:
        t = t.to_numpy("float64", na_value=np.nan)
        return pd.Series(_by_range(t, t <= PLAIN_UP_TO, weights))

    return dealt.select("pos", "t", eta(F.col("t").cast("double")).alias("eta"))


def valley_scan(grid: DataFrame, lfunc: str = "zeta", terms: int = 80) -> DataFrame:
    """(pos, t, eta): local minima below the 10 % quantile on a grid (pos dense, t ascending).

    The quantile of a large grid is found by distributed ranking, and neighbours come from blocks of the grid.
    """
    if lfunc != "zeta":
        raise NotImplementedError("the scan is defined for zeta only")
    values = saved(eta_scan(grid, terms)).withColumn("_all", F.lit(0))
    threshold = quantiles(values, ["_all"], "eta", {"_q": 0.1})
    rows = halo_window(values, ["_all"], "pos", lambda w: {"_a": F.lag("eta").over(w), "_b": F.lead("eta").over(w)}, block=8192)
    low = rows.where((F.col("eta") < F.col("_a")) & (F.col("eta") < F.col("_b")))
    return low.join(F.broadcast(threshold), "_all").where("eta < _q").select("pos", "t", "eta")


def acceleration_weights(n: int = WEIGHTS) -> list[float]:
    """Weights of the accelerated alternating series: 1 - d_k / d_n, from exact whole parts of d_n."""
    parts = [1]
    for i in range(n):
        parts.append(parts[-1] * 4 * (n + i) * (n - i) // ((2 * i + 1) * (2 * i + 2)))
    total, running, out = sum(parts), 0, []
    for part in parts[:-1]:
        running += part
        out.append((total - running) / total)
    return out


def valley_refine(candidates: DataFrame, rounds: int = 6, radius: float = 0.1, accept: float = 1e-3) -> DataFrame:
    """(pos, gamma, residual, accepted): every candidate narrowed by nested grids of 21 points.

    ``accepted`` says that the residual is below ``accept``. Up to t = 200 the residual is that of the series of 256 terms,
    accelerated by a fixed list of weights, above that of the main sum. Candidates are dealt over all partitions and refined in batches.
    """
    weights, steps = acceleration_weights(), np.arange(-10, 11)

    def narrowed(batches):
        for rows in batches:
            t = rows["t"].to_numpy("float64", na_value=np.nan)
            gamma, low = t, np.repeat((t <= SERIES_UP_TO)[:, None], len(steps), axis=1)
            residual = np.full(len(t), np.inf)
            for step in range(rounds):
                spots = gamma[:, None] + steps * (radius / 10 ** (step + 1))
                values = _by_range(spots, low, weights)
                best = np.where(np.isnan(values), np.inf, values).argmin(axis=1)[:, None]
                gamma, residual = np.take_along_axis(spots, best, 1)[:, 0], np.take_along_axis(values, best, 1)[:, 0]
            yield pd.DataFrame({"pos": rows["pos"], "gamma": gamma, "residual": residual})

    kind = candidates.schema["pos"].dataType.simpleString()
    found = _dealt(candidates.select("pos", F.col("t").cast("double").alias("t")), "pos").mapInPandas(narrowed, f"pos {kind}, gamma double, residual double")
    return found.select("pos", "gamma", "residual", (F.col("residual") < accept).alias("accepted"))


def weighted_residual(weights: DataFrame, primes: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, sigma, t, residual, squared) of sum theta_k ln p_k z / (1 - z) for every run and target."""
    table = coefficient_table(constant_coefficients(primes, "one"), primes)
    return lfunc_residual(weights.select(F.lit("one").alias("lfunc"), "*"), table, targets).drop("lfunc")


def lfunc_residual(weights: DataFrame, table: DataFrame, targets: DataFrame) -> DataFrame:
    """(lfunc, run_id, sigma, t, residual, squared): the weighted sum of each function's logarithmic derivatives over weights
    (lfunc, run_id, k, theta), for every run and target.

    Targets (a fixed short list) are broadcast; runs times primes are summed with partial aggregation.
    """
    terms = weights.join(table.select("lfunc", "k", "p", "ln_p", "coef", "degree"), ["lfunc", "k"])
    listed = targets.groupBy(F.lit(0).alias("_one")).agg(F.collect_list(F.struct("sigma", "t")).alias("_targets"))
    terms = terms.withColumn("_one", F.lit(0)).join(F.broadcast(listed), "_one").withColumn("_t", F.explode("_targets"))
    terms = terms.select("lfunc", "run_id", "theta", "p", "ln_p", "coef", "degree", "_t.sigma", "_t.t")
    re, im = prime_power("p", "ln_p", "sigma", "t")
    dr, di = quadratic_log_derivative(re, im, _square(), "ln_p", "coef")
    sums = terms.groupBy("lfunc", "run_id", "sigma", "t").agg(F.sum(F.col("theta") * dr).alias("a"), F.sum(F.col("theta") * di).alias("b"))
    squared = F.col("a") ** 2 + F.col("b") ** 2
    return sums.select("lfunc", "run_id", "sigma", "t", F.sqrt(squared).alias("residual"), squared.alias("squared"))


def weight_screen(weights: DataFrame, table: DataFrame) -> DataFrame:
    """(run_id, feature, rho, t_stat, signal): rank correlation of theta with seven prime features.

    The p-value rule is taken as |t| beyond its two-sided 1 % point for large samples together with |rho| > 0.3.
    """
    ln_p, k = F.col("ln_p"), F.col("k").cast("double")
    features = {
        "ln_p": ln_p, "p_half": F.exp(-0.5 * ln_p), "inverse_k": 1 / k, "v2": F.col("channel_1"), "order_ratio": F.col("channel_2"),
        "ln_p_squared": ln_p**2, "inverse_p": F.exp(-ln_p),
    }
    rows = weights.join(F.broadcast(table), "k").select("run_id", "theta", *[c.alias(n) for n, c in features.items()])
    rows = rows.withColumn("_rt", tied_rank(["run_id"], "theta"))
    rows = rows.select("run_id", "_rt", *[tied_rank(["run_id"], n).alias(n) for n in features])
    long = rows.groupBy("run_id").agg(F.count("*").alias("n"), *[guarded_corr("_rt", n).alias(n) for n in features])
    long = long.unpivot(["run_id", "n"], list(features), "feature", "rho")
    t_stat = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(EPS)))
    signal = F.when((F.abs(t_stat) > 2.576) & (F.abs("rho") > 0.3), "YES").when(F.abs(t_stat) > 1.96, "weak").otherwise("NO")
    return long.select("run_id", "feature", "rho", t_stat.alias("t_stat"), signal.alias("signal"))


def weight_decay(weights: DataFrame, primes: DataFrame) -> DataFrame:
    """(run_id, alpha, beta): exponents of |theta| against k and p, for runs with more than five usable weights."""
    rows = weights.join(F.broadcast(primes), "k").where(F.abs("theta") > 1e-6)
    log_t = F.ln(F.abs("theta"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"), stats.slope(log_t, F.ln(F.col("k").cast("double"))).alias("alpha"), stats.slope(log_t, "ln_p").alias("beta")
    ).where("n > 5").drop("n")


def weight_similarity(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, r, angle, kind) for requested pairs of runs."""
    left = weights.select(F.col("run_id").alias("a"), "k", F.col("theta").alias("x"))
    right = weights.select(F.col("run_id").alias("b"), "k", F.col("theta").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, ["b", "k"])
    dot = F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("y") ** 2)) + F.lit(EPS))
    table = rows.groupBy("a", "b").agg(stats.pearson("x", "y").alias("r"), F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))).alias("angle"))
    kind = F.when(F.abs("r") > 0.7, "UNIVERSAL").when(F.abs("r") < 0.3, "ZERO-SPECIFIC").otherwise("PARTIAL")
    return table.withColumn("kind", kind)


