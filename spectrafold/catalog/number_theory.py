"""Euler products, continued fractions, curves and weights."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import POINTS, RATIONALS, SERIES, primes, with_
from spectrafold.functions.fixed import ZETA_ZEROS
from spectrafold.operators import curvegroups, fits, quotients
from spectrafold.operators.blocks import consecutive_pairs
from spectrafold.plans import curves, euler, quotient
from spectrafold.sources import driver, tables as t

ORD2 = """ord(p, k, power) AS (SELECT p, 1, CAST(2 % p AS BIGINT) FROM primes WHERE p > 2 AND k <= 40 UNION ALL SELECT p, k + 1, power * 2 % p FROM ord WHERE power <> 1),
  ordr AS (SELECT p, max(k) / CAST(p - 1 AS DOUBLE) AS r FROM ord GROUP BY p)"""
#: The coefficient table of zeta, and of three L-functions at once.
ZETA_CHANNELS = """tab AS (SELECT 'zeta' AS lfunc, 1 AS degree, k, primes.p, ln_p, 1.0::DOUBLE AS coef, CASE WHEN primes.p = 2 THEN 0.0::DOUBLE ELSE round(log2((primes.p - 1) & -(primes.p - 1))) END AS c1,
    coalesce(r, 0) AS c2, lead(ln_p) OVER (ORDER BY k) AS ln_n FROM primes LEFT JOIN ordr ON ordr.p = primes.p WHERE k <= 40)"""
CHI_CHANNELS = """tab AS (SELECT 'chi4' AS lfunc, 1 AS degree, k, p, ln_p, CASE p % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS coef,
    CASE p % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1, CAST(p % 4 AS DOUBLE) AS c2, lead(ln_p) OVER (ORDER BY k) AS ln_n FROM primes WHERE k <= 40)"""
CURVE_CHANNELS = """hits AS (SELECT k, count(*) FILTER (y * y % p = (x * x * x - x + 1 + p) % p) AS n FROM primes, (SELECT unnest(range(174)) AS x) u, (SELECT unnest(range(174)) AS y) v WHERE k <= 40 AND x < p AND y < p GROUP BY 1),
  tab AS (SELECT 'curve' AS lfunc, 2 AS degree, k, p, ln_p, CASE WHEN p IN (2, 3, 23) THEN 0.0::DOUBLE ELSE CAST(p - n AS DOUBLE) END AS coef,
    CASE WHEN p IN (2, 3, 23) THEN 0.0::DOUBLE ELSE CAST(p - n AS DOUBLE) END AS c1, CASE WHEN p IN (2, 3, 23) THEN 0.0::DOUBLE ELSE (p - n) / (2 * sqrt(p)) END AS c2, lead(ln_p) OVER (ORDER BY k) AS ln_n FROM primes JOIN hits USING (k))"""
ALL_CHANNELS = ", ".join(c.replace("tab AS", f"tab_{n} AS") for n, c in enumerate((ZETA_CHANNELS, CHI_CHANNELS, CURVE_CHANNELS))) + """,
  tab AS (SELECT * FROM tab_0 UNION ALL SELECT * FROM tab_1 UNION ALL SELECT * FROM tab_2)"""


def _deriv(part, s, t_):
    zr, zi = f"(exp(-({s}) * ln_p) * cos(({t_}) * ln_p))", f"(-exp(-({s}) * ln_p) * sin(({t_}) * ln_p))"
    # numerator over denominator: c z / (1 - c z), in degree 2 (c z - 2 p z^2) / (1 - c z + p z^2)
    two = "CASE degree WHEN 2 THEN p ELSE 0 END"
    sr, si = f"({zr} * {zr} - {zi} * {zi})", f"(2 * {zr} * {zi})"
    nr, ni = f"(coef * {zr} - 2 * {two} * {sr})", f"(coef * {zi} - 2 * {two} * {si})"
    dr, di = f"(1 - coef * {zr} + {two} * {sr})", f"({two} * {si} - coef * {zi})"
    top = f"({nr} * {dr} + {ni} * {di})" if part == "re" else f"({ni} * {dr} - {nr} * {di})"
    return f"sum(ln_p * {top} / ({dr} ^ 2 + {di} ^ 2))"


def _atlas_sql(channels, points=POINTS, key="* EXCLUDE (lfunc)"):
    v = lambda n, s, t_: f"-ln(sqrt({_deriv('re', s, t_)} ^ 2 + {_deriv('im', s, t_)} ^ 2) + 1e-300) AS v_{n}"
    arg = lambda n, t_: f"sum(tap * atan2(exp(-sigma * ln_p) * sin(({t_}) * ln_p), 1 - exp(-sigma * ln_p) * cos(({t_}) * ln_p))) AS arg_{n}"
    rank = lambda e, part: f"rank() OVER (PARTITION BY {part} ORDER BY {e}) + (count(*) OVER (PARTITION BY {part}, {e}) - 1) / 2.0::DOUBLE"
    guarded = lambda a, b: f"CASE WHEN stddev_pop({a}) <= 1e-10 OR stddev_pop({b}) <= 1e-10 THEN 0 ELSE abs(corr({a}, {b})) END"
    return with_(primes(1500), ORD2, channels, points, f"""kk AS (SELECT unnest(range(1, 41)) AS kmax),
  ra AS (SELECT lfunc, kmax, k, {rank('c1', 'lfunc, kmax')} AS ra1, {rank('c2', 'lfunc, kmax')} AS ra2 FROM tab JOIN kk ON k <= kmax),
  ab AS (SELECT lfunc, kmax, greatest({guarded('ra1', 'k')}, {guarded('ra2', 'k')}) AS ortho_AB FROM ra GROUP BY 1, 2),
  tm0 AS (SELECT lfunc, degree, point_id, sigma, t, kmax, k, p, ln_p, ln_n, coef, ra1, ra2, cos(t * ln_p) AS c, sin(t * ln_p) AS s, exp(-pi() * ((k - 1) / CAST(kmax AS DOUBLE)) ^ 2) AS tap,
      exp(-sigma * ln_p) / sum(exp(-sigma * ln_p)) OVER (PARTITION BY lfunc, point_id ORDER BY k) AS b FROM points JOIN tab ON k <= kmax JOIN ra USING (lfunc, kmax, k)),
  tm AS (SELECT *, {rank('c', 'lfunc, point_id')} AS rc, {rank('s', 'lfunc, point_id')} AS rs, b / (1 + b) AS fb, exp(-sigma * (ln_p + ln_n)) AS w, exp(-sigma * ln_p) AS r, sqrt(ln_p) * exp(-0.25 * ln_p) AS st FROM tm0),
  ag AS (SELECT lfunc, point_id, sigma, t, kmax, {v('c', 'sigma', 't')}, {v('sp', 'sigma + 0.003', 't')}, {v('sm', 'sigma - 0.003', 't')}, {v('tp', 'sigma', 't + 0.003')}, {v('tm', 'sigma', 't - 0.003')},
      {arg('0', 't')}, {arg('p', 't + 0.01')}, {arg('m', 't - 0.01')}, sum(w * (1.5 + r * c) * cos(t * ln_n)) / sum(w) AS x, sum(w * (1.5 + r * c) * sin(t * ln_n)) / sum(w) AS y, sum(w * r * s) / sum(w) AS z,
      sum((st * c) ^ 2) AS uu, sum(st * st * s * c) AS uv, sum((st * s) ^ 2) AS vv, avg(fb) AS fb_mean, max(fb) AS fb_max, regr_slope(ln(fb + 1e-15), ln(k)) AS fb_decay, avg(c) AS phase_cos, avg(s) AS phase_sin,
      greatest({guarded('ra1', 'rc')}, {guarded('ra1', 'rs')}, {guarded('ra2', 'rc')}, {guarded('ra2', 'rs')}) AS ortho_AC, greatest({guarded('k', 'rc')}, {guarded('k', 'rs')}) AS ortho_BC FROM tm GROUP BY 1, 2, 3, 4, 5),
  f AS (SELECT lfunc, point_id, sigma, t, CAST(kmax AS DOUBLE) AS K, sqrt(x * x + y * y + z * z) AS torus_radius, sqrt(x * x + y * y) AS torus_xy, abs(z) AS torus_z, abs(z) / (sqrt(x * x + y * y) + 1e-15) AS torus_z_xy_ratio,
      v_c AS V, (v_sp - v_sm) / 0.006 AS grad_sigma, (v_tp - v_tm) / 0.006 AS grad_t, sqrt(((v_sp - v_sm) / 0.006) ^ 2 + ((v_tp - v_tm) / 0.006) ^ 2) AS grad_mag,
      (v_sp - 2 * v_c + v_sm) / 9e-6 + (v_tp - 2 * v_c + v_tm) / 9e-6 AS laplacian, 0.0 AS weil_lambda_min, 0.0 AS weil_lambda_2, 0.0 AS weil_gap, 0.0 AS weil_lambda_max, 0.0 AS weil_trace, fb_mean, fb_max, fb_decay,
      phase_cos, phase_sin, sqrt(phase_cos ^ 2 + phase_sin ^ 2) AS phase_coherence, ortho_AB, ortho_AC, ortho_BC, arg_0 AS euler_arg, (arg_p - arg_m) / 0.02 AS euler_darg_dt,
      (uu + vv + sqrt((uu - vv) ^ 2 + 4 * uv * uv)) / 2 AS mu1, (uu + vv - sqrt((uu - vv) ^ 2 + 4 * uv * uv)) / 2 AS mu2 FROM ag JOIN ab USING (lfunc, kmax))""", recursive=True) + f"""
  SELECT {key}, abs(laplacian) / (abs(V) + 1e-15) AS harmonicity, torus_radius / (1 + torus_radius) AS poincare_r, 1 - torus_radius / (1 + torus_radius) AS poincare_gap FROM f"""


# second differences divide rounding noise by 9e-6, so these two are compared at three decimals
_ATLAS_FLOATS = " ".join(euler.FEATURES) + " mu1 mu2"


def _coarse(df):
    return df.withColumns({c: F.round(c, 3) for c in ("laplacian", "harmonicity")})


def _coarse_sql(sql):
    return f"SELECT * REPLACE (round(laplacian, 3) AS laplacian, round(harmonicity, 3) AS harmonicity) FROM ({sql}) z"


@query(_coarse_sql(_atlas_sql(ZETA_CHANNELS)), _ATLAS_FLOATS)
def euler_atlas(spark, d):
    table = euler.zeta_table(t.prime_table(spark, 1500))
    return _coarse(euler.euler_atlas(driver.parameter_points(spark, d), table, 40))


def _three_functions(spark):
    """Coefficient rows of zeta, the character modulo 4 and the curve y^2 = x^3 - x + 1."""
    primes_ = t.prime_table(spark, 500)
    chi = spark.createDataFrame([("chi4", 4, 1, 1.0), ("chi4", 4, 3, -1.0)], "lfunc string, modulus int, residue long, coef double")
    curve = spark.createDataFrame([("curve", -1, 1)], "lfunc string, a long, b long")
    rows = euler.constant_coefficients(primes_).union(euler.character_rows(primes_, chi)).union(euler.curve_rows(primes_, curve))
    return euler.coefficient_table(rows, primes_)


@query(_coarse_sql(_atlas_sql(CHI_CHANNELS)), _ATLAS_FLOATS)
def character_atlas(spark, d):
    return _coarse(euler.euler_atlas(driver.parameter_points(spark, d), _three_functions(spark).where("lfunc = 'chi4'"), 40))


@query(_coarse_sql(_atlas_sql(CURVE_CHANNELS)), _ATLAS_FLOATS)
def curve_atlas(spark, d):
    """Point counts over every prime; bad primes get 0."""
    return _coarse(euler.euler_atlas(driver.parameter_points(spark, d), _three_functions(spark).where("lfunc = 'curve'"), 40))


@query(_coarse_sql(_atlas_sql(ALL_CHANNELS, key="*")), _ATLAS_FLOATS)
def lfunc_atlas(spark, d):
    """Every part's point under three L-functions, in one job over one coefficient table."""
    names = F.explode(F.array(*map(F.lit, ("zeta", "chi4", "curve")))).alias("lfunc")
    return _coarse(euler.lfunc_atlas(driver.parameter_points(spark, d).select("*", names), _three_functions(spark), 40))


SCALES_SQL = with_(primes(1500), POINTS, """nx AS (SELECT k, p, ln_p, lead(ln_p) OVER (ORDER BY k) AS ln_n FROM primes),
  tm AS (SELECT point_id, k, exp(-sigma * (ln_p + ln_n)) AS w, (1.5 + exp(-sigma * ln_p) * cos(t * ln_p)) * cos(t * ln_n) AS tx, (1.5 + exp(-sigma * ln_p) * cos(t * ln_p)) * sin(t * ln_n) AS ty,
      exp(-sigma * ln_p) * sin(t * ln_p) AS tz FROM points JOIN nx ON k <= least(kmax * 4, 237)),
  pa AS (SELECT point_id, k, sum(w * tx) OVER g / sum(w) OVER g AS x, sum(w * ty) OVER g / sum(w) OVER g AS y, sum(w * tz) OVER g / sum(w) OVER g AS z FROM tm WINDOW g AS (PARTITION BY point_id ORDER BY k)),
  pb AS (SELECT *, CASE WHEN k >= 52 THEN avg(x) OVER b END AS cx, CASE WHEN k >= 52 THEN avg(y) OVER b END AS cy, CASE WHEN k >= 52 THEN avg(z) OVER b END AS cz, x - lag(x) OVER o AS sx, y - lag(y) OVER o AS sy, z - lag(z) OVER o AS sz
      FROM pa WHERE k >= 2 WINDOW b AS (PARTITION BY point_id ORDER BY k ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY point_id ORDER BY k)),
  pc AS (SELECT *, sqrt((cx - lag(cx) OVER o) ^ 2 + (cy - lag(cy) OVER o) ^ 2 + (cz - lag(cz) OVER o) ^ 2) AS drift, sqrt((x - cx) ^ 2 + (y - cy) ^ 2 + (z - cz) ^ 2) AS dev,
      (sx * lag(sx) OVER o + sy * lag(sy) OVER o + sz * lag(sz) OVER o) / (sqrt(sx * sx + sy * sy + sz * sz) * sqrt(lag(sx) OVER o ^ 2 + lag(sy) OVER o ^ 2 + lag(sz) OVER o ^ 2)) AS ca FROM pb WINDOW o AS (PARTITION BY point_id ORDER BY k)),
  pd AS (SELECT point_id, row_number() OVER o - 1 AS i, ca, median(ca) OVER (PARTITION BY point_id ORDER BY k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m10, count(*) OVER (PARTITION BY point_id) AS nc FROM pc WHERE ca IS NOT NULL WINDOW o AS (PARTITION BY point_id ORDER BY k)),
  co AS (SELECT point_id, CAST(coalesce(min(i + 2) FILTER (i >= 10 AND m10 > 0.9), any_value(nc)) AS DOUBLE) AS coherence_N, CASE WHEN any_value(nc) > 50 THEN median(ca) FILTER (i >= nc - 50) END AS median_cos FROM pd GROUP BY 1),
  f AS (SELECT point_id, median(drift) AS drift_rate, regr_slope(ln(dev), ln(k)) AS spiral_alpha, max_by(cx, k) - min_by(cx, k) FILTER (k >= 52) AS drift_x, max_by(cy, k) - min_by(cy, k) FILTER (k >= 52) AS drift_y,
      max_by(cz, k) - min_by(cz, k) FILTER (k >= 52) AS drift_z, max_by(dev, k) AS final_dev_mag, count(*) AS n FROM pc GROUP BY 1)""") + """
  SELECT point_id, n >= 70 AS scales_valid, """ + ", ".join(f"CASE WHEN n >= 70 THEN {c} END AS {c}" for c in euler.SCALE_FEATURES) + " FROM f JOIN co USING (point_id)"


@query(SCALES_SQL, " ".join(euler.SCALE_FEATURES))
def trajectory_scales(spark, d):
    return euler.trajectory_scales(driver.parameter_points(spark, d), t.prime_table(spark, 1500))


_PSI = """CASE WHEN abs(cos(2 * pi() * ({0}))) < 1e-6 THEN sin(2 * pi() * (({0}) ^ 2 - ({0}) - 1 / 16.0::DOUBLE)) * (2 * ({0}) - 1) / sin(2 * pi() * ({0}))
    ELSE cos(2 * pi() * (({0}) ^ 2 - ({0}) - 1 / 16.0::DOUBLE)) / cos(2 * pi() * ({0})) END"""


def _main_sql(t_):
    """|eta| of the main sum with two corrections, as an expression of t."""
    a = f"sqrt(({t_}) / (2 * pi()))"
    theta = f"(({t_}) * ln({a}) - ({t_}) / 2 - pi() / 8 + 1 / (48 * ({t_})) + 7 / (5760 * ({t_}) ^ 3))"
    terms_ = f"list_sum(list_transform(range(1, CAST(floor({a}) AS BIGINT) + 1), lambda n: cos({theta} - ({t_}) * ln(n)) / sqrt(n)))"
    psi = lambda e: "(" + _PSI.format(f"{a} - floor({a}) {e}") + ")"
    bend = f"({psi('+ 0.02')} - 2 * {psi('+ 0.01')} + 2 * {psi('- 0.01')} - {psi('- 0.02')}) / 2e-6"
    rest = f"CASE WHEN floor({a}) % 2 = 1 THEN 1 ELSE -1 END * ({psi('')} - {bend} / (96 * pi() ^ 2 * {a})) / sqrt({a})"
    return f"sqrt(3 - 2 * sqrt(2) * cos(({t_}) * ln(2))) * abs(2 * {terms_} + {rest})"


def _alternating_sql(t_, count, weight):
    part = lambda f: f"list_sum(list_transform(range(1, {count + 1}), lambda n: {weight} * (CASE n % 2 WHEN 1 THEN 1 ELSE -1 END) * exp(-0.5 * ln(n)) * {f}(({t_}) * ln(n))))"
    return f"sqrt({part('cos')} ^ 2 + {part('sin')} ^ 2)"


_SCAN = f"""g AS (SELECT c_custkey AS pos, 1.0::DOUBLE + c_custkey * 0.05::DOUBLE AS t FROM customer),
  e AS (SELECT pos, t, CASE WHEN t <= 80 THEN {_alternating_sql('t', 80, '1.0::DOUBLE')} ELSE {_main_sql('t')} END AS eta FROM g),
  x AS (SELECT *, lag(eta) OVER (ORDER BY pos) AS a, lead(eta) OVER (ORDER BY pos) AS b FROM e),
  low AS (SELECT pos, t, eta FROM x WHERE eta < a AND eta < b AND eta < (SELECT quantile_cont(eta, 0.1) FROM e))"""
ETA_SQL = with_(_SCAN) + "SELECT pos, t, eta FROM low"


def _refine_sql(rounds=6):
    """Nested grids: each round keeps a candidate's best of 21 points."""
    weights = "wts AS (SELECT [" + ", ".join(f"{w!r}::DOUBLE" for w in euler.acceleration_weights()) + "] AS w)"
    steps, before = [], "SELECT pos, t AS gamma, t <= 200 AS is_low FROM low"
    for step in range(rounds):
        size = f"CASE WHEN is_low THEN {_alternating_sql('t', euler.WEIGHTS, 'w[n]')} ELSE {_main_sql('t')} END"
        steps.append(f"""r{step} AS MATERIALIZED (SELECT pos, arg_min(t, residual) AS gamma, min(residual) AS residual, any_value(is_low) AS is_low
            FROM (SELECT pos, is_low, t, {size} AS residual FROM (SELECT *, gamma + unnest(range(-10, 11)) * {0.1 / 10 ** (step + 1)!r}::DOUBLE AS t FROM ({before}) c) q, wts) z GROUP BY pos)""")
        before = f"SELECT pos, gamma, is_low FROM r{step}"
    return with_(_SCAN, weights, *steps) + f"SELECT pos, round(gamma, 4) AS gamma, round(residual, 4) AS residual, residual < 1e-3 AS accepted FROM r{rounds - 1}"


def _grid(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), (1.0 + F.col("c_custkey") * 0.05).alias("t"))


@query(ETA_SQL, "t eta")
def valley_scan(spark, d):
    """Scan grid with one step of 0.05 per customer."""
    return euler.valley_scan(_grid(spark, d))


@query(_refine_sql(), "gamma residual")
def valley_refinement(spark, d):
    """At four decimals, above the last grid's step, where the two engines' roundings may choose neighbours."""
    found = euler.valley_refine(euler.valley_scan(_grid(spark, d)))
    return found.withColumns({c: F.round(c, 4) for c in ("gamma", "residual")})


CF = (RATIONALS, """cf(seq_id, k, n, d, a, q1, q0) AS (SELECT seq_id, 0, den, num % den, num // den, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM rationals
    UNION ALL SELECT seq_id, k + 1, d, n % d, n // d, (n // d) * q1 + q0, q1 FROM cf WHERE d <> 0 AND k < 91)""")


@query(with_(*CF, recursive=True) + "SELECT seq_id, CAST(k AS INTEGER) AS k, a, q1 AS q FROM cf")
def partial_quotients(spark, d):
    return quotients.expand_rationals(driver.rationals(spark, d))


_BINS, _RES = quotient.reference_shares()


def _chi_sql(shares, counts, limit):
    terms_ = [f"CASE WHEN n * {s!r}::DOUBLE {limit} 3 THEN ({c} - n * {s!r}::DOUBLE) ^ 2 / (n * {s!r}::DOUBLE) ELSE 0 END" for s, c in zip(shares, counts)]
    cells = [f"CASE WHEN n * {s!r}::DOUBLE {limit} 3 THEN 1 ELSE 0 END" for s in shares]
    return "(" + " + ".join(terms_) + ")", "(" + " + ".join(cells) + ")"


_CHI, _CELLS = _chi_sql(_BINS, [f"b{i}" for i in range(1, 12)], ">=")
_CHI3, _CELLS3 = _chi_sql(_RES, [f"m{i}" for i in range(3)], ">")

CF_PROFILE_SQL = with_(*CF, """i AS (SELECT seq_id, k, a, lead(a) OVER w AS nx, lag(a) OVER w AS pv FROM cf WHERE k >= 1 WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
  r AS (SELECT seq_id, rank() OVER (PARTITION BY seq_id ORDER BY a) + (count(*) OVER (PARTITION BY seq_id, a) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY seq_id ORDER BY nx) + (count(*) OVER (PARTITION BY seq_id, nx) - 1) / 2.0::DOUBLE AS ry FROM i WHERE nx IS NOT NULL),
  c AS (SELECT seq_id, CASE WHEN stddev_pop(rx) <= 1e-10 OR stddev_pop(ry) <= 1e-10 THEN 0 ELSE corr(rx, ry) END AS rho FROM r GROUP BY 1),
  lastq AS (SELECT seq_id, max_by(q1, k) AS q FROM cf GROUP BY 1),
  g AS (SELECT seq_id, CAST(count(*) AS DOUBLE) AS n, """ + ", ".join(f"sum(CASE WHEN a = {i} THEN 1.0 ELSE 0 END) AS b{i}" for i in range(1, 11)) +
                       ", sum(CASE WHEN a > 10 THEN 1.0 ELSE 0 END) AS b11, " + ", ".join(f"sum(CASE WHEN a % 3 = {i} THEN 1.0 ELSE 0 END) AS m{i}" for i in range(3)) +
                       """, avg(CASE WHEN a = 0 THEN 0 ELSE round(log2(a & -a)) END) AS adic2_depth, avg(CASE WHEN a % 2 = 1 THEN 1.0 ELSE 0 END) AS odd_even_ratio,
      avg(CASE WHEN a >= 2 AND (pr.p IS NOT NULL OR (a > 3000 AND len(list_filter(range(2, CAST(floor(sqrt(a)) AS BIGINT) + 1), lambda x: a % x = 0)) = 0)) THEN 1.0 ELSE 0 END) AS prime_fraction,
      sum(CASE WHEN a = 1 THEN 1.0 ELSE 0 END) AS ones, sum(CASE WHEN a = 1 AND (pv IS NULL OR pv <> 1) THEN 1.0 ELSE 0 END) AS runs, CAST(max(a) AS DOUBLE) AS max_coeff FROM i LEFT JOIN primes pr ON pr.p = i.a GROUP BY 1)""",
                       recursive=True).replace("WITH RECURSIVE ", "WITH RECURSIVE " + primes(3000) + ", ") + f"""
  SELECT rationals.seq_id, CASE WHEN n >= 3 AND {_CELLS} >= 3 THEN {_CHI} / greatest({_CELLS} - 1, 1) END AS gk_deviation, CASE WHEN n >= 3 THEN log2(q) / n END AS levy_exponent, CASE WHEN n >= 3 THEN b11 / n END AS large_a_freq,
  CASE WHEN n >= 3 THEN adic2_depth END AS adic2_depth, CASE WHEN n >= 3 THEN odd_even_ratio END AS odd_even_ratio, CASE WHEN n >= 3 THEN prime_fraction END AS prime_fraction,
  CASE WHEN n > 3 THEN coalesce(rho, 0) WHEN n = 3 THEN 0 END AS consec_corr, CASE WHEN n >= 3 THEN CASE WHEN runs > 0 THEN ones / runs ELSE 0 END END AS run_length_1, CASE WHEN n >= 3 THEN max_coeff END AS max_coeff,
  CASE WHEN n >= 3 AND {_CELLS3} >= 2 THEN {_CHI3} END AS digit_mod FROM rationals LEFT JOIN g USING (seq_id) LEFT JOIN c USING (seq_id) LEFT JOIN lastq USING (seq_id)"""


@query(CF_PROFILE_SQL, " ".join(quotient.FEATURES))
def quotient_profile(spark, d):
    return quotient.cf_profile_rows(quotients.rational_rows(driver.rationals(spark, d)))


CF_CROSS_SQL = with_(*CF, """pairs AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) z WHERE b IS NOT NULL),
  j AS (SELECT pairs.a, pairs.b, x.k, x.a AS x, y.a AS y FROM pairs JOIN cf x ON x.seq_id = pairs.a JOIN cf y ON y.seq_id = pairs.b AND y.k = x.k WHERE x.k >= 1),
  r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM j),
  g AS (SELECT a, b, count(*) AS n, CASE WHEN stddev_pop(rx) <= 1e-10 OR stddev_pop(ry) <= 1e-10 THEN 0 ELSE corr(rx, ry) END AS cross_corr, avg(CASE WHEN x > 10 AND y > 10 THEN 1.0 ELSE 0 END) AS shared_large,
      avg(CASE WHEN gcd(x, y) = 1 THEN 1.0 ELSE 0 END) AS gcd_coprime FROM r GROUP BY 1, 2),
  cell AS (SELECT a, b, x % 3 AS i, y % 3 AS j, count(*) AS c FROM j GROUP BY ALL),
  mi AS (SELECT a, b, sum(c / n * log2((c / n) / (ci / n * cj / n))) AS mod_mutual_info FROM (SELECT *, sum(c) OVER (PARTITION BY a, b) AS n, sum(c) OVER (PARTITION BY a, b, i) AS ci, sum(c) OVER (PARTITION BY a, b, j) AS cj FROM cell) q GROUP BY 1, 2)""",
                     recursive=True) + "SELECT a, b, " + ", ".join(f"CASE WHEN n >= 3 THEN {c} END AS {c}" for c in quotient.PAIR_FEATURES) + " FROM g JOIN mi USING (a, b)"


@query(CF_CROSS_SQL, " ".join(quotient.PAIR_FEATURES))
def quotient_pairs(spark, d):
    """Each order against the customer's next order."""
    orders = t.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    pairs = consecutive_pairs(orders, ["o_custkey"], "o_orderkey")
    return quotient.cf_cross_rows(quotients.rational_rows(driver.rationals(spark, d)), pairs)


CURVES = """curves AS (SELECT p_partkey AS curve_id, CAST(p_size AS BIGINT) AS a, p_partkey % 50 + 1 AS b, p FROM part JOIN primes ON k = p_partkey % 25 + 3)"""


def _curves(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 25 + 3).cast("int").alias("k"))
    joined = part.join(F.broadcast(t.prime_table(spark, 1500)), "k")
    return joined.select(F.col("p_partkey").alias("curve_id"), F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 50 + 1).alias("b"), "p")


COUNTS = """counts AS (SELECT a, b, p, 1 + count(*) FILTER ((y * y) % p = ((x * x % p) * x + a * x + b) % p) AS n_points FROM fields, (SELECT unnest(range(130)) AS x) u, (SELECT unnest(range(130)) AS y) v WHERE x < p AND y < p GROUP BY 1, 2, 3)"""


@query(with_(primes(1500), CURVES, "fields AS (SELECT DISTINCT a, b, p FROM curves)", COUNTS) + "SELECT a, b, p, n_points, p + 1 - n_points AS ap FROM counts")
def curve_orders(spark, d):
    return curves.curve_orders(_curves(spark, d)).withColumn("ap", F.col("p") + 1 - F.col("n_points"))


@query()
def large_field_orders(spark, d):
    """Points of one curve per customer over the field of its nation, the first prime from a start between a million and 2 ** 31."""
    start = (F.lit(1_000_003) + F.pmod(F.xxhash64("n_nationkey"), F.lit(2**31 - 2_000_000))).cast("long")
    fields = t.table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(start, start + 400)).alias("p"))
    fields = fields.where(t.is_prime("p")).groupBy("n_nationkey").agg(F.min("p").alias("p"))
    rows = t.table(spark, d, "customer").join(fields, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 89 + 1).alias("b"), "p")
    return curvegroups.large_curve_orders(rows).withColumn("ap", F.col("p") + 1 - F.col("n_points"))


AUDIT_SQL = with_(primes(1500), CURVES, """kinds AS (SELECT DISTINCT a, b, p FROM curves),
  probes AS (SELECT * FROM (SELECT a, b, kinds.p, primes.p AS q, row_number() OVER (PARTITION BY a, b, kinds.p ORDER BY primes.p) - 1 AS seq FROM kinds JOIN primes ON primes.p BETWEEN greatest(5, kinds.p - 20) AND kinds.p + 20) z WHERE seq < 20),
  fields AS (SELECT DISTINCT a % q AS a, b % q AS b, q AS p FROM probes UNION SELECT a % p, b % p, p FROM kinds)""", COUNTS, """
  ap AS (SELECT probes.*, q + 1 - n_points AS ap FROM probes JOIN counts c ON c.p = q AND c.a = probes.a % q AND c.b = probes.b % q),
  apn AS (SELECT *, lead(ap) OVER (PARTITION BY a, b, p ORDER BY seq) AS nx, avg(ap) OVER (PARTITION BY a, b, p) AS m FROM ap),
  sp AS (SELECT a, b, p, avg(ap) AS ap_mean, stddev_pop(ap) AS ap_std, CAST(max(abs(ap)) AS DOUBLE) AS ap_max_abs, avg(ap / (2 * sqrt(q))) AS ap_hasse_mean, stddev_pop(ap / (2 * sqrt(q))) AS ap_hasse_std, avg(CASE WHEN ap > 0 THEN 1.0 ELSE 0 END) AS ap_sign_bias,
      CASE WHEN count(*) >= 4 AND sum((ap - m) ^ 2) > 1e-15 THEN sum((ap - m) * (nx - m)) / sum((ap - m) ^ 2) ELSE 0 END AS ap_autocorr FROM apn GROUP BY 1, 2, 3),
  own AS (SELECT kinds.a, kinds.b, kinds.p, n_points AS o FROM kinds JOIN counts c ON c.p = kinds.p AND c.a = kinds.a % kinds.p AND c.b = kinds.b % kinds.p),
  fac AS (SELECT o, max(primes.p) AS lpf, count(*) AS nd, sum(len(list_filter(range(1, 8), lambda e: o % CAST(primes.p ** e AS BIGINT) = 0))) AS nf FROM (SELECT DISTINCT o FROM own) x JOIN primes ON o % primes.p = 0 GROUP BY 1),
  emb AS (SELECT p, o, 1 AS k, p % o AS pw FROM (SELECT DISTINCT p, o FROM own) x WHERE o > 1 UNION ALL SELECT p, o, k + 1, pw * p % o FROM emb WHERE k < 100 AND pw <> 1),
  em AS (SELECT p, o, coalesce(min(k) FILTER (pw = 1), 100) AS ek FROM emb GROUP BY 1, 2),
  f AS (SELECT curve_id, curves.a, curves.b, curves.p, CAST(curves.p AS DOUBLE) AS prime_p, ln(curves.p) AS log_p, CASE WHEN (-16 * (4 * curves.a ^ 3 + 27 * curves.b ^ 2)) % curves.p <> 0 THEN 1.0 ELSE 0.0 END AS discriminant_nonzero,
      CAST(own.o AS DOUBLE) AS "order", CAST(curves.p + 1 - own.o AS DOUBLE) AS a_p, (curves.p + 1 - own.o) / (2 * sqrt(curves.p)) AS hasse_normalized, CASE WHEN nd = 1 AND nf = 1 THEN 1.0 ELSE 0.0 END AS order_is_prime, CAST(coalesce(nf, 0) AS DOUBLE) AS order_n_factors,
      CAST(coalesce(lpf, 1) AS DOUBLE) AS largest_prime_factor, coalesce(lpf, 1) / own.o AS lpf_ratio, CASE WHEN coalesce(lpf, 1) <= 16 THEN 1.0 ELSE 0.0 END AS smoothness_16, CASE WHEN coalesce(lpf, 1) <= 32 THEN 1.0 ELSE 0.0 END AS smoothness_32,
      CAST(own.o // coalesce(lpf, 1) AS DOUBLE) AS cofactor, CAST(coalesce(ek, 100) AS DOUBLE) AS embedding_degree, ln(coalesce(ek, 100) + 1) AS log_embedding, CASE WHEN coalesce(ek, 100) <= 6 THEN 1.0 ELSE 0.0 END AS mov_vulnerable,
      CASE WHEN own.o = curves.p THEN 1.0 ELSE 0.0 END AS anomalous, sp.* EXCLUDE (a, b, p), CASE WHEN (curves.p + 1 - own.o) ^ 2 < 4 * curves.p THEN sqrt(curves.p) ELSE abs(curves.p + 1 - own.o) / 2 + sqrt((curves.p + 1 - own.o) ^ 2 - 4 * curves.p) / 2 END AS lambda_1,
      1.0 AS lambda_ratio, abs(curves.p + 1 - own.o) / (2 * sqrt(curves.p)) AS trace_norm
      FROM curves JOIN own USING (a, b, p) LEFT JOIN fac USING (o) LEFT JOIN em ON em.p = curves.p AND em.o = own.o JOIN sp ON sp.a = curves.a AND sp.b = curves.b AND sp.p = curves.p),
  g AS (SELECT *, least((CASE WHEN order_is_prime > 0 THEN 3 WHEN lpf_ratio > 0.8 THEN 2 WHEN lpf_ratio > 0.5 THEN 1 ELSE 0 END + CASE WHEN embedding_degree > 20 THEN 2 WHEN embedding_degree > 6 THEN 1 ELSE 0 END + (1 - anomalous) + CASE WHEN a_p <> 0 THEN 1 ELSE 0 END) / 7.0::DOUBLE, 1) AS security_score,
      CAST(anomalous + mov_vulnerable + CASE WHEN smoothness_32 > 0 OR lpf_ratio < 0.5 THEN 1 ELSE 0 END AS INTEGER) AS issues FROM f)""", recursive=True) + """
  SELECT * EXCLUDE (issues), CASE WHEN security_score > 0.7 THEN 1.0 ELSE 0.0 END AS is_secure, CASE WHEN issues = 0 THEN 'SECURE' WHEN issues > 1 THEN 'WEAK' WHEN anomalous > 0 THEN 'ANOMALOUS' WHEN mov_vulnerable > 0 THEN 'MOV_WEAK' ELSE 'POHLIG_HELLMAN' END AS verdict FROM g"""


@query(AUDIT_SQL, " ".join(curves.FEATURES))
def curve_audit(spark, d):
    return curves.curve_audit(_curves(spark, d)).drop("reason")


WEIGHTS = "weights AS (SELECT CAST(label AS VARCHAR) AS run_id, CAST(pos % 30 + 1 AS INTEGER) AS k, avg(value) AS theta FROM series GROUP BY 1, 2)"
ZEROS = "zeros AS (SELECT unnest([" + ", ".join(f"{z!r}::DOUBLE" for z in ZETA_ZEROS) + "]) AS t)"


def _weights(spark, d):
    series = driver.embedding_series(spark, d)
    return series.groupBy(F.col("label").cast("string").alias("run_id"), (F.col("pos") % 30 + 1).cast("int").alias("k")).agg(F.avg("value").alias("theta"))


@query(with_(SERIES, primes(1500), WEIGHTS, ZEROS, """sg AS (SELECT unnest([0.4::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS sigma),
  z AS (SELECT run_id, sigma, t, theta, ln_p, exp(-sigma * ln_p) * cos(t * ln_p) AS zr, -exp(-sigma * ln_p) * sin(t * ln_p) AS zi FROM weights JOIN primes USING (k), zeros, sg),
  s AS (SELECT run_id, sigma, t, sum(theta * ln_p * (zr * (1 - zr) - zi * zi) / ((1 - zr) ^ 2 + zi ^ 2)) AS a, sum(theta * ln_p * zi / ((1 - zr) ^ 2 + zi ^ 2)) AS b FROM z GROUP BY 1, 2, 3)""") +
       "SELECT run_id, sigma, t, sqrt(a * a + b * b) AS residual, a * a + b * b AS squared FROM s", "sigma t residual squared")
def weighted_residuals(spark, d):
    """Residual of every label's mean weights at the first ten zeros, swept over sigma."""
    targets = spark.createDataFrame([(s, z) for s in (0.4, 0.5, 0.75, 1.0) for z in ZETA_ZEROS], "sigma double, t double")
    return euler.weighted_residual(_weights(spark, d), t.prime_table(spark, 1500), targets)


@query(with_(SERIES, primes(1500), ORD2, ALL_CHANNELS, WEIGHTS, ZEROS, "z AS (SELECT lfunc, run_id, 0.75::DOUBLE AS sigma, t, theta, ln_p, p, coef, degree FROM weights JOIN tab USING (k), zeros)", f"""
  s AS (SELECT lfunc, run_id, sigma, t, {_deriv('re', 'sigma', 't').replace('sum(', 'sum(theta * ', 1)} AS a, {_deriv('im', 'sigma', 't').replace('sum(', 'sum(theta * ', 1)} AS b FROM z GROUP BY 1, 2, 3, 4)""", recursive=True) +
       "SELECT lfunc, run_id, sigma, t, sqrt(a * a + b * b) AS residual, a * a + b * b AS squared FROM s", "sigma t residual squared")
def lfunc_residuals(spark, d):
    """Residual of every label's mean weights at the first ten zeros, under three L-functions."""
    targets = spark.createDataFrame([(0.75, z) for z in ZETA_ZEROS], "sigma double, t double")
    names = F.explode(F.array(*map(F.lit, ("zeta", "chi4", "curve")))).alias("lfunc")
    return euler.lfunc_residual(_weights(spark, d).select("*", names), _three_functions(spark), targets)


def _sp(e, part="run_id"):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {e}) + (count(*) OVER (PARTITION BY {part}, {e}) - 1) / 2.0::DOUBLE"


_SCREEN = {"ln_p": "ln_p", "p_half": "exp(-0.5 * ln_p)", "inverse_k": "1.0::DOUBLE / k", "v2": "c1", "order_ratio": "c2", "ln_p_squared": "ln_p ^ 2", "inverse_p": "exp(-ln_p)"}


@query(with_(SERIES, primes(1500), ORD2, ZETA_CHANNELS, WEIGHTS, "x AS (SELECT run_id, theta, " + ", ".join(f"{e} AS f_{n}" for n, e in _SCREEN.items()) + " FROM weights JOIN tab USING (k))",
             f"r AS (SELECT run_id, {_sp('theta')} AS rt, " + ", ".join(f"{_sp('f_' + n)} AS r_{n}" for n in _SCREEN) + " FROM x)",
             "g AS (" + " UNION ALL ".join(f"SELECT run_id, '{n}' AS feature, count(*) AS n, CASE WHEN stddev_pop(rt) <= 1e-10 OR stddev_pop(r_{n}) <= 1e-10 THEN 0 ELSE corr(rt, r_{n}) END AS rho FROM r GROUP BY 1" for n in _SCREEN) + ")",
             "h AS (SELECT run_id, feature, rho, rho * sqrt((n - 2) / greatest(1 - rho ^ 2, 1e-15)) AS t_stat FROM g)", recursive=True) +
       "SELECT run_id, feature, rho, t_stat, CASE WHEN abs(t_stat) > 2.576 AND abs(rho) > 0.3 THEN 'YES' WHEN abs(t_stat) > 1.96 THEN 'weak' ELSE 'NO' END AS signal FROM h", "rho t_stat")
def weight_screen(spark, d):
    return euler.weight_screen(_weights(spark, d), euler.zeta_table(t.prime_table(spark, 180)))


@query(with_(SERIES, primes(1500), WEIGHTS) + """SELECT run_id, regr_slope(ln(abs(theta)), ln(k)) AS alpha, regr_slope(ln(abs(theta)), ln_p) AS beta FROM weights JOIN primes USING (k)
  WHERE abs(theta) > 1e-6 GROUP BY 1 HAVING count(*) > 5""", "alpha beta")
def weight_decay(spark, d):
    return euler.weight_decay(_weights(spark, d), t.prime_table(spark, 180))


@query(with_(SERIES, WEIGHTS, """g AS (SELECT x.run_id AS a, y.run_id AS b, corr(x.theta, y.theta) AS r, degrees(acos(sum(x.theta * y.theta) / (sqrt(sum(x.theta ^ 2)) * sqrt(sum(y.theta ^ 2)) + 1e-15))) AS angle
    FROM weights x JOIN weights y ON x.k = y.k AND CAST(y.run_id AS INTEGER) = CAST(x.run_id AS INTEGER) + 1 GROUP BY 1, 2)""") +
       "SELECT *, CASE WHEN abs(r) > 0.7 THEN 'UNIVERSAL' WHEN abs(r) < 0.3 THEN 'ZERO-SPECIFIC' ELSE 'PARTIAL' END AS kind FROM g", "r angle")
def weight_similarity(spark, d):
    weights = _weights(spark, d)
    runs = weights.select("run_id").distinct()
    pairs = runs.select(F.col("run_id").alias("a"), (F.col("run_id").cast("int") + 1).cast("string").alias("b"))
    return euler.weight_similarity(weights, pairs)


@query(with_(SERIES, primes(1500), ORD2, ZETA_CHANNELS, WEIGHTS, "x AS (SELECT run_id, theta AS y, c1 AS a, c2 AS b FROM weights JOIN tab USING (k))", """
  m AS (SELECT run_id, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x GROUP BY 1),
  c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)""", recursive=True) +
       "SELECT run_id, my - ca * ma - cb * mb AS c0, ca AS c1, cb AS c2, (ca * ay + cb * byy) / yy AS r2 FROM c", "c0 c1 c2 r2")
def channel_regression(spark, d):
    """How much of the weights the arithmetic channel explains."""
    rows = _weights(spark, d).join(F.broadcast(euler.zeta_table(t.prime_table(spark, 180))), "k")
    return fits.least_squares(rows, ["run_id"], "theta", ["channel_1", "channel_2"])


