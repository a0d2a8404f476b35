"""Level, dispersion and colour profiles."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqlpeaks import peaks_sql
from spectrafold.catalog.sqltext import SERIES, SPECTRA41, with_
from spectrafold.functions.fixed import OBSERVER_X, OBSERVER_Y, OBSERVER_Z
from spectrafold.operators import peaks, sequences
from spectrafold.operators.blocks import consecutive_pairs
from spectrafold.plans import colour, dispersion, levels
from spectrafold.sources import driver, tables as t

LEVELS = """levels AS (SELECT obj_id, rn - 1 AS idx, level FROM (SELECT obj_id, level, row_number() OVER (PARTITION BY obj_id ORDER BY level) AS rn
    FROM (SELECT DISTINCT concat(p_brand, '/', p_type) AS obj_id, p_retailprice AS level FROM part) x) y)"""


def _levels(spark, d):
    prices = t.table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("obj"), "p_retailprice").distinct()
    return levels.ordered_levels(prices, "obj", "p_retailprice")


@query(with_(LEVELS, """s AS (SELECT *, level - lag(level) OVER w AS s, min(level) OVER g AS f0, max(level) OVER g AS fm, count(*) OVER g AS n FROM levels
    WINDOW w AS (PARTITION BY obj_id ORDER BY idx), g AS (PARTITION BY obj_id)),
  u AS (SELECT *, lead(s) OVER (PARTITION BY obj_id ORDER BY idx) AS nx, avg(s) OVER (PARTITION BY obj_id) AS ms FROM s),
  a AS (SELECT obj_id, max(n) AS n, min(level) AS f_0, max(CASE WHEN idx = least(1, n - 1) THEN level END) AS f_1, max(CASE WHEN idx = least(2, n - 1) THEN level END) AS f2,
      max(CASE WHEN idx = least(4, n - 1) THEN level END) AS f_4, max(CASE WHEN idx = least(9, n - 1) THEN level END) AS f_9, max(level) AS f_max,
      avg(s) AS mean_spacing, stddev_pop(s) AS std_spacing, sqrt(avg((level - ((idx + 1) * (fm - f0) / n + f0)) ^ 2)) AS line,
      avg(CASE WHEN nx IS NOT NULL AND s IS NOT NULL THEN least(s, nx) / (greatest(s, nx) + 1e-15) END) AS rep,
      avg(CASE WHEN idx < 10 THEN abs(level / f0 - round_even(level / f0, 0)) END) AS dev,
      2 * regr_slope(ln(idx + 1), ln(level + 1e-15)) AS dim, sum(CASE WHEN s < ms * 0.01 THEN 1.0 ELSE 0.0 END) AS degeneracy,
      sum(CASE WHEN s < ms * 0.1 THEN 1.0 ELSE 0.0 END) AS near_degen, median(s) AS median_spacing, max(CASE WHEN idx = 1 THEN s END) AS s0, max(CASE WHEN idx = n - 1 THEN s END) AS s1
      FROM u GROUP BY 1),
  b AS (SELECT *, f_1 - f_0 AS gap, f_1 / f_0 AS ratio_21, f2 / f_0 AS ratio_31, std_spacing / (mean_spacing + 1e-15) AS spacing_cv, line / (mean_spacing + 1e-15) AS weyl_resid,
      CASE WHEN n > 3 THEN rep ELSE 0 END AS level_repulsion, dev AS harmonicity, CASE WHEN n > 5 THEN dim ELSE 0 END AS spec_dim, f_max / (f_0 + 1e-15) AS bandwidth,
      s1 / (s0 + 1e-15) AS spacing_growth, CASE WHEN degeneracy = 0 THEN 1.0 ELSE 0.0 END AS non_degen FROM a),
  c AS (SELECT *, gap / (f_0 + 1e-15) AS Q_factor, 1 / (spacing_cv + 1e-15) AS regularity FROM b)""") +
       """SELECT obj_id, CAST(n AS DOUBLE) AS n_modes, f_0, f_1, gap, ratio_21, mean_spacing, std_spacing, spacing_cv, weyl_resid, level_repulsion, harmonicity, spec_dim, degeneracy,
  near_degen, f_4, f_9, ratio_31, f_max, bandwidth, median_spacing, spacing_growth, Q_factor, regularity, non_degen, Q_factor * 0.4 + regularity * 0.003 + non_degen * 0.2 AS antenna_score,
  0.3 / (spacing_cv + 0.01) + 0.3 / (weyl_resid + 0.01) + (1 - harmonicity) * 0.4 AS acoustic_score FROM c WHERE n >= 3""",
       " ".join(f for f in levels.FEATURES if f not in ("n_interior", "param_a", "param_b")))
def level_profile(spark, d):
    return levels.level_profile(_levels(spark, d)).where("n_modes IS NOT NULL").drop("n_interior", "param_a", "param_b")


@query(with_(LEVELS, """g AS (SELECT obj_id, idx, lead(level) OVER (PARTITION BY obj_id ORDER BY idx) - level AS gap, count(*) OVER (PARTITION BY obj_id) AS n FROM levels)""") +
       """SELECT obj_id, coalesce(max(gap) FILTER (idx >= 1 AND idx < least(n - 1, 10)), 0) AS max_gap,
  coalesce(arg_min(idx, (-gap, idx)) FILTER (idx >= 1 AND idx < least(n - 1, 10) AND gap > 0), 0) AS max_gap_idx FROM g GROUP BY 1""", "max_gap max_gap_idx")
def largest_level_gap(spark, d):
    return levels.largest_gap(_levels(spark, d))


@query(with_(LEVELS, "s AS (SELECT obj_id, level, level - lag(level) OVER (PARTITION BY obj_id ORDER BY level) AS spacing FROM levels)") +
       """SELECT obj_id, level, spacing, least(spacing, nx) / (greatest(spacing, nx) + 1e-15) AS repulsion FROM (SELECT *, lead(spacing) OVER (PARTITION BY obj_id ORDER BY level) AS nx
  FROM s WHERE spacing IS NOT NULL) q""".replace("least(spacing, nx)", "CASE WHEN nx IS NOT NULL THEN least(spacing, nx) END"), "level spacing repulsion")
def level_spacings(spark, d):
    return sequences.spacings(_levels(spark, d), ["obj_id"], "level")


def _cells(spark, d):
    key = F.col("p_partkey")
    heavy, light = (1.0 + F.col("p_size")), (2.0 + key % 40)
    return t.table(spark, d, "part").select(
        key.alias("mat_id"),
        F.when(key % 5 == 0, F.array(heavy)).otherwise(F.array(heavy, light.cast("double"))).alias("masses"),
        F.array((10.0 + key % 50).cast("double"), (12.0 + key % 31).cast("double")).alias("springs"),
    )


BANDS = """cells AS (SELECT p_partkey AS mat_id, 1.0::DOUBLE + p_size AS m0, 2.0::DOUBLE + p_partkey % 40 AS m1, 10.0::DOUBLE + p_partkey % 50 AS k0, 12.0::DOUBLE + p_partkey % 31 AS k1,
    p_partkey % 5 = 0 AS one FROM part),
  qs AS (SELECT *, i * (pi() / 49) AS q FROM cells, (SELECT unnest(range(50)) AS i) v),
  sq AS (SELECT *, (k0 + k1) / m0 AS a, (k0 + k1) / m1 AS dd, (k0 * k0 + k1 * k1 + 2 * k0 * k1 * cos(q)) / (m0 * m1) AS b FROM qs),
  bands AS (SELECT mat_id, i AS q_idx, q, CAST(br AS INTEGER) AS branch, sqrt(greatest(CASE WHEN one THEN a WHEN br = 0 THEN (a + dd) / 2 - sqrt(((a - dd) / 2) ^ 2 + b) ELSE (a + dd) / 2 + sqrt(((a - dd) / 2) ^ 2 + b) END, 0)) AS omega
    FROM sq, (SELECT unnest([0, 1]) AS br) w WHERE br = 0 OR NOT one)"""
DISPERSION = BANDS + """, g AS (SELECT *, CASE WHEN lag(omega) OVER w IS NULL THEN lead(omega) OVER w - omega WHEN lead(omega) OVER w IS NULL THEN omega - lag(omega) OVER w
      ELSE (lead(omega) OVER w - lag(omega) OVER w) / 2 END AS rise FROM bands WINDOW w AS (PARTITION BY mat_id, branch ORDER BY q_idx)),
  pb AS (SELECT mat_id, branch, max(omega) AS hi, min(omega) AS lo, max(omega) - min(omega) AS bw, max(CASE WHEN q_idx = 0 THEN omega END) AS w0, max(CASE WHEN q_idx = 1 THEN omega END) AS w1,
      avg(abs(rise)) / (pi() / 49) AS vg FROM g GROUP BY 1, 2),
  mt AS (SELECT mat_id, count(*) AS nb, max(hi) AS top FROM pb GROUP BY 1),
  m AS (SELECT mat_id, any_value(nb) AS nb, any_value(top) AS top, max(CASE WHEN branch = 0 THEN bw END) AS acoustic_BW, avg(bw) AS mean_BW, stddev_pop(bw) AS std_BW, max(vg) AS v_group_max, avg(vg) AS v_group_mean,
      max(CASE WHEN branch = 0 THEN hi END) AS hi0, max(CASE WHEN branch = 1 THEN lo END) AS lo1, coalesce(max(CASE WHEN branch = 0 AND w0 < w1 THEN (w1 - w0) / (pi() / 49) END), 0) AS v_sound,
      avg(CASE WHEN branch > 0 THEN 1 - bw / (top + 1e-15) END) AS flat, sum(CASE WHEN bw > top * 0.1 THEN 1.0 ELSE 0.0 END) AS n_dispersive FROM pb JOIN mt USING (mat_id) GROUP BY 1),
  live AS (SELECT mat_id, omega FROM bands WHERE omega > 1e-10),
  lim AS (SELECT mat_id, CASE WHEN max(omega) = min(omega) THEN min(omega) - 0.5 ELSE min(omega) END AS lo, CASE WHEN max(omega) = min(omega) THEN 1.0 ELSE max(omega) - min(omega) END AS span,
      count(*) AS t, avg(omega) AS omega_mean FROM live GROUP BY 1),
  h AS (SELECT mat_id, least(floor((omega - lo) / span * 30), 29) AS bin, count(*) AS n FROM live JOIN lim USING (mat_id) GROUP BY 1, 2),
  dos AS (SELECT mat_id, max(n / (t * (span / 30))) AS DOS_max, -sum(n / t * ln(n / t + 1e-15)) AS DOS_entropy FROM h JOIN lim USING (mat_id) GROUP BY 1),
  s1 AS (SELECT mat_id, omega, omega - lag(omega) OVER (PARTITION BY mat_id ORDER BY omega) AS s FROM live),
  s2 AS (SELECT mat_id, s, lead(s) OVER (PARTITION BY mat_id ORDER BY omega) AS nx FROM s1 WHERE s > 1e-10),
  sp AS (SELECT mat_id, count(*) AS ns, avg(s) AS sm, stddev_pop(s) / (avg(s) + 1e-15) AS scv, avg(CASE WHEN nx IS NOT NULL THEN least(s, nx) / (greatest(s, nx) + 1e-15) END) AS lr FROM s2 GROUP BY 1),
  f AS (SELECT mat_id, CASE WHEN nb > 1 THEN greatest(lo1 - hi0, 0) ELSE 0 END AS band_gap, top AS omega_max, omega_mean, CAST(nb AS DOUBLE) AS n_branches, acoustic_BW, mean_BW, std_BW, v_sound, v_group_max, v_group_mean,
      DOS_max, DOS_entropy, DOS_max / (1 / span + 1e-15) AS einstein_ind, coalesce(flat, 0) AS optical_flat, CASE WHEN ns > 2 THEN sm ELSE 0 END AS spacing_mean, CASE WHEN ns > 2 THEN scv ELSE 0 END AS spacing_CV,
      CASE WHEN ns > 2 THEN lr ELSE 0 END AS level_repulsion, CASE WHEN one THEN 1.0 ELSE greatest(m0, m1) / (least(m0, m1) + 1e-15) END AS mass_ratio, greatest(k0, k1) / (least(k0, k1) + 1e-15) AS spring_ratio,
      CASE WHEN one THEN 1.0 ELSE 2.0 END AS atoms_per_cell, n_dispersive FROM m JOIN lim USING (mat_id) JOIN dos USING (mat_id) LEFT JOIN sp USING (mat_id) JOIN cells USING (mat_id)),
  fin AS (SELECT *, v_sound ^ 2 / (spacing_CV + 0.1) AS kappa_proxy, omega_max * 0.048 AS debye_T_proxy, v_sound * sqrt(mass_ratio) AS impedance, band_gap / (omega_max + 1e-15) AS norm_gap,
      CASE WHEN band_gap > 0.1 THEN 1.0 ELSE 0.0 END AS is_insulator, CASE WHEN optical_flat > 0.8 THEN 1.0 ELSE 0.0 END AS has_flat, CASE WHEN v_sound > 1 THEN 1.0 ELSE 0.0 END AS high_v,
      CASE WHEN spacing_CV < 0.5 THEN 1.0 ELSE 0.0 END AS regular FROM f)"""


@query(with_(BANDS) + "SELECT mat_id, branch, count(*) AS n, sum(omega) AS total, max(omega) AS top FROM bands GROUP BY 1, 2", "total top")
def chain_bands(spark, d):
    return dispersion.chain_bands(_cells(spark, d)).groupBy("mat_id", "branch").agg(
        F.count("*").alias("n"), F.sum("omega").alias("total"), F.max("omega").alias("top")
    )


@query(with_(DISPERSION) + "SELECT * FROM fin", " ".join(dispersion.FEATURES))
def dispersion_profile(spark, d):
    cells = _cells(spark, d)
    return dispersion.dispersion_profile(dispersion.chain_bands(cells), cells)


@query(with_(DISPERSION) + """SELECT mat_id, round((band_gap + 0.1) * (optical_flat + 0.1) / (kappa_proxy + 0.1), 6) AS score FROM fin ORDER BY 2 DESC, 1 LIMIT 10""", "score")
def thermoelectric_ranking(spark, d):
    cells = _cells(spark, d)
    profile = dispersion.dispersion_profile(dispersion.chain_bands(cells), cells)
    return profile.select("mat_id", F.round(dispersion.thermoelectric_score(), 6).alias("score")).orderBy(F.desc("score"), "mat_id").limit(10)


PEAK_SRC = "src AS (SELECT series_id AS g, pos, abs(value) AS v, avg(abs(value)) OVER (PARTITION BY series_id) AS mean, max(abs(value)) OVER (PARTITION BY series_id) AS top FROM series)"


@query(with_(SERIES, PEAK_SRC, peaks_sql("src", "mean", "4", "0.3 * top"), recursive=True) + "SELECT g AS series_id, pos, v AS a, prom AS prominence FROM pk", "a prominence")
def signal_peaks(spark, d):
    """Peaks of |x| above its mean, 4 apart, with a prominence of 30 % of the maximum."""
    series = driver.embedding_series(spark, d).select("series_id", "pos", F.abs("value").alias("a"))
    top = series.groupBy("series_id").agg(F.avg("a").alias("mean"), F.max("a").alias("top"))
    found = peaks.find_peaks(
        series.join(top, "series_id"), ["series_id"], "pos", "a", height=F.col("mean"), distance=4, prominence=0.3 * F.col("top"),
        keep=["mean", "top"], length=64,
    )
    return found.select("series_id", "pos", "a", "prominence")


_OBS = "obs AS (SELECT u.i AS idx, xs[u.i + 1] AS xb, ys[u.i + 1] AS yb, zs[u.i + 1] AS zb FROM (SELECT {x}::DOUBLE[] AS xs, {y}::DOUBLE[] AS ys, {z}::DOUBLE[] AS zs) o, UNNEST(range(41)) AS u(i))".format(
    x=list(OBSERVER_X), y=list(OBSERVER_Y), z=list(OBSERVER_Z))
COLOUR = (SPECTRA41, _OBS, "src AS (SELECT series_id AS g, idx AS pos, amp AS v, max(amp) OVER (PARTITION BY series_id) AS top FROM spectrum)", peaks_sql("src", distance="3", prominence="0.05 * top"),
          """s AS (SELECT *, max(amp) OVER g AS mx, sum(amp) OVER g AS tot, sum(nm * amp) OVER g / (sum(amp) OVER g + 1e-15) AS c, lag(amp) OVER (PARTITION BY series_id ORDER BY idx) AS pv FROM spectrum WINDOW g AS (PARTITION BY series_id)),
  ps AS (SELECT g, pos, v, 10.0::DOUBLE * (pos - lag(pos) OVER (PARTITION BY g ORDER BY pos)) AS sp FROM pk),
  pn AS (SELECT *, lead(sp) OVER (PARTITION BY g ORDER BY pos) AS nx FROM ps),
  pf AS (SELECT g, count(*) AS np, 380.0::DOUBLE + 10 * min(pos) AS pw, min_by(v, pos) AS pa, avg(sp) AS ms, stddev_pop(sp) / (avg(sp) + 1e-15) AS cv, avg(CASE WHEN sp IS NOT NULL AND nx IS NOT NULL THEN least(sp, nx) / (greatest(sp, nx) + 1e-15) END) AS lr FROM pn GROUP BY 1),
  a AS (SELECT series_id, 10 * sum(amp * xb) AS X, 10 * sum(amp * yb) AS Y, 10 * sum(amp * zb) AS Z, arg_min(nm, (-(amp * xb + amp * yb), nm)) AS dominant_wl, any_value(mx) AS mx,
      CASE WHEN count(*) FILTER (amp > 0.5 * mx) > 1 THEN max(nm) FILTER (amp > 0.5 * mx) - min(nm) FILTER (amp > 0.5 * mx) ELSE 0 END AS bandwidth_50,
      -sum(amp / (tot + 1e-15) * ln(amp / (tot + 1e-15) + 1e-15)) AS spec_entropy, any_value(c) AS centroid, sqrt(sum((nm - c) ^ 2 * amp) / any_value(tot)) AS spread,
      sum((nm - c) ^ 3 * amp / tot) AS m3, sum((nm - c) ^ 4 * amp / tot) AS m4, sum(CASE WHEN idx >= 24 THEN amp ELSE 0 END) / any_value(tot) AS red_ratio,
      sum(CASE WHEN idx >= 12 AND idx < 24 THEN amp ELSE 0 END) / any_value(tot) AS green_ratio, sum(CASE WHEN idx < 12 THEN amp ELSE 0 END) / any_value(tot) AS blue_ratio,
      sum(CASE WHEN idx < 4 THEN amp ELSE 0 END) / any_value(tot) AS uv_energy, sqrt(avg((amp - pv) ^ 2)) AS smoothness,
      exp(avg(ln(amp)) FILTER (amp > 1e-10)) / (avg(amp) FILTER (amp > 1e-10) + 1e-15) AS flatness, sum(CASE WHEN idx < 13 THEN amp ELSE 0 END) / any_value(tot) AS low_freq_E,
      sum(CASE WHEN idx >= 13 AND idx < 26 THEN amp ELSE 0 END) / any_value(tot) AS mid_freq_E, sum(CASE WHEN idx >= 26 THEN amp ELSE 0 END) / any_value(tot) AS high_freq_E, sum(amp) AS total_power,
      max(amp) / (sqrt(avg(amp * amp)) + 1e-15) AS crest_factor FROM s JOIN obs USING (idx) GROUP BY 1 HAVING count(*) = 41),
  f AS (SELECT a.* EXCLUDE (mx, m3, m4), coalesce(pw, 580) AS peak_wl, coalesce(pa, mx) AS peak_amp, CAST(coalesce(np, 0) AS DOUBLE) AS n_peaks, coalesce(ms, 0) AS mean_spacing, coalesce(cv, 0) AS spacing_cv,
      coalesce(lr, 0) AS level_repulsion, m3 / spread ^ 3 AS skewness, m4 / spread ^ 4 AS kurtosis_spec, sqrt((X / (X + Y + Z) - 1.0::DOUBLE / 3) ^ 2 + (Y / (X + Y + Z) - 1.0::DOUBLE / 3) ^ 2) / 0.3 AS purity, 1.0 AS metamer_dim
      FROM a LEFT JOIN pf ON pf.g = a.series_id)""")


@query(with_(*COLOUR, recursive=True) + "SELECT * FROM f", " ".join(colour.FEATURES))
def color_profile(spark, d):
    return colour.color_profile(driver.spectra41(spark, d), colour.observer_table(spark))


@query(with_(*COLOUR, "nxt AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)", recursive=True) +
       "SELECT nxt.a, nxt.b, sqrt((p.X - q.X) ^ 2 + (p.Y - q.Y) ^ 2 + (p.Z - q.Z) ^ 2) AS xyz_distance, sqrt(" + " + ".join(f'(p."{c}" - q."{c}") ^ 2' for c in colour.FEATURES) +
       ") AS feature_distance FROM nxt JOIN f p ON p.series_id = nxt.a JOIN f q ON q.series_id = nxt.b", "xyz_distance feature_distance")
def metamer_comparison(spark, d):
    """Each spectrum against the next one of its label."""
    profile = colour.color_profile(driver.spectra41(spark, d), colour.observer_table(spark))
    pairs = consecutive_pairs(t.table(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id")
    return colour.metamer_comparison(profile, pairs)
