"""Wavelet and Fourier transforms and the profiles built on them."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import IMAGES, SERIES, VOLUMES, with_
from spectrafold.operators import fourier, wavelet
from spectrafold.plans import cascade, image, volume
from spectrafold.sources import driver

Z = """z AS (SELECT series_id, pos, (value - avg(value) OVER g) / stddev_pop(value) OVER g AS value FROM series
    WINDOW g AS (PARTITION BY series_id))"""
HAAR = """coefs(series_id, level, pos, coef) AS (SELECT series_id, l AS level, pos // CAST(2 ^ l AS BIGINT) AS at_pos,
    sum(value * CASE WHEN (pos // CAST(2 ^ (l - 1) AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END / 2 ^ (l / 2.0)) AS coef
    FROM {src}, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS l) v GROUP BY ALL
  UNION ALL SELECT series_id, 0, 0, sum(value) / 8 FROM {src} GROUP BY 1)"""


@query(with_(SERIES, HAAR.format(src="series")) + "SELECT series_id, level, pos, coef FROM coefs", "coef")
def wavelet_coefficients(spark, d):
    return wavelet.haar_1d(driver.embedding_series(spark, d), 6)


CASCADE = (SERIES, Z, HAAR.format(src="z"), """s AS (SELECT series_id, level, count(*) AS n, sum(coef * coef) AS e,
    CASE WHEN count(*) < 4 OR stddev_pop(coef) < 1e-15 THEN 0 ELSE kurtosis_pop(coef) END AS kurt FROM coefs GROUP BY 1, 2),
  ent AS (SELECT series_id, level, -sum(CASE WHEN coef <> 0 THEN coef * coef / e * ln(coef * coef / e) ELSE 0 END) AS ent
    FROM coefs JOIN s USING (series_id, level) GROUP BY 1, 2),
  sc AS (SELECT *, ln(e + 1e-30) AS loge, level - 1.0::DOUBLE AS j, lag(e) OVER (PARTITION BY series_id ORDER BY level) AS prev
    FROM s JOIN ent USING (series_id, level) WHERE level > 0),
  agg AS (SELECT series_id, sum(e) AS det, regr_slope(loge, j) AS slope,
      sqrt(greatest(regr_syy(loge, j) - regr_slope(loge, j) * regr_sxy(loge, j), 0) / count(*)) AS resid,
      sum(e * level) / (sum(e) + 1e-30) AS cen, avg(e / prev) AS cm, stddev_pop(e / prev) AS cs,
      sum(CASE WHEN abs(e / prev - 2 ^ (5.0 / 3)) / 2 ^ (5.0 / 3) < 0.5 THEN 1.0 ELSE 0.0 END) AS inertial,
      avg(kurt) AS km, max(kurt) AS kx, regr_slope(kurt, j) AS kg, min_by(kurt, level) AS kf, max_by(kurt, level) AS kc,
      avg(ent) AS em, max(ent) AS ex, stddev_pop(ent) AS es, corr(prev, e) AS ac, exp(avg(loge)) / (avg(e) + 1e-30) AS flat,
      count(*) AS scales FROM sc GROUP BY 1),
  spr AS (SELECT series_id, sqrt(sum(e * (level - cen) ^ 2) / sum(e)) AS spread FROM sc JOIN agg USING (series_id) GROUP BY 1),
  mc AS (SELECT series_id, avg(r) AS magcorr FROM (SELECT a.series_id, a.level, abs(corr(abs(a.coef), abs(b.coef))) AS r, count(*) AS n
      FROM coefs a JOIN coefs b ON a.series_id = b.series_id AND b.level = a.level + 1 AND a.pos = 2 * b.pos
      WHERE a.level > 0 GROUP BY 1, 2) q WHERE n > 2 GROUP BY 1),
  lim AS (SELECT series_id, level, CASE WHEN max(abs(coef)) = min(abs(coef)) THEN min(abs(coef)) - 0.5 ELSE min(abs(coef)) END AS lo,
      CASE WHEN max(abs(coef)) = min(abs(coef)) THEN 1.0 ELSE max(abs(coef)) - min(abs(coef)) END AS span FROM coefs WHERE level > 0 GROUP BY 1, 2),
  h AS (SELECT series_id, level, least(floor((abs(coef) - lo) / span * 20), 19) AS bin, count(*) AS n FROM coefs JOIN lim USING (series_id, level)
      GROUP BY 1, 2, 3),
  hn AS (SELECT series_id, level, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1, 2),
  ss AS (SELECT series_id, avg(cosine) AS selfsim FROM (SELECT x.series_id, x.level, coalesce(d.dot, 0) / (x.norm * y.norm) AS cosine
      FROM hn x JOIN hn y ON x.series_id = y.series_id AND y.level = x.level + 1
      LEFT JOIN (SELECT a.series_id, a.level, sum(a.n * b.n) AS dot FROM h a JOIN h b ON a.series_id = b.series_id AND b.level = a.level + 1 AND a.bin = b.bin
        GROUP BY 1, 2) d ON d.series_id = x.series_id AND d.level = x.level) q GROUP BY 1),
  f AS (SELECT series_id, det + ap.e AS total_energy, ap.e / (det + ap.e) AS approx_energy_ratio, det / (det + ap.e) AS detail_energy_ratio,
      slope AS energy_slope, resid AS energy_slope_residual, cen AS energy_centroid, spread AS energy_spread, cm AS cascade_ratio_mean,
      cs AS cascade_ratio_std, abs(cm - 2 ^ (5.0 / 3)) / 2 ^ (5.0 / 3) AS k41_deviation, cs / (cm + 1e-15) AS energy_flux_constancy,
      inertial AS inertial_range_width, km AS kurtosis_mean, kx AS kurtosis_max, kg AS kurtosis_growth_rate, kf AS kurtosis_at_fine,
      kc AS kurtosis_at_coarse, em AS entropy_mean, ex AS entropy_max, es AS entropy_spread, magcorr AS magnitude_correlation,
      ac AS energy_autocorrelation, selfsim AS self_similarity, flat AS spectral_flatness, CAST(scales AS DOUBLE) AS n_scales,
      1.0::DOUBLE AS total_variance FROM agg JOIN spr USING (series_id) JOIN mc USING (series_id) JOIN ss USING (series_id)
      JOIN (SELECT series_id, e FROM s WHERE level = 0) ap USING (series_id))""")

CASCADE_SELECT = """SELECT *, CASE WHEN kurtosis_max < 0.5 AND energy_slope_residual < 0.5 THEN 1.0 ELSE 0.0 END AS is_laminar,
  CASE WHEN approx_energy_ratio > 0.3 AND kurtosis_max < 5 AND energy_slope > 0 THEN 1.0 ELSE 0.0 END AS is_kolmogorov,
  CASE WHEN kurtosis_max > 5 THEN 1.0 ELSE 0.0 END AS is_intermittent,
  CASE WHEN kurtosis_max > 5 THEN 'INTERMITTENT' WHEN kurtosis_max < 0.5 AND energy_slope_residual > 0.5 THEN 'TONAL'
    WHEN kurtosis_max < 0.5 THEN 'LAMINAR' WHEN energy_slope < -0.3 THEN 'BROADBAND' WHEN approx_energy_ratio > 0.3 THEN 'KOLMOGOROV'
    ELSE 'BROADBAND' END AS verdict, 'ok' AS status FROM f"""


@query(with_(*CASCADE) + CASCADE_SELECT, " ".join(cascade.FEATURES))
def cascade_profile(spark, d):
    return cascade.cascade_profile(driver.embedding_series(spark, d)).drop("reason")


VOLUME = (VOLUMES, """wide AS (SELECT vol_id, CAST(l AS INTEGER) AS level, x // CAST(2 ^ l AS BIGINT) AS x, y // CAST(2 ^ l AS BIGINT) AS y, z // CAST(2 ^ l AS BIGINT) AS z, """ + ", ".join(
    "sum(v" + "".join(
        f" * (CASE WHEN ({axis} // CAST(2 ^ (l - 1) AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END)" for axis, kind in zip("xyz", band) if kind == "H"
    ) + f" / 2 ^ (1.5 * l)) AS {band}" for band in wavelet.BANDS) + """
    FROM volume, (SELECT unnest(range(1, 4)) AS l) q GROUP BY 1, 2, 3, 4, 5),
  coefs AS (SELECT * FROM (UNPIVOT wide ON LLL, LLH, LHL, LHH, HLL, HLH, HHL, HHH INTO NAME band VALUE coef) u WHERE band <> 'LLL' OR level = 3),
  b1 AS (SELECT vol_id, level, band, sum(coef * coef) AS e, CASE WHEN count(*) < 4 OR stddev_pop(coef) < 1e-15 THEN 0 ELSE kurtosis_pop(coef) END AS kurt,
      max(abs(coef)) AS peak FROM coefs GROUP BY 1, 2, 3),
  bands AS (SELECT vol_id, level, band, any_value(e) AS e, any_value(kurt) AS kurt,
      CASE WHEN any_value(e) < 1e-30 THEN 0 ELSE -sum(CASE WHEN coef <> 0 THEN coef * coef / e * ln(coef * coef / e) ELSE 0 END) END AS ent,
      CASE WHEN any_value(peak) < 1e-15 THEN 1.0 ELSE avg(CASE WHEN abs(coef) < 0.01 * peak THEN 1.0 ELSE 0.0 END) END AS sparsity
      FROM coefs JOIN b1 USING (vol_id, level, band) GROUP BY 1, 2, 3)""")


@query(with_(*VOLUME) + "SELECT vol_id, level, band, e AS energy, kurt, ent, sparsity FROM bands", "energy kurt ent sparsity")
def volume_bands(spark, d):
    return volume.band_statistics(wavelet.haar_3d(driver.volumes(spark, d), 3)).withColumnRenamed("e", "energy")


@query(with_(*VOLUME, """lv AS (SELECT vol_id, level, sum(e) AS e, stddev_pop(e) / (avg(e) + 1e-15) AS aniso, sum(CASE WHEN band IN ('LLH','LHL','HLL') THEN e ELSE 0 END) AS edge,
      sum(CASE WHEN band IN ('LHH','HLH','HHL') THEN e ELSE 0 END) AS crs, sum(CASE WHEN band = 'HHH' THEN e ELSE 0 END) AS corner
      FROM bands WHERE band <> 'LLL' GROUP BY 1, 2),
  sh AS (SELECT vol_id, sum(e) AS det, regr_slope(ln(e + 1e-30), level) AS energy_decay_slope,
      max(CASE WHEN level = 1 THEN e END) AS e1, max(CASE WHEN level = 2 THEN e END) AS e2, max(CASE WHEN level = 3 THEN e END) AS e3,
      max(CASE WHEN level = 1 THEN aniso END) AS a1, max(CASE WHEN level = 2 THEN aniso END) AS a2, max(CASE WHEN level = 3 THEN aniso END) AS a3,
      max(CASE WHEN level = 1 THEN edge / e END) AS ef, max(CASE WHEN level = 1 THEN crs / e END) AS cf, max(CASE WHEN level = 1 THEN corner / e END) AS of FROM lv GROUP BY 1),
  sp AS (SELECT vol_id, avg(kurt) AS mean_kurtosis, max(kurt) AS max_kurtosis, stddev_pop(kurt) AS kurtosis_spread, avg(ent) AS mean_entropy,
      max(ent) AS max_entropy, stddev_pop(ent) AS entropy_spread, avg(sparsity) AS mean_sparsity, stddev_pop(sparsity) AS sparsity_spread FROM bands WHERE band <> 'LLL' GROUP BY 1),
  sm AS (SELECT vol_id, avg(r) AS sim FROM (SELECT a.vol_id, a.level, corr(a.e, b.e) AS r FROM bands a JOIN bands b ON a.vol_id = b.vol_id AND a.band = b.band
      AND b.level = a.level + 1 WHERE a.band <> 'LLL' GROUP BY 1, 2) q GROUP BY 1),
  f AS (SELECT vol_id, det + ap AS total_energy, ap / (det + ap) AS approx_energy_ratio, det / (det + ap) AS detail_energy_ratio, energy_decay_slope,
      e1 AS level_1_energy, e2 AS level_2_energy, e3 AS level_3_energy, sp.* EXCLUDE (vol_id), a1 AS anisotropy_L1, a2 AS anisotropy_L2, a3 AS anisotropy_L3,
      ef AS edge_fraction, cf AS cross_fraction, of AS corner_fraction, (e1 + 2 * e2 + 3 * e3) / (e1 + e2 + e3) AS spectral_centroid,
      sqrt((e1 * (1 - spectral_centroid) ^ 2 + e2 * (2 - spectral_centroid) ^ 2 + e3 * (3 - spectral_centroid) ^ 2) / (e1 + e2 + e3)) AS spectral_spread,
      sim AS scale_self_similarity, (e1 + e2) / (e3 + 1e-15) AS structure_ratio
      FROM sh JOIN sp USING (vol_id) JOIN sm USING (vol_id) JOIN (SELECT vol_id, e AS ap FROM bands WHERE band = 'LLL') l USING (vol_id))""") +
       """SELECT *, CASE WHEN detail_energy_ratio > 0.05 AND max_kurtosis > 1 THEN 1.0 ELSE 0.0 END AS is_structured,
  CASE WHEN anisotropy_L1 < 0.5 AND anisotropy_L2 < 0.5 AND anisotropy_L3 < 0.5 THEN 1.0 ELSE 0.0 END AS is_isotropic,
  CASE WHEN spectral_spread > 0.3 AND scale_self_similarity > 0.3 THEN 1.0 ELSE 0.0 END AS is_multiscale,
  CASE WHEN mean_sparsity < 0.5 AND mean_kurtosis < 1 AND anisotropy_L1 < 0.3 THEN 1.0 ELSE 0.0 END AS is_noisy,
  CASE WHEN detail_energy_ratio > 0.8 AND mean_kurtosis < 1 AND mean_sparsity < 0.3 THEN 'NOISY' WHEN detail_energy_ratio < 0.05 THEN 'UNIFORM'
    WHEN max_kurtosis > 1 AND spectral_spread > 0.3 AND mean_sparsity > 0.3 AND (scale_self_similarity < 0.6 OR abs(ln(structure_ratio + 1e-15)) > 0.5) THEN 'MULTI_SCALE'
    WHEN max_kurtosis > 1 AND mean_sparsity <> 0.3 THEN 'STRUCTURED' ELSE 'UNIFORM' END AS verdict FROM f""", " ".join(volume.FEATURES))
def volume_profile(spark, d):
    return volume.volume_profile(driver.volumes(spark, d)).drop("reason")


DFT = """bins AS (SELECT series_id, CAST(b AS INTEGER) AS bin, sum(value * cos(2 * pi() * ((pos * b) % 64) / 64)) AS re,
    -sum(value * sin(2 * pi() * ((pos * b) % 64) / 64)) AS im FROM series, (SELECT unnest(range(33)) AS b) v GROUP BY 1, 2)"""


@query(with_(SERIES, DFT) + "SELECT series_id, bin, CAST(bin AS DOUBLE) AS freq, 2 * sqrt(re * re + im * im) / 64 AS amp FROM bins", "freq amp")
def amplitude_spectrum(spark, d):
    return fourier.amplitude_spectrum(driver.embedding_series(spark, d), ["series_id"], "pos", "value", 64, 64.0)


@query(with_(SERIES, DFT) + "SELECT series_id, bin, re, im FROM bins WHERE bin IN (4, 8, 12)", "re im")
def harmonic_bins(spark, d):
    bins = F.array(*[F.lit(b) for b in (4, 8, 12)])
    return fourier.dft_bins(driver.embedding_series(spark, d), ["series_id"], "pos", "value", 64, bins)


def _power(keys, n, src):
    return f"""(SELECT {keys}, (ky + {n // 2}) % {n} - {n // 2} AS fy, (kx + {n // 2}) % {n} - {n // 2} AS fx,
    CASE WHEN kx = 0 AND ky = 0 THEN 0 ELSE sum(v * cos(2 * pi() * ((y * ky + x * kx) % {n}) / {n})) ^ 2 + sum(v * sin(2 * pi() * ((y * ky + x * kx) % {n}) / {n})) ^ 2 END AS power
    FROM {src}, (SELECT unnest(range({n})) AS kx) a, (SELECT unnest(range({n})) AS ky) b GROUP BY {keys}, kx, ky)"""


IMAGE = (IMAGES, f"p AS {_power('img_id', 16, 'image')}", """rings AS (SELECT img_id, floor(sqrt(fy * fy + fx * fx)) AS r, avg(power) AS p FROM p GROUP BY 1, 2 HAVING r >= 1 AND r < 8),
  sec AS (SELECT img_id, floor((atan2(fy, fx) + pi()) / (pi() / 4) + 1e-9) AS s, sum(power) AS p FROM p WHERE fy * fy + fx * fx > 1 GROUP BY 1, 2 HAVING s < 8)""")


@query(with_(*IMAGE) + "SELECT img_id, CAST(r AS INTEGER) AS radius, p AS power FROM rings", "power")
def radial_power(spark, d):
    return fourier.radial_profile(fourier.power_2d(driver.images(spark, d), ["img_id"], 16, 16), ["img_id"], 16, 16)


@query(with_(*IMAGE) + "SELECT img_id, CAST(s AS INTEGER) AS sector, p AS power FROM sec", "power")
def angular_power(spark, d):
    return fourier.angular_sectors(fourier.power_2d(driver.images(spark, d), ["img_id"], 16, 16), ["img_id"])


@query(with_(*IMAGE, """rr AS (SELECT *, lag(p) OVER w AS pv, lead(p) OVER w AS nx, sum(p) OVER (PARTITION BY img_id ORDER BY r) AS cum, sum(p) OVER (PARTITION BY img_id) AS tot,
      median(p) OVER (PARTITION BY img_id) AS med FROM rings WINDOW w AS (PARTITION BY img_id ORDER BY r)),
  pk AS (SELECT *, ln(p) AS lp, ln(r) AS lr, p > pv AND p > nx AND p > 2 * med AS peak FROM rr),
  a AS (SELECT img_id, regr_slope(lp, lr) AS spectral_slope, sqrt(greatest(regr_syy(lp, lr) - regr_slope(lp, lr) * regr_sxy(lp, lr), 0) / count(*)) AS slope_residual,
      regr_slope(CASE WHEN r <= 2 THEN lp END, lr) AS slope_low, regr_slope(CASE WHEN r >= 6 THEN lp END, lr) AS slope_high, sum(p) AS energy_total,
      sum(CASE WHEN r <= 2 THEN p ELSE 0 END) AS energy_low, sum(CASE WHEN r > 2 AND r <= 4 THEN p ELSE 0 END) AS energy_mid, sum(CASE WHEN r > 4 THEN p ELSE 0 END) AS energy_high,
      sum(CASE WHEN peak THEN 1.0 ELSE 0.0 END) AS n_peaks, coalesce(arg_max(r, p) FILTER (peak), 0) AS peak_freq_1, coalesce(max(p / med) FILTER (peak), 0) AS peak_prominence_1,
      coalesce(stddev_pop(r) FILTER (peak), 0) AS peak_spread, sum(p * r) / sum(p) AS spectral_centroid, exp(avg(lp)) / (avg(p) + 1e-30) AS spectral_flatness,
      min(CASE WHEN cum >= 0.85 * tot THEN r END) AS spectral_rolloff FROM pk GROUP BY 1),
  sp AS (SELECT img_id, sqrt(sum(p * (r - spectral_centroid) ^ 2) / sum(p)) AS spectral_spread FROM rings JOIN a USING (img_id) GROUP BY 1),
  sf AS (SELECT img_id, 1 - (max(p) - min(p)) / (max(p) + min(p) + 1e-30) AS isotropy_index, least(max(p) / (min(p) + 1e-30), 1e6) AS anisotropy_ratio,
      arg_max(s, p) AS dominant_angle_sector FROM sec GROUP BY 1),
  se AS (SELECT img_id, -sum(p / t * ln(p / t)) AS angular_entropy FROM sec JOIN (SELECT img_id, sum(p) AS t FROM sec GROUP BY 1) x USING (img_id) GROUP BY 1),
  f AS (SELECT a.*, energy_low / (energy_high + 1e-30) AS band_ratio_lh, spectral_spread, isotropy_index, anisotropy_ratio, dominant_angle_sector, angular_entropy,
      energy_high / energy_total AS roughness, 1 / (1 + slope_residual) AS regularity, n_peaks * spectral_spread / 7 AS complexity
      FROM a JOIN sp USING (img_id) JOIN sf USING (img_id) JOIN se USING (img_id))""") +
       """SELECT *, CASE WHEN spectral_slope > -3 AND spectral_slope < -1 AND n_peaks < 3 AND isotropy_index > 0.6 THEN 1.0 ELSE 0.0 END AS is_natural,
  CASE WHEN n_peaks >= 2 OR abs(spectral_slope) < 0.5 THEN 1.0 ELSE 0.0 END AS is_synthetic, CASE WHEN abs(spectral_slope) < 0.5 AND spectral_flatness > 0.3 THEN 1.0 ELSE 0.0 END AS is_noisy,
  CASE WHEN n_peaks >= 2 AND peak_prominence_1 > 5 THEN 1.0 ELSE 0.0 END AS is_periodic, 0.0 AS is_forged,
  CASE WHEN abs(spectral_slope) < 0.8 AND spectral_flatness > 0.15 THEN 'NOISY' WHEN anisotropy_ratio > 3 AND isotropy_index < 0.3 AND spectral_slope < -2.5 THEN 'EDGE'
    WHEN n_peaks >= 2 AND peak_prominence_1 > 3 THEN 'TEXTURED' WHEN anisotropy_ratio > 3 AND isotropy_index < 0.3 THEN 'TEXTURED'
    WHEN spectral_slope > -3.5 AND spectral_slope < -0.8 AND n_peaks < 3 THEN 'NATURAL' ELSE 'SYNTHETIC' END AS verdict FROM f""", " ".join(image.FEATURES))
def image_profile(spark, d):
    return image.image_profile(driver.images(spark, d), 16, 16).drop("reason")


@query(with_(*IMAGE, """tile AS (SELECT img_id, y // 8 AS tr, x // 8 AS tc, y % 8 AS y, x % 8 AS x, v FROM image)""",
             f"tp AS {_power('img_id, tr, tc', 8, 'tile')}",
             """tr_ AS (SELECT img_id, tr, tc, floor(sqrt(fy * fy + fx * fx)) AS r, avg(power) AS p FROM tp GROUP BY 1, 2, 3, 4 HAVING r >= 1 AND r < 4),
  ts AS (SELECT img_id, tr, tc, regr_slope(ln(p), ln(r)) AS slope FROM tr_ GROUP BY ALL),
  g AS (SELECT img_id, regr_slope(ln(p), ln(r)) AS gs FROM rings GROUP BY 1),
  q AS (SELECT img_id, tr, tc, abs(slope - gs) AS gap, row_number() OVER (PARTITION BY img_id ORDER BY abs(slope - gs) DESC, tr, tc) AS rn FROM ts JOIN g USING (img_id)
    JOIN (SELECT img_id, tr, tc FROM tile GROUP BY ALL HAVING count(*) = 64) c USING (img_id, tr, tc))""") +
       "SELECT img_id, gap AS anomaly, CAST(tr * 8 AS INTEGER) AS row, CAST(tc * 8 AS INTEGER) AS col, gap > 1.5 AS flagged FROM q WHERE rn = 1", "anomaly")
def image_block_anomaly(spark, d):
    return image.block_anomaly(driver.images(spark, d), 16, 16, 8)
