"""Channel quality and vibration profiles."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqlpeaks import peaks_sql
from spectrafold.catalog.sqltext import SERIES, SPARAM, with_
from spectrafold.catalog.waves import DFT
from spectrafold.operators.fourier import amplitude_spectrum
from spectrafold.plans import channel, vibration
from spectrafold.sources import driver, tables as t


def _mm(name, part):
    a, b = channel.PROFILE_MODES[name]
    terms = [f"{left * right}.0 / 2 * max({part}) FILTER (i = {i} AND j = {j})" for i, left in enumerate(channel.MODES[a]) for j, right in enumerate(channel.MODES[b]) if left * right]
    return " + ".join(terms) + f" AS {name}_{part}"


MODES = "mm AS (SELECT meas_id, freq, " + ", ".join(_mm(n, p) for n in channel.PROFILE_MODES for p in ("re", "im")) + " FROM sparam GROUP BY 1, 2)"


@query(with_(SPARAM, MODES) + "SELECT meas_id, freq, " + ", ".join(f"{n}_{p}" for n in channel.PROFILE_MODES for p in ("re", "im")) + " FROM mm",
       "freq " + " ".join(f"{n}_{p}" for n in channel.PROFILE_MODES for p in ("re", "im")))
def mixed_mode_parameters(spark, d):
    return channel.mixed_mode(driver.sparameters(spark, d), channel.PROFILE_MODES)


CHANNEL = (SPARAM, MODES, "mg AS (SELECT meas_id, freq, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY meas_id) AS n, max(freq) OVER (PARTITION BY meas_id) AS fmax, " +
           ", ".join(f"sqrt({m}_re ^ 2 + {m}_im ^ 2) AS {m}" for m in channel.PROFILE_MODES) + ", " +
           ", ".join(f"20 * log10(sqrt({m}_re ^ 2 + {m}_im ^ 2) + 1e-15) AS {m}_db" for m in ("dd21", "dd11", "cc21", "dc21")) +
           ", atan2(dd21_im, dd21_re) AS a FROM mm WINDOW w AS (PARTITION BY meas_id ORDER BY freq))",
           "un AS (SELECT *, a - lag(a) OVER w AS da FROM mg WINDOW w AS (PARTITION BY meas_id ORDER BY pos))",
           "ph AS (SELECT *, sum(CASE WHEN da IS NULL THEN a ELSE da - 2 * pi() * ceil((da - pi()) / (2 * pi())) END) OVER (PARTITION BY meas_id ORDER BY pos) AS phase, first_value(dd21_db) OVER (PARTITION BY meas_id ORDER BY pos) AS ref FROM un)",
           "dl AS (SELECT *, -(phase - lag(phase) OVER w) / (2 * pi() * (freq - lag(freq) OVER w) + 1e-15) AS gd, dd21_db - lag(dd21_db) OVER w AS dil, freq / fmax AS fn FROM ph WINDOW w AS (PARTITION BY meas_id ORDER BY pos))",
           "sd AS (SELECT meas_id AS g, pos, -dd21 AS v, greatest(n // 50, 1) AS spread FROM mg)", "sr AS (SELECT meas_id AS g, pos, dd11 AS v, greatest(n // 50, 1) AS spread FROM mg)",
           peaks_sql("sd", distance="spread", prominence="0.02", prefix="dp"), peaks_sql("sr", distance="spread", prominence="0.01", prefix="rp"),
           """dg AS (SELECT g, freq, dd21_db, freq - lag(freq) OVER (PARTITION BY g ORDER BY dp.pos) AS gap FROM dp JOIN mg ON meas_id = g AND mg.pos = dp.pos),
  nt AS (SELECT g, count(*) AS res, min(freq) AS f1, min(dd21_db) AS worst, stddev_pop(gap) / (avg(gap) + 1e-15) AS rcv FROM dg GROUP BY 1), rl AS (SELECT g, count(*) AS rl FROM rp GROUP BY 1),
  a AS (SELECT meas_id, CAST(any_value(n) AS DOUBLE) AS N_freq, coalesce(min(freq) FILTER (dd21_db < ref - 3), max(freq)) * 1e-9 AS BW_3dB_GHz, coalesce(min(freq) FILTER (dd21_db < ref - 6), max(freq)) * 1e-9 AS BW_6dB_GHz,
      max(-dd21_db) FILTER (pos = n // 2) AS IL_Nyquist_dB, max(dd11_db) FILTER (pos = n // 2) AS RL_Nyquist_dB, max(freq) AS fm, min(dd21_db) AS flo, -avg(dd11_db) AS mean_RL_dB, -min(dd11_db) AS worst_RL_dB, -max(dd11_db) AS min_RL_dB,
      avg(dc21_db) AS mean_Sdc_dB, max(dc21_db) AS worst_Sdc_dB, regr_slope(dc21_db, fn) AS sl, abs(corr(dd21, dc21)) AS ortho_dd_dc, avg(gd) AS gda, stddev_pop(gd) AS gds,
      sqrt((regr_syy(phase, fn) - regr_slope(phase, fn) * regr_sxy(phase, fn)) / count(*)) AS lin, sqrt(avg(dil * dil)) AS ro, avg(abs(dd21 - dd12)) / (avg(dd21) + 1e-15) AS reciprocity, avg(dd21_db - cc21_db) AS CMRR_dB FROM dl GROUP BY 1),
  f AS (SELECT a.* EXCLUDE (fm, flo, sl, gda, gds, lin, ro), CAST(coalesce(res, 0) AS DOUBLE) AS n_resonances, coalesce(f1, fm) * 1e-9 AS f_1st_res_GHz, coalesce(worst, flo) AS worst_notch_dB, CASE WHEN res > 2 THEN rcv ELSE 0 END AS res_spacing_CV,
      CAST(coalesce(rl, 0) AS DOUBLE) AS n_RL_peaks, CASE WHEN N_freq > 10 THEN sl ELSE 0 END AS Sdc_slope, CASE WHEN N_freq > 3 THEN gda * 1e9 ELSE 0 END AS group_delay_ns, CASE WHEN N_freq > 3 THEN gds / (abs(gda) + 1e-15) ELSE 0 END AS GD_variation,
      CASE WHEN N_freq > 5 THEN lin ELSE 0 END AS phase_nonlin, CASE WHEN N_freq > 10 THEN ro ELSE 0 END AS roughness, BW_3dB_GHz * (1 - IL_Nyquist_dB / 30) AS FoM, 10 - IL_Nyquist_dB AS IL_margin, mean_RL_dB - 10 AS RL_margin, -20 - worst_Sdc_dB AS MC_margin
      FROM a LEFT JOIN nt ON nt.g = meas_id LEFT JOIN rl ON rl.g = meas_id)""")


@query(with_(*CHANNEL, recursive=True) + """SELECT *, CASE WHEN n_resonances = 0 THEN 1.0 ELSE 0.0 END AS clean_flag, CASE WHEN worst_Sdc_dB < -25 THEN 1.0 ELSE 0.0 END AS low_conv_flag,
  CASE WHEN IL_margin > 0 AND RL_margin > 0 AND MC_margin > 0 THEN 1.0 ELSE 0.0 END AS PASS, CASE WHEN IL_margin > 3 AND RL_margin > 3 AND MC_margin > 5 AND n_resonances = 0 THEN 'PASS' WHEN IL_margin > 0 AND RL_margin > 0 AND MC_margin > 0 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM f""",
       " ".join(channel.FEATURES) + " min_RL_dB")
def channel_profile(spark, d):
    return channel.channel_profile(driver.sparameters(spark, d), length=64).drop("reason")


@query(with_(SPARAM, MODES, "g AS (SELECT meas_id, sqrt(dd21_re ^ 2 + dd21_im ^ 2) AS dd, sqrt(cc21_re ^ 2 + cc21_im ^ 2) AS cc, sqrt(dc21_re ^ 2 + dc21_im ^ 2) AS dc FROM mm)",
             "c AS (SELECT meas_id, abs(corr(dd, cc)) AS dd_cc, abs(corr(dd, dc)) AS dd_dc, abs(corr(cc, dc)) AS cc_dc FROM g GROUP BY 1)") +
       "SELECT *, CASE WHEN dd_dc < 0.3 THEN 'ORTHOGONAL' WHEN dd_dc > 0.7 THEN 'COUPLED' ELSE 'PARTIAL' END AS kind FROM c", "dd_cc dd_dc cc_dc")
def mode_coupling(spark, d):
    return channel.coupling_table(driver.sparameters(spark, d))


VIB = (SERIES, DFT, "sp AS (SELECT series_id, bin, CAST(bin AS DOUBLE) AS freq, 2 * sqrt(re * re + im * im) / 64 AS amp FROM bins)",
       "meta AS (SELECT vec_id AS series_id, 3.0::DOUBLE + 2 * label AS rot FROM embeddings)",
       "src AS (SELECT series_id AS g, bin AS pos, amp AS v, rot, avg(amp) OVER (PARTITION BY series_id) AS mean FROM sp JOIN meta USING (series_id))",
       peaks_sql("src", "3 * mean", "greatest(floor(rot * 0.3), 1)"), """
  st AS (SELECT series_id, rot, avg(amp) AS mean_spec, stddev_pop(amp) AS std_spec, max(amp) AS max_spec, sum(amp * amp) AS e, sum(freq * amp * amp) / sum(amp * amp) AS centroid_Hz, kurtosis_pop(amp) AS kurtosis, max(amp) / (sqrt(avg(amp * amp)) + 1e-15) AS crest,
      """ + ", ".join(f"coalesce(max(amp) FILTER (floor({o} * rot) > 0 AND floor({o} * rot) < 32 AND abs(bin - floor({o} * rot)) <= 3), 0) AS a{n}" for n, o in (("h", 0.5), ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5))) + """,
      sum(CASE WHEN bin <= 5 * rot THEN amp * amp ELSE 0 END) AS low FROM sp JOIN meta USING (series_id) GROUP BY 1, 2),
  s2 AS (SELECT series_id, sum((freq - centroid_Hz) ^ 2 * amp * amp) / any_value(e) AS var FROM sp JOIN st USING (series_id) GROUP BY 1),
  pj AS (SELECT pk.g, pk.pos, pk.v, rot, abs(pk.pos - round_even(pk.pos / rot, 0) * rot) < 0.05 * rot AS sync, row_number() OVER (PARTITION BY pk.g ORDER BY pk.v DESC, pk.pos DESC) AS rn, count(*) OVER (PARTITION BY pk.g) AS np FROM pk JOIN meta ON series_id = pk.g),
  pc AS (SELECT g, count(*) AS np, sum(CASE WHEN sync THEN 1.0 ELSE 0 END) AS sy, sum(CASE WHEN sync THEN 0 ELSE 1.0 END) AS ns, sum(CASE WHEN sync THEN 0 ELSE v * v END) AS ne FROM pj GROUP BY 1),
  sb0 AS (SELECT g, rn, s, v, trunc(pos + s * rot) AS loc FROM pj, (SELECT unnest([-1, 1]) AS s) x WHERE rn <= 5 AND np > 1),
  sb1 AS (SELECT g, rn, s, any_value(v) AS v, max(amp) AS a FROM sb0 JOIN sp ON series_id = g AND abs(bin - loc) <= 3 WHERE loc > 0 AND loc < 32 GROUP BY 1, 2, 3),
  sb AS (SELECT g, sum(CASE WHEN a > 0.3 * v THEN 1.0 ELSE 0 END) AS sb FROM sb1 GROUP BY 1),
  hd AS (SELECT series_id, regr_slope(ln(a + 1e-15), ln(i)) AS sl, count(*) AS c FROM (SELECT series_id, unnest(list_filter([a1, a2, a3, a4, a5], lambda x: x > 1e-10)) AS a, unnest(range(1, len(list_filter([a1, a2, a3, a4, a5], lambda x: x > 1e-10)) + 1)) AS i FROM st) q GROUP BY 1),
  f AS (SELECT series_id, a1 AS A_1x, a2 AS A_2x, a3 AS A_3x, ah AS A_half, a4 + a5 AS A_45x, CASE WHEN c > 2 THEN sl ELSE -2 END AS harm_decay, coalesce(sy, 0) AS sync_peaks, coalesce(ns, 0) AS nonsync_peaks, coalesce(sb, 0) AS sidebands, coalesce(ne, 0) AS nonsync_E,
      a2 / (a1 + 1e-15) AS ratio_2x_1x, ah / (a1 + 1e-15) AS ratio_half_1x, coalesce(ne, 0) / e AS ratio_nonsync, sqrt(e) AS overall_g, centroid_Hz, sqrt(var) AS spread_Hz, kurtosis, crest, low / e AS E_ratio_5x, CAST(coalesce(np, 0) AS DOUBLE) AS n_peaks, mean_spec, std_spec, max_spec,
      sqrt(e) * 1000 / (2 * pi() * centroid_Hz) AS vel_mm_s, CASE WHEN coalesce(ns, 0) > 2 THEN 1.0 ELSE 0.0 END AS bearing_flag, CASE WHEN coalesce(sb, 0) > 2 THEN 1.0 ELSE 0.0 END AS gear_flag, a1 / (sqrt(e) + 1e-15) AS dominance_1x, (a2 + a3) / (a1 + 1e-15) AS harmonic_content, sqrt(e) / (a1 + 1e-15) AS broadband_ratio
      FROM st JOIN s2 USING (series_id) LEFT JOIN hd USING (series_id) LEFT JOIN pc ON pc.g = series_id LEFT JOIN sb ON sb.g = series_id)""")


@query(with_(*VIB, recursive=True) + """SELECT *, CASE WHEN overall_g > 2 THEN 'HIGH' WHEN overall_g > 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN overall_g < 0.4 AND nonsync_peaks < 2 THEN 'NORMAL' WHEN dominance_1x > 0.7 AND ratio_2x_1x < 0.5 AND ratio_half_1x < 0.2 THEN 'UNBALANCE' WHEN ratio_2x_1x > 1 THEN 'MISALIGNMENT' WHEN ratio_half_1x > 0.3 AND harm_decay > -1 THEN 'LOOSENESS'
    WHEN nonsync_peaks > 2 AND sidebands > 0 AND centroid_Hz > 500 THEN 'BEARING_INNER' WHEN nonsync_peaks > 2 AND sidebands > 0 THEN 'BEARING_OUTER' WHEN nonsync_peaks > 1 THEN 'BEARING_EARLY' WHEN sidebands > 3 AND centroid_Hz > 1000 THEN 'GEAR_MESH'
    WHEN harm_decay > -1 AND broadband_ratio > 3 THEN 'LOOSENESS' WHEN ratio_2x_1x > 0.5 THEN 'MISALIGNMENT_MILD' ELSE 'UNKNOWN' END AS verdict FROM f""", " ".join(vibration.FEATURES))
def vibration_profile(spark, d):
    spectrum = amplitude_spectrum(driver.embedding_series(spark, d), ["series_id"], "pos", "value", 64, 64.0)
    meta = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("series_id"), ((3 + 2 * F.col("label")) * 60.0).alias("rpm"))
    return vibration.vibration_profile(spectrum, meta, length=33).drop("reason")
