"""Dispersion profile of one- and two-atom chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.functions.fixed import EPS
from spectrafold.functions.scalar import flag, neighbour_ratio

FEATURES = (
    "band_gap omega_max omega_mean n_branches acoustic_BW mean_BW std_BW v_sound v_group_max v_group_mean DOS_max DOS_entropy "
    "einstein_ind optical_flat spacing_mean spacing_CV level_repulsion mass_ratio spring_ratio atoms_per_cell kappa_proxy "
    "debye_T_proxy impedance norm_gap n_dispersive is_insulator has_flat high_v regular"
).split()


def chain_bands(cells: DataFrame, n_q: int = 50) -> DataFrame:
    """(mat_id, q_idx, q, branch, omega) from (mat_id, masses, springs), closed form for one or two atoms.

    One atom has no wrap-around coupling, so its band is flat in q.
    """
    step = math.pi / (n_q - 1)
    rows = cells.withColumn("q_idx", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("q", F.col("q_idx") * F.lit(step))
    m, k = F.col("masses"), F.col("springs")
    k0 = k[0]
    k1 = F.when(F.size(k) > 1, F.get(k, F.lit(1))).otherwise(k0)
    m0, m1 = m[0], F.get(m, F.lit(1))
    a, d = (k0 + k1) / m0, (k0 + k1) / m1
    coupling = (k0 * k0 + k1 * k1 + 2 * k0 * k1 * F.cos("q")) / (m0 * m1)
    centre, root = (a + d) / 2, F.sqrt(F.greatest(((a - d) / 2) ** 2 + coupling, F.lit(0.0)))
    omega = lambda square: F.sqrt(F.greatest(square, F.lit(0.0)))
    branches = F.when(F.size(m) == 1, F.array(omega(a))).otherwise(F.array(omega(centre - root), omega(centre + root)))
    return rows.select("mat_id", "q_idx", "q", F.posexplode(branches).alias("branch", "omega"))


def _extremes(values: Column) -> tuple[Column, Column]:
    return F.array_max(values), F.array_min(values)


def dispersion_profile(bands: DataFrame, cells: DataFrame, bins: int = 30) -> DataFrame:
    """One row per mat_id; bands hold a fixed number of q points and branches per material."""
    along = W.partitionBy("mat_id", "branch").orderBy("q_idx")
    rows = bands.select(
        "*", F.lag("omega").over(along).alias("_a"), F.lead("omega").over(along).alias("_b"), F.lead("q").over(along).alias("_qb"),
    )
    per_branch = rows.groupBy("mat_id", "branch").agg(
        F.max("omega").alias("hi"), F.min("omega").alias("lo"), F.count("*").alias("nq"),
        F.max(F.when(F.col("q_idx") == 0, F.col("omega"))).alias("w0"), F.max(F.when(F.col("q_idx") == 1, F.col("omega"))).alias("w1"),
        F.max(F.when(F.col("q_idx") == 0, F.col("_qb") - F.col("q"))).alias("dq"),
        F.sum(F.abs(F.when(F.col("_a").isNull(), F.col("_b") - F.col("omega")).when(F.col("_b").isNull(), F.col("omega") - F.col("_a"))
                    .otherwise((F.col("_b") - F.col("_a")) / 2))).alias("_rise"),
    )
    per_branch = per_branch.withColumn("vg", F.col("_rise") / F.col("nq") / F.col("dq")).withColumn("bw", F.col("hi") - F.col("lo"))
    acoustic = lambda x: F.max(F.when(F.col("branch") == 0, x))
    material = per_branch.groupBy("mat_id").agg(
        F.count("*").cast("double").alias("n_branches"), acoustic(F.col("bw")).alias("acoustic_BW"), F.avg("bw").alias("mean_BW"),
        F.stddev_pop("bw").alias("std_BW"), F.max("vg").alias("v_group_max"), F.avg("vg").alias("v_group_mean"),
        acoustic(F.col("hi")).alias("_hi0"), F.max(F.when(F.col("branch") == 1, F.col("lo"))).alias("_lo1"),
        acoustic(F.when((F.col("nq") > 5) & (F.col("w0") < F.col("w1")), (F.col("w1") - F.col("w0")) / F.col("dq"))).alias("_vs"),
        F.sum(F.when(F.col("branch") > 0, F.col("bw"))).alias("_obw"), F.max("hi").alias("_top"),
        F.collect_list("bw").alias("_bws"),
    )
    live = bands.where("omega > 1e-10").select("mat_id", "omega")
    order, whole = W.partitionBy("mat_id").orderBy("omega"), W.partitionBy("mat_id")
    spaced = live.select(
        "mat_id", "omega", (F.col("omega") - F.lag("omega").over(order)).alias("s"), F.min("omega").over(whole).alias("_lo"),
        F.max("omega").over(whole).alias("_hi"),
    )
    flat = F.col("_hi") == F.col("_lo")
    low = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    span = F.when(flat, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    binned = spaced.withColumn("_bin", F.least(F.floor((F.col("omega") - low) / span * bins), F.lit(bins - 1))).withColumn("_span", span)
    cells_ = binned.groupBy("mat_id", "_bin").agg(F.count("*").alias("n"), F.first("_span").alias("_span"), F.sum("omega").alias("_sum"))
    total = cells_.groupBy("mat_id").agg(F.sum("n").alias("_t"))
    share = F.col("n") / F.col("_t")
    dos = cells_.join(total, "mat_id").groupBy("mat_id").agg(
        F.max(F.col("n") / (F.col("_t") * (F.col("_span") / bins))).alias("DOS_max"), F.first("_t").alias("_t"), F.sum("_sum").alias("_sum"),
        (-F.sum(share * F.ln(share + F.lit(EPS)))).alias("DOS_entropy"), F.first("_span").alias("_span"),
    )
    steps = spaced.where("s > 1e-10").select("mat_id", "s", F.lead("s").over(order).alias("_next"))
    gaps = steps.groupBy("mat_id").agg(
        F.count("*").alias("_ns"), F.avg("s").alias("_sm"), F.stddev_pop("s").alias("_ss"),
        F.avg(neighbour_ratio(F.col("s"), F.col("_next"))).alias("_lr"),
    )
    (mh, ml), (kh, kl) = _extremes(F.col("masses")), _extremes(F.col("springs"))
    atoms = cells.select(
        "mat_id", (mh / (ml + F.lit(EPS))).alias("mass_ratio"), (kh / (kl + F.lit(EPS))).alias("spring_ratio"),
        F.size("masses").cast("double").alias("atoms_per_cell"),
    )
    table = material.join(dos, "mat_id").join(gaps, "mat_id", "left").join(atoms, "mat_id")
    c = F.col
    several = F.coalesce(c("_ns"), F.lit(0)) > 2
    table = table.withColumns({
        "band_gap": F.when(c("n_branches") > 1, F.greatest(c("_lo1") - c("_hi0"), F.lit(0.0))).otherwise(0.0),
        "omega_max": c("_top"), "omega_mean": c("_sum") / c("_t"), "v_sound": F.coalesce(c("_vs"), F.lit(0.0)),
        "einstein_ind": c("DOS_max") / (1.0 / c("_span") + F.lit(EPS)),
        "optical_flat": F.when(c("n_branches") > 1, 1 - c("_obw") / (c("_top") + F.lit(EPS)) / (c("n_branches") - 1)).otherwise(0.0),
        "spacing_mean": F.when(several, c("_sm")).otherwise(0.0),
        "spacing_CV": F.when(several, c("_ss") / (c("_sm") + F.lit(EPS))).otherwise(0.0),
        "level_repulsion": F.when(several, c("_lr")).otherwise(0.0),
        "n_dispersive": F.aggregate("_bws", F.lit(0.0), lambda acc, b: acc + flag(b > c("_top") * 0.1)),
    })
    table = table.withColumns({
        "kappa_proxy": c("v_sound") ** 2 / (c("spacing_CV") + 0.1), "debye_T_proxy": c("omega_max") * 0.048,
        "impedance": c("v_sound") * F.sqrt("mass_ratio"), "norm_gap": c("band_gap") / (c("omega_max") + F.lit(EPS)),
        "is_insulator": flag(c("band_gap") > 0.1), "has_flat": flag(c("optical_flat") > 0.8), "high_v": flag(c("v_sound") > 1.0),
        "regular": flag(c("spacing_CV") < 0.5),
    })
    enough = c("_t") >= 3
    return table.select("mat_id", *[F.when(enough, c(f)).alias(f) for f in FEATURES])


def thermoelectric_score() -> Column:
    """Gap and flatness over conductivity, the ranking score."""
    return (F.col("band_gap") + 0.1) * (F.col("optical_flat") + 0.1) / (F.col("kappa_proxy") + 0.1)


