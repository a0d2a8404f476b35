"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, functions as F  # noqa: E402

from spectrafold.catalog import REGISTRY  # noqa: E402
from spectrafold.session import local_session  # noqa: E402

HEADLINE = [
    "signal_moments", "wavelet_coefficients", "cascade_profile", "volume_profile", "image_profile", "image_block_anomaly", "amplitude_spectrum",
    "vibration_profile", "color_profile", "channel_profile", "level_profile", "dispersion_profile", "euler_atlas", "trajectory_scales",
    "valley_scan", "quotient_profile", "quotient_pairs", "curve_audit", "weighted_residuals", "tree_profile", "degree_statistics",
    "connected_components", "hop_distances", "rank_correlation", "tumbling_statistics", "session_statistics",
    "graph_profile", "path_profile", "lfunc_atlas",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small run warms the JVM; every query below is then timed once
    REGISTRY["signal_moments"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, rates = {}, {}
    for name in names:
        started = time.time()
        seen = Observation(name)
        df = REGISTRY[name].run(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n"))
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        rates[name] = round(seen.get["n"] / max(seconds[name], 1e-9), 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "objects_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
