"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query: median of 3 after a warm-up.

``more`` has the other distances, the edges, ranks and kernels, once each after a warm-up; they are not in the total.
``peak_mb`` is the largest resident size of the driver's JVM after all of them.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from cubeflux.plans.registry import QUERIES  # noqa: E402

NAMES = ["a3_band_histogram", "a3_nd_histogram_lineitem", "a6_incremental_histogram", "m2_euclidean", "m5_information_divergence", "j8_nearest_neurons", "j3_edges8", "t15_srgb", "j9_pilot_density", "i12_superpixels", "r2_change_histogram"]

MORE = ["m1_manhattan", "m3_chebyshev", "m4_spectral_angle", "m6_sidsam_sin", "m7_sidsam_tan", "m8_normalised_l2", "m9_mean_squares", "m12_cross_correlation", "m17_gradient_difference", "m18_correlation", "m19_spectral_distance", "m20_similarity_value", "t6_normalise", "t8_log_gradient", "t18_blur", "j2_standard_weights", "a11_equalised_weights", "o1_sorted_edges", "a9_pca_variances", "j10_mean_shift_step", "i14_kruskal", "i10_mean_shift_superpixels", "i22_lsh_tuning"]


def peak_mb() -> int:
    """The largest resident size of this process's JVM, from /proc; 0 where there is none."""
    most = 0
    for pid in filter(str.isdigit, os.listdir("/proc") if os.path.isdir("/proc") else []):
        try:
            with open(f"/proc/{pid}/status") as f:
                status = dict(line.split(":", 1) for line in f if ":" in line)
        except OSError:
            continue
        if status.get("Name", "").strip() == "java" and int(status.get("PPid", 0)) == os.getpid():
            most = max(most, int(status.get("VmHWM", "0 kB").split()[0]) // 1024)
    return most


def timed(spark, name: str, sf: str) -> float:
    began = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        timed(spark, name, sf)
        took[name] = round(statistics.median(timed(spark, name, sf) for _ in range(3)), 3)
    more = {}
    for name in MORE:
        timed(spark, name, sf)
        more[name] = round(timed(spark, name, sf), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "more": more, "peak_mb": peak_mb()}))


if __name__ == "__main__":
    main()
