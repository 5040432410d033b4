"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected).  The flagship metric is the spatio-temporal kNN join at
k = 15, delta = 1 day (the reference script's parameters).  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tandem.operators import joins as J  # noqa: E402
from tandem.operators import knn as KN  # noqa: E402
from tandem.operators import tiling as TL  # noqa: E402
from tandem.session import get_session  # noqa: E402
from tandem.sources import fixtures as fx  # noqa: E402

DAY = 86_400_000_000
HOUR = 3_600_000_000


def headline(spark, sf):
    L = lambda: fx.pts_left(spark, sf)
    R = lambda: fx.pts_right(spark, sf)
    return {
        "st_knn_join": lambda: KN.st_knn_join(L(), R(), 15, DAY),
        "st_knn_join_nested": lambda: KN.st_knn_join(L(), R(), 15, DAY, nested=True),
        "st_knn_join_6h": lambda: KN.st_knn_join(L(), R(), 15, 6 * HOUR),
        "box_knn_join": lambda: KN.st_knn_join(fx.box_left(spark, sf), fx.box_right(spark, sf), 15, DAY),
        "self_knn_join": lambda: KN.st_knn_join(R(), R(), 15, DAY, pair_filter=F.col("l_id") != F.col("r_id"),
                                                pair_filter_slack=1),
        "st_distance_join": lambda: KN.st_distance_join(L(), R(), 3.0, 6 * HOUR),
        "interval_overlap_join": lambda: J.interval_overlap_join(L(), fx.sessions(spark, sf), 0),
        "time_periods": lambda: TL.time_periods(fx.sessions(spark, sf), 200, 40, 15, DAY),
    }


def run(df_fn) -> float:
    t = time.time()
    df_fn().write.format("noop").mode("overwrite").save()
    return time.time() - t


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("BENCH_REPS", "5"))
    spark = get_session(app="tandem-bench")
    qs = headline(spark, sf)
    for _ in range(3):      # warm-up: JVM JIT, codegen caches, file listing
        run(qs["st_knn_join"])
    times = {}
    for name, fn in qs.items():
        times[name] = round(statistics.median(run(fn) for _ in range(reps if name == "st_knn_join" else 1)), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "st_knn_join_k15_delta1d_sec", "value": times["st_knn_join"], "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": os.environ.get("BENCH_CPUS", "8")}))


if __name__ == "__main__":
    main()
