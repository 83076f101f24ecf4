"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyfold.plans.catalog import QUERIES  # noqa: E402
from skyfold.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_weekly_outlook",
    "ag4_threshold_odds",
    "ag10_terciles",
    "ag14_departures",
    "ag15_anomaly_correlation",
    "ag22_limits_whole_map",
    "wn1_doy_smoother",
    "jn9_cells_in_polygon",
    "jn16_bilinear",
    "jn1_merge_weekly",
    "jn8_exact_fuzzy_default",
    "sr8_classify_all",
    "ad3_outlook_en",
    "ad8_advisories",
    "dd3_overlap_fold",
    "fn7_split_actions",
    "wn7_dittos",
    "ex3_harvest",
    "ex5_map_reading",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sc10_grid_scan"](spark, sf_dir).collect()  # start the executors
    times = {}
    for key in HEADLINE:
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
