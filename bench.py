"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables and ``BENCH_CPUS`` the number of local
cores. Every query is run ``RUNS`` times with its result written to Spark's ``noop``
sink, and the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trajspark.plans import catalog  # noqa: E402
from trajspark.session import build_session  # noqa: E402

RUNS = 2
HEADLINES = (
    "clone_assign",
    "sample_qc",
    "clone_perc",
    "downsample_to_min",
    "dynamic_clones",
    "corr_pearson",
    "traj_absolute",
    "traj_hclust",
    "traj_pam",
    "traj_hcpc",
    "label_cells",
    "area_base",
    "area_by_treatment",
    "ctype_treatment",
    "ctype_treatment_patient",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", partitions=8, app="trajspark-bench")
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
