"""Time the headline queries; one JSON line on standard output."""

from __future__ import annotations

import json
import os
import statistics
import time

from faultline.plans.queries import QUERIES
from faultline.session import local_session

HEADLINE = [
    "clean_readings",
    "forward_fill",
    "row_positions",
    "window_features_tumbling",
    "window_features_sliding",
    "window_features_concat",
    "sample_entropy",
    "kfold_shuffled",
    "leave_one_well_out",
    "standardize",
    "pearson_matrix",
    "zero_rule",
    "knn1_predict",
    "gnb_predict",
    "lda_predict",
    "qda_predict",
    "forest_predict",
    "experiment_results",
    "pivot_report",
]


#: A query is run again, for a median of three, while its runs so far took less than this.
REPEAT_SECONDS = 12


def timed(spark, name: str, folder: str) -> float:
    began = time.monotonic()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    small = f"{os.path.dirname(folder)}/sf0.01"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "faultline-bench")
    spent, at_small, runs = {}, {}, {}
    for name in HEADLINE:
        # The small table compiles the query's code and starts the workers; then the runs that count.
        if os.path.isdir(small):
            timed(spark, name, small)
            at_small[name] = round(timed(spark, name, small), 3)
        took = [timed(spark, name, folder)]
        while len(took) < 3 and sum(took) < REPEAT_SECONDS:
            took.append(timed(spark, name, folder))
        spent[name], runs[name] = round(statistics.median(took), 3), len(took)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": folder.rsplit("sf", 1)[-1],
                "runs": runs,
                "at_sf0.01": at_small,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
