"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores. Each query runs once to warm up and
compile; its time is the median of BENCH_RUNS (default 3) further runs, or of one if the first took over LONG seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from detframe.queries import registry
from detframe.session import local_session

HEADLINE = ("iou_join", "voc_average_precision", "group_of_ap", "coco_summary", "confusion_matrix", "greedy_nms", "matrix_nms_gaussian",
            "weighted_fusion", "panoptic_quality", "semantic_scores", "phrase_recall", "retrieval_scores", "dataset_check", "interpolated_tracks",
            "shared_frames", "labeled_split", "mosaic", "odvg_records")


LONG = 8.0


def timed(query, spark, sf: str) -> float:
    start = time.time()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores=cores, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        first = timed(queries[name], spark, sf)
        runs = int(os.environ.get("BENCH_RUNS", "3")) if first <= LONG else 1
        times[name] = round(statistics.median(timed(queries[name], spark, sf) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
