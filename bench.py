"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from strideframe import build_session
from strideframe.plans import catalogue

HEADLINE = (
    "visibility_vote", "view_evidence", "signed_distance", "room_query", "grid_scale", "power_fit", "depth_scores",
    "nearest_neighbour", "zbuffer_gap", "stream_stats", "interpolate_asof", "voxel_fuse", "iou_pairs", "edge_mask", "footprint",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["imu_by_sensor"](spark, folder).count()  # first-use start-up is not a query's cost
    times = {}
    for name in HEADLINE:
        started = time.time()
        # the noop sink evaluates every output column and keeps nothing
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
