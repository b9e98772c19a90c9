"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm the JVM and the second run is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_drive_summary", "w2_dedupe_poses", "w1_arc_length", "w3_longest_segment", "w4_resample",
    "j1_pose_at", "j2_register_scans", "a1_voxelize", "j6_nearest_pose_per_cell", "a3_ground_height",
    "a5_cell_evidence", "a7_classify_cells", "j9_inflate", "w8_densify", "w10_limit_slope",
    "j12_trace_cells", "j13_lateral_clearance", "i1_merge_spans", "i2_segment_rules", "j16_point_in_polygon",
    "x5_dedupe_undirected", "a13_node_degree", "g11_replay_edits_edges", "f20_graph_fingerprint",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from drivegrid.plans import catalog
    from drivegrid.session import build_session

    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        for _ in range(2):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
