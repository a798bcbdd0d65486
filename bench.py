"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.plans.registry import queries  # noqa: E402
from flowloom.session import build_session  # noqa: E402

HEADLINES = [
    "decode_frames", "segment_packets", "flows_all", "flows_hot_keys", "flow_windowed_2s",
    "traffic_windows_aligned", "traffic_windows_anchored", "wire_roundtrip", "feature_topk",
    "feature_topk_lineitem", "geo_enrich", "overall_metrics", "dash_attack_vs_normal", "dash_destination_map",
    "dash_dst_ip", "dash_packet_trend", "blocklist", "dt_train_predict", "stream_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.files.openCostInBytes": "131072"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(min(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
