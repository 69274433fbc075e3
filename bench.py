"""Time the headline jobs; prints one JSON line.

Each query is planned and run in full into a no-op sink. The first run warms the JVM and code cache,
the second is timed. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from wirelens.plans.catalog import QUERIES  # noqa: E402
from wirelens.session import local_session  # noqa: E402

HEADLINE = [
    "flow_features", "flow_features_session", "flows_tumbling", "flows_bidirectional",
    "flow_packet_link", "flow_packet_sample", "flow_iat", "anomaly_indicators",
    "payload_entropy", "document_entropy", "sequence_score_global", "threat_score", "alerts_union",
    "l2_mac_flood", "l2_arp_spoof", "l2_stp_tc_flood", "l2_cdp_flood", "l2_dtp", "l2_vtp",
    "l2_all_alerts", "rolling_distinct", "cooldown",
    "top_sources", "traffic_timeseries", "traffic_rates", "recent_flows",
    "isolation_forest_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    timings: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {n: round(rows / timings[n]) for n in ("flow_features", "l2_all_alerts")
             if n in timings}
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline jobs", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
        "input_rows": rows, "rows_per_sec": rates}))


if __name__ == "__main__":
    main()
