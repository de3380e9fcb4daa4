"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query writes its whole result to Spark's noop sink, so nothing is collected and nothing is skipped.
Time includes planning. With BENCH_DETAIL=1 a second line gives input rows per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pollwarden import catalog
from pollwarden.session import local_session

HEADLINE = [
    "early_poll_rule_loso", "a16_loso_summary", "w1_poll_index", "w2_w3_early_polls", "w4_last_poll_per_key",
    "w5_flow_deltas", "w6_port_deltas", "w8_steady_state", "w9_alert_streaks", "j1_asof_nearest", "j2_interval_label",
    "j3_a5_behaviour_windows", "j5_run_log_recovery", "a2_a3_protocol_sums_asof", "fault_snapshots", "a8_a15_fold_report",
    "a21_exact_percentiles_large", "a22_a23_areas", "a24_score_histogram", "s4_p15_p16_p22_public_three_class",
    "u2_j6_overlap", "d1_standard_scaler", "d4_d5_fault_rule", "d6_o3_static_threshold", "m1_stratified_split_sizes",
    "m3_group_folds", "m8_smote_class_sizes", "d9_random_forest", "d14_isolation_forest", "st2_stream_flow_deltas",
    "st6_batch_mitigation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    queries = catalog.load()[0]
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors and the file cache
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001 - one broken query must not hide the others
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}
    if failed:
        out["failed"] = failed
    if os.environ.get("BENCH_DETAIL"):
        rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem", "embeddings")}
        out["input_rows"] = rows
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
