"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from netledger.session import build_session
from netledger.verify import workload

HEADLINE = [
    "bytes_cat_week", "bytes_org_week", "kanon_org", "cdf", "exact_quantiles", "rank_bins", "daily_org", "cat_per_user",
    "cat_per_quantile", "dns_asof", "fqdn_org_category", "stun_state", "log_gaps", "user_active_deltas",
    "running_balance", "zero_time", "untainted_txn", "consolidated_purchases", "balance_final", "revenue_cumulative",
    "users_over_time", "time_of_day_total", "throughput_day", "flow_stitch", "dedup_flows", "paper_counts",
    "paper_video", "loan_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(workload.QUERIES)
    spark = build_session(
        "netledger-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the JVM and the shared stage tables, as a long-lived job would.
    study = workload.Study(spark, sf_dir)
    _ = study.active, study.consolidated
    workload.run("bytes_cat_week", spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        workload.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
