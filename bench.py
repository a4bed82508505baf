"""Headline queries, timed one by one: prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local threads,
BENCH_QUERIES an optional comma-separated list of query names. BENCH_SMALL_DIR names smaller tables;
`growth` then holds each query's time over its time there.
"""

import json
import os
import sys
import time

HEADLINE = (
    "trade_flow", "trade_windows", "order_windows", "base_features_interval", "book_buckets_fine", "early_flow_masked",
    "market_full", "liquidity_tails", "order_geography", "simple_ofi", "volatility_flow", "burst_flow", "price_paths",
    "book_signals", "imbalance_persistence", "trade_quote_state", "order_quote_position", "vpin_clock", "flow_persistence",
    "second_grid", "path_shape", "trade_sequence", "rolling_pack", "paired_panel", "month_bootstrap", "prediction_mean",
    "shape_transforms", "group_ranks", "drift_report", "blend_grid",
)


def main():
    from pyspark.sql import SparkSession

    from bookflow.plans import registry

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bookflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = registry.entries()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    todo["trade_flow"][0](spark, path).write.format("noop").mode("overwrite").save()  # warm-up

    def timed(folder):
        took = {}
        for name in names:
            t0 = time.time()
            todo[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - t0, 3)
            print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        return took

    took = timed(path)
    sf = os.path.basename(path.rstrip("/")).removeprefix("sf")
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
    if small := os.environ.get("BENCH_SMALL_DIR"):
        out["growth"] = {n: round(took[n] / max(t, 0.001), 2) for n, t in timed(small).items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
