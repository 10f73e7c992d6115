"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from flowtriage import catalog, fixtures

HEADLINE = [
    "total_count", "label_distribution", "profile_report", "rule_overlap", "suspects", "stratified_sample",
    "stratified_sample_one_scan", "random_sample", "global_rank_distributed", "id_uniqueness", "sampling_run",
    "read_prediction_log", "parse_reply", "metrics", "call_stats", "checkpoint_series", "compare_models",
    "score_records", "evaluation_run", "stream_suspects",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowtriage-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed round on the smallest tables loads classes, compiles code and starts workers.
    small = Path(sf_dir).with_name("sf0.001")
    if small.is_dir() and os.environ.get("BENCH_WARM", "1") == "1":
        for name in HEADLINE:
            run(catalog.QUERIES[name](spark, str(small)))
    # The flow table is input, as Parquet of text columns; deriving it is not part of any query.
    prepared = timed(lambda: fixtures.flows(spark, sf_dir))
    rows = fixtures.flows(spark, sf_dir).count()
    seconds = {name: timed(lambda: run(catalog.QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0), "rows": rows,
        "warmed_on": small.name, "prepare_sec": prepared, "rows_per_sec_sampling_run": round(rows / seconds["sampling_run"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
