"""Benchmark of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is executed in full through the ``noop`` sink.  Before that, each runs once
untimed on the smallest scale beside the measured one, so that the times show the work and
not the start of the JVM; the JSON line says so.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import q_clean, q_learn, q_risk  # noqa: E402

CATALOG = {**q_clean.QUERIES, **q_risk.QUERIES, **q_learn.QUERIES}
HEADLINE = [
    "rule_match",
    "score_entities",
    "score_mixtures",
    "batch_route",
    "build_master",
    "group_mean_median_count",
    "matrix_median_impute",
    "stratified_split",
    "roc_curve",
    "classification_report",
    "standard_scale",
    "token_count_features",
    "scan_csv",
    "feature_table",
    "evaluation_tables",
    "train_forest",
    "train_boosted",
    "train_boosted_balanced",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        CATALOG[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    smallest = Path(sf_dir).parent / "sf0.001"
    warm_up = str(smallest) if smallest.is_dir() else sf_dir
    for name in HEADLINE:
        run(name, warm_up)
    seconds = {name: run(name, sf_dir) for name in HEADLINE}
    mixtures = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count().where("count > 1").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
                "warm_up": Path(warm_up).name,
                "mixtures_per_minute": round(mixtures / seconds["score_mixtures"] * 60),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
