"""Seconds per query, one warm-up and the median of the timed runs.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES
(comma separated) change what is run. Results go to Spark's noop sink, so the
whole query is computed and nothing is collected.
"""

import glob
import json
import os
import statistics
import tempfile
import time

from tabia.plans.queries import QUERIES
from tabia.session import build

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

GROWING = ("lineitem", "events", "documents", "orders", "customer")

HEADLINE = (
    "q_statement_parse",
    "q_categorize",
    "q_spending_by_category",
    "q_monthly_income",
    "q_infer_balance",
    "q_balance_profile",
    "q_cash_flow",
    "q_large_debits",
    "q_high_frequency_days",
    "q_bank_features",
    "q_bank_anomalies",
    "q_bank_score",
    "q_mobile_score",
    "q_crb_score",
    "q_unified_score",
    "q_rule_breakdown",
    "q_metrics_bank",
    "q_transactions_all",
)


def dealt(spark):
    """A copy of the tables in as many files as cores: the test files hold one row group each."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{SF_DIR}/*.parquet")):
        table = spark.read.parquet(path)
        files = int(CPUS) if os.path.basename(path).split(".")[0] in GROWING else 1
        table.repartition(files).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def run(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = build(
        f"local[{CPUS}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = dealt(spark)
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
