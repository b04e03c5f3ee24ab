"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the number of local cores (default 8).
The given files have one row group each, which no reader can split; before anything is timed, the tables are written anew
with as many files as cores, so that the plans timed are those of tables with many splits. Each query runs to its end
twice, with no result kept; the better time counts, the first includes code generation. Staged tables are deleted after
each run.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from triagemill.plans.staging import release
from triagemill.workload import registry

HEADLINE = (
    "risk_summary",
    "all_findings",
    "brute_force_window",
    "compromise_lookback",
    "escalation_correlated",
    "incident_report_json",
    "event_kinds",
    "ioc_first_occurrence",
    "ioc_context",
    "intel_enrich",
    "term_counts",
    "cosine_scores",
    "tfidf_topk",
    "alert_triage",
    "prompt_table",
    "rule_evaluate",
    "default_rules_on_texts",
    "process_report_counts",
    "baseline_new",
    "keyword_sweep",
    "syslog_scan",
    "incident_report_markdown",
    "process_report",
    "alert_report_json",
    "watch_findings",
)


TABLES = ("benchmark", "conversations", "documents", "events", "pages", "part")


def session(cpus: str, folder: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("triagemill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.sql.files.openCostInBytes", "0")
        # No call-site capture for each column expression; it costs a second for a large query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def split_tables(spark: SparkSession, sf_dir: str, folder: str, files: int) -> str:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/tables/{name}.parquet")
    return f"{folder}/tables"


def seconds(spark: SparkSession, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory(prefix="triagemill-bench-") as folder:
        spark = session(cpus, folder)
        tables = split_tables(spark, sf_dir, folder, int(cpus))
        queries = registry.queries()
        times = {}
        for name in HEADLINE:
            runs = []
            for _ in range(2):
                runs.append(seconds(spark, queries[name], tables))
                release(spark)
            times[name] = round(min(runs), 3)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, better of two runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
