"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from complyframe.plans import QUERIES

HEADLINE = (
    "a05_envelope_decode",
    "c01_substance_normalisation",
    "c05_requirements_of_all_lines",
    "c06_requirement_changes",
    "c08_guardrail_decisions",
    "c10_relationships",
    "c11_conflicts",
    "c12_binding_limits",
    "c15_timeline",
    "c19_document_cache",
    "d01_compliance_rollup",
    "d02_issue_counts",
    "d05_stage_durations",
    "d11_call_costs",
    "d16_trace_journeys",
    "e01_similar_clauses",
    "e02_current_clauses",
    "e03_supersede_chain",
    "e06_status_transitions",
    "f04_vector_search",
    "h19_relevance",
    "h20_limit_statements",
    "i01_extract_stage",
    "k03_apply_verdicts",
)


def run(df: DataFrame) -> None:
    """Compute every column of every row without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{folder}/nation.parquet"))
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - began, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
