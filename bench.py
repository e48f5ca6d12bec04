"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import time

from faultline.plans.registry import QUERIES
from faultline.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "j3_search_top5",
    "j1_candidate_cases",
    "r2_context_block",
    "s3_insert_if_absent",
    "s4_upsert_last",
    "v1_validate_resolution",
    "v2_validate_case",
    "v5_topic_relevance",
    "d3_parse_response",
    "d5_read_codes",
    "d6_assemble_chunks",
    "g3_explode_faults",
    "w1_rolling_write_limit",
    "w4_token_budget",
    "w6_running_violations",
    "t3_batch_admission",
    "p4_case_to_row",
    "a2_top_codes",
    "o1_newest_n",
]


def run(spark, name):
    began = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main():
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "a1_total_count")
    seconds = {name: run(spark, name) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
