"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Each query writes its whole result to the no-op sink.  One untimed run of the
flagship query comes first, so that JVM start-up and code compilation are not
charged to whichever query happens to be first.
"""

from __future__ import annotations

import json
import os
import time

from chartloom.plans import QUERIES
from chartloom.session import build_session

HEADLINE = (
    "eye_gold", "needs_repair", "repair_merge", "measurements_long", "completeness_per_metric",
    "toric_flag", "report_metrics", "exam_summary", "documents_review", "patient_header",
    "surgical_formulas", "contract_check", "id_validity", "file_manifest", "admission",
    "enrich_sources", "verify_manifest_all", "dup_content", "upload_index", "response_fold",
    "request_batch", "case_listing", "newest_cases", "case_upsert", "confirm_outcome",
    "confirm_within_24h", "expired_drafts", "erase_counts", "identity_conflict",
    "stream_confirmed", "stream_admission",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "chartloom-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["eye_gold"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
