"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The derived claims tables are written once before the clock starts, as they would be stored in a running system; their
time is reported as "derive". Every query runs once, whole, into a sink that discards the rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES
from claimweave.session import build_session
from claimweave.sources import derived

HEADLINES = (
    "validate_claims", "validate_identity", "validate_dates", "validate_financial", "validate_medicines",
    "validate_required_documents", "unmatched_medicines", "latest_extractions", "line_items", "split_envelope",
    "folder_load_summary", "upsert_claims", "upsert_documents", "related_documents", "extract_fields", "parse_layout",
    "classify_documents", "search_claims",
)
TABLES = (
    derived.claims, derived.documents, derived.extraction_payloads, derived.extractions, derived.folder_files,
    derived.folder_payloads, derived.results,
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build_session("claimweave-bench", f"local[{cpus}]", 2 * int(cpus) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    started = time.time()
    for table in TABLES:
        table(spark, sf_dir)
    derive = time.time() - started
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 2)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds,
        "derive": round(derive, 2), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
