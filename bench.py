"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from cairnlens.plans import catalogue
from cairnlens.session import local_session

HEADLINES = [
    "task_risk", "severity_summary", "severity_breakdown", "task_counts", "queue_summary",
    "stage_durations", "stage_transitions", "analyzer_failure_rates", "observed_analyzers",
    "task_search", "audit_search", "keyset_page_desc", "findings_latest_run", "truncate_per_task",
    "diagnostics_union", "expired_samples", "expired_uploads", "blob_reference_counts",
    "blob_orphans", "cache_candidates", "project_rollup", "manifest_compare", "part_completeness",
    "finding_in_function", "finding_violations", "call_graph_check", "tree_integrity",
    "image_index_closure", "canonical_offsets", "extraction_budget", "classify_blobs",
    "classify_zip_listing", "archive_candidates", "multi_release_select", "duplicate_content",
    "source_rule_scan", "normalize_display_text", "report_quality", "explode_findings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    catalogue.run("task_counts", spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalogue.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
