"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``python bench.py [name ...]`` restricts the run. Every query is timed from building its plan to the
last row written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from chunkweave.plans.registry import registered
from chunkweave.session import build_session

HEADLINE = [
    "source_scan",
    "ext_counts",
    "line_chunks",
    "chunk_ids",
    "token_counts",
    "cache_reuse",
    "reuse_counts",
    "incremental_embed",
    "quantize_half",
    "l2_normalize",
    "topk_exact",
    "topk_grid",
    "topk_by_packet",
    "text_query",
    "rerank_diversity",
    "paragraphs",
    "md_sections",
    "code_segments",
    "java_segments",
    "brace_sections",
    "micro_split",
    "pack_lines",
    "routed_chunks",
    "multi_view",
    "merge_small",
    "classify",
    "dispatched_segments",
    "enriched_chunks",
    "chunk_warnings",
    "latest_version",
    "prune_plan",
    "resolve_versions",
    "publish_outcome",
    "yank_state",
    "audit_report",
    "model_choice",
    "tree_hash",
    "drift_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "chunkweave-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
            # Small data, heavy rows: do not merge shuffle partitions into one or two tasks.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
