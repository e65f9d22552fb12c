"""Headline queries, timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkwarden import build_session  # noqa: E402
from sparkwarden.harness import QUERIES  # noqa: E402

HEADLINE = (
    "rank_files_by_finding", "rule_match_positions", "rule_match_positions_pages", "mask_secrets", "tokenize_counts",
    "graph_edges_touching", "graph_neighbourhood_edges", "graph_callers", "call_paths", "impact_context_counts", "bfs_context_rank",
    "rank_files", "filter_stats", "dedup_first_by_node", "upsert_relations", "vector_topk", "fulltext_topk_batch", "hybrid_search",
    "cve_list_page", "cve_trend_sets", "top_products", "match_tool_findings", "innermost_container", "confusion_by_group",
    "constraint_verdicts", "score_functions", "recent_messages", "resume_pending",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One small query starts the session, the code generator and the Python workers' parent.
    QUERIES["label_frequency"](spark, folder).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
