"""Wall-clock bench over the registered queries: one warm-up of the first query, then the median of the timed runs.

Prints a single JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores,
``BENCH_QUERIES=all`` runs every registered query instead of the headline ones, ``BENCH_RUNS`` the
number of timed runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairn.plans import load_all
from cairn.plans.registry import QUERIES
from cairn.session import build_session

HEADLINE = [
    "a2_quality_summary", "a3_duplicate_groups", "t3_top_complex_methods", "w7_snapshot_trend",
    "s1_active_catalog", "j1_project_document_counts", "j6_source_inventory", "w1_duplicate_documents", "w9_running_quota",
    "j2_conversation_list", "w2_recent_messages", "f23_history_text",
    "s5_scan_json_findings", "a14_job_progress", "a16_health_rollup",
    "j7_lifted_calls", "a11_type_edges", "a10_package_matrix", "a6_label_graph", "a9_node_degrees", "w4_overview",
    "g1_neighbourhood", "g3_layer_flow_nodes", "g4_package_cycles", "d8_graph_delete",
    "c17_plain_chunks", "v1_vector_top_k_by_project", "v4_hashed_search", "v2_hybrid_search",
    "c1_normal_form_hash", "c4_complexity", "c8_table_lineage", "c9_column_lineage", "c10_mapper_statements", "c12_standard_rules",
    "j16_name_resolution", "j18_prompt_tables", "j22_tool_mentions", "a23_match_counts", "w10_match_numbers",
    "d1_insert_absent", "d4_guarded_transitions", "st2_scan_progress",
]


def timed(fn, spark, sf_dir):
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", cpus)
    load_all()
    names = list(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else [n for n in HEADLINE if n in QUERIES]
    seconds = {}
    timed(QUERIES[names[0]], spark, sf_dir)  # starts the JVM's compilers and the table footers
    for name in names:
        if runs > 1:
            timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
