"""Seconds of the headline queries, as one line of JSON.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
Each query runs once to warm up on the small tables and once, written to nowhere, on the folder.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lamina.session import build_session  # noqa: E402

HEADLINE = [
    "sentences_abbrev", "token_counts", "chunk_sentence", "chunk_sliding", "chunk_fixed", "chunk_article", "chunk_drug_fields", "chunk_guideline",
    "table_row_groups", "token_window_fallback", "dedup_first", "topics_by_key", "brand_dedup_cap", "new_keys_needed", "parse_safe_ok",
    "page_concat", "header_footer_strip", "image_cover_rule", "embed_batches", "embed_text", "cosine_topk", "token_cost",
    "p1_found", "p2_token_budget", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_found", "p8_shares", "p9_found",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        if os.path.isdir(warm):
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
