"""Headline benchmark: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every result is computed in full and thrown away (noop sink),
after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from policyspark.catalog import load_all
from policyspark.session import local_session

HEADLINE = [
    "snippet_candidates", "snippets_with_rules", "snippets_of_repeated_keys", "doc_classification", "keyword_scores",
    "keyword_hits_by_term", "baseline_labels", "evidence_gate", "gate_metrics", "gate_sweep", "bootstrap_trainset",
    "leakage_anti_join", "measure_export", "labels_merge", "local_ids", "running_caps", "amount_stats", "top_values",
    "text_length_hist", "page_text", "page_links", "seed_topn", "content_dedupe", "response_map", "crawl_gated",
    "crawl_plain", "label_source_rows", "labeler_roundtrip", "tfidf_weights", "text_classifier", "stream_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "policyspark-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          spark__ui__showConsoleProgress="false", spark__sql__files__maxPartitionBytes="2m",
                          spark__policyspark__spread=cpus if cpus.isdigit() else "8")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    for warm in ("value_counts", "normalised_text"):  # compiles the paths of plain columns and of texts
        queries[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
