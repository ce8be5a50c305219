"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (optional,
comma-separated) replaces the list. The tables come as one file of one row group each,
which only one task can read; they are laid out in a file a core first, as a cluster
would hold them, and the queries read that. The layout is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium.plans import load_registry
from scriptorium.session import build_session, scratch_path

HEADLINE = [
    "flagship_retrieval",
    "f03_detect_locale",
    "f11_extract_links",
    "f20_shingles_numbers",
    "j05_as_of_edition",
    "j09_vector_cross",
    "s10_batch_admission",
    "t02_task_lifecycle",
    "t05_rate_window",
    "u03_boundary",
    "x01_chunk_documents",
    "x02_bm25_terms",
    "x03_sparse_search",
    "x05_rrf_fuse",
    "x07_hybrid_search",
    "x10_near_dup_pairs",
    "x12_corpus_dedup",
    "x14_replace_versions",
    "x18_graph_candidates",
    "x20_frontier_crawl_order",
    "x22_page_regroup",
    "x25_evaluate_run",
]


def laid_out(spark, sf: str, files: int) -> str:
    """The tables of `sf` in `files` files each, unchanged otherwise."""
    into = scratch_path(spark, "bench")
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(files).write.parquet(f"{into}/{name}")
    return into


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registry = load_registry()
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), app="bench")
    tables = laid_out(spark, sf, int(cpus))
    # One small query first: the JVM's start is not any query's cost.
    registry["a17_programme_rollup"].run(spark, tables).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        began = time.perf_counter()
        registry[name].run(spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall clock of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
