"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The tables are first copied into several files each, untimed: a large input lies in many
splits, and the plans measured here are the ones it gets. Every query runs twice;
``queries`` has the first, cold run, ``warm`` the second. ``prepared`` has the seconds of the copying and of the saved BM25 index,
``added`` those of queries that are not in the total.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from codexflow.session import env_int, local_session

HEADLINE = [
    "clean_legal", "join_broken_paragraphs", "split_headers", "chunk_adaptive", "chunk_page_text", "extract_metadata",
    "enrich_chunks", "ingest_recursive", "quality_report", "library_upsert", "library_incremental", "bm25_index", "bm25_topk",
    "dense_topk", "dense_topk_filtered", "hybrid_retrieve", "hier_retrieve", "article_lookup", "qa_end_to_end",
    "parse_analysis", "stream_dedupe", "stream_window_counts",
]
# not part of the total, which stays comparable
ADDED = ["query_rewrite", "multi_query_retrieve", "compress_context", "dense_topk_index", "library_exists_sketch", "library_upsert_bucketed"]


def main() -> None:
    import workload
    from workload import retrieval_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names, added = (sys.argv[1:], []) if sys.argv[1:] else (HEADLINE, ADDED)
    spark = local_session(env_int("BENCH_CPUS", 8), os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    split, started = tempfile.mkdtemp(prefix="bench-"), time.perf_counter()
    for table in sorted(x.removesuffix(".parquet") for x in os.listdir(sf_dir) if x.endswith(".parquet")):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{split}/{table}.parquet")
    prepared = {"split": round(time.perf_counter() - started, 3)}
    started = time.perf_counter()
    retrieval_queries._index(spark, split)  # the saved index that the retrieval queries read
    prepared["bm25_index_saved"] = round(time.perf_counter() - started, 3)
    seconds, warm = {}, {}
    for name in [*names, *added]:
        for run in (seconds, warm):
            start = time.perf_counter()
            workload.QUERIES[name](spark, split).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]} {warm[name]}", file=sys.stderr)
    of = lambda run, chosen: {name: run[name] for name in chosen}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(of(seconds, names).values()), 3), "unit": "sec", "queries": of(seconds, names),
        "added": of(seconds, added), "added_warm": of(warm, added), "prepared": prepared,
        "warm": of(warm, names), "warm_total": round(sum(of(warm, names).values()), 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
