"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up, then timed ``$BENCH_REPEAT`` times (median); a run is a full
``collect``-free execution (``count`` of the result would let Spark prune columns, so results are
written to the ``noop`` sink, which materialises every column of every row).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voltaic.plans import load_all  # noqa: E402
from voltaic.session import get_session  # noqa: E402

HEADLINE = [
    "q19_top_cities",                 # flagship: 4-table star join + top-k
    "m7_customer_star_metrics",       # metrics layer, drill-across of four facts
    "q21_production_margin_by_type",  # derived metric over lineitem + part
    "r2_chunk_stats",                 # chunk all documents, count and mean length
    "r3_index_term_stats",            # postings and per-term statistics of all chunks
    "t1b_word_document_frequency",    # document frequency of every word (BASELINE yardstick 3)
    "r4_k4_bm25_benchmark",           # BM25 top-k search
    "t2_t3_quality_score",            # lexicon sentiment over all documents
    "t6_summaries",                   # extractive summaries of all documents
    "c2_fold_event_log",              # event-log fold per conversation
    "r5_vector_search",               # exact cosine top-k
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", int(cpus), extra={"spark.driver.memory": "16g"})
    queries = load_all()[0]
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        fn = queries[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
