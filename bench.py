"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times into a sink that discards rows; its figure is the median.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship filter_chain mutate_lateral group_basic group_quantiles group_count_distinct sort_head_topk distinct_rows join_star join_broadcast "
    "join_shuffle_hash asof_ge asof_no_keys win_ranks win_rows_frames win_groups_frame top_n_per_group pivot_wider pivot_longer json_unnest fts_bm25 "
    "graph_degree graph_pagerank graph_components graph_triangles"
).split()


def main() -> None:
    from brightwater.plans.queries import QUERIES
    from brightwater.plans.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - began)
            elif time.perf_counter() - began > 20:
                runs = [time.perf_counter() - began]
                break
        took[name] = round(median(runs), 4)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
