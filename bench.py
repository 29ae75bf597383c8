"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

QUERIES = ("degree", "neighbors", "callers", "impact_upstream", "affected_processes", "layout_positions", "lod_edges", "cluster_quality", "bm25_search", "bm25_fielded_boost", "vector_knn", "grep_lines", "nearest_symbol_asof", "diff_ranges_merge", "index_delta", "debounce_sessions")


def main() -> None:
    from graphloom.plans.catalogue import QUERIES as ALL
    from graphloom.session import get_session

    data, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cores}]", **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cores, "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{data}/lineitem.parquet").count()  # the session's own start is not measured
    took = {}
    for name in QUERIES:
        began = time.perf_counter()
        ALL[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rstrip("/").rsplit("sf", 1)[-1], "cores": int(cores), "state": "one run of each in one session"}))


if __name__ == "__main__":
    main()
