"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query's seconds go to stderr as it ends. A query is cancelled after ``$BENCH_QUERY_SECONDS``, and
no query starts after ``$BENCH_SECONDS``, so one that doesn't end loses no other's figure.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from annalist.plans.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
EACH = float(os.environ.get("BENCH_QUERY_SECONDS", "60"))
ALL = float(os.environ.get("BENCH_SECONDS", "1200"))
HEADLINE = [
    "top_level", "top_entity", "top_attr", "top_filtered", "timeline_1h", "timeline_1d_by_level", "patterns", "stats_value_by_kind", "events_desc", "join_shared_value", "correlate_window", "correlate_via",
    "gaps_ordered", "trace_bfs", "episodes", "precede_precursors", "precede_lift", "hotspots", "churn", "coupling_pairs", "owners_bus_factor", "bugs_areas", "streaks", "latency_asof", "rework_30d", "search_bm25", "templatize_docs", "simhash_bands",
]


def timed(spark: SparkSession, name: str) -> float | None:
    """Seconds of the faster of two runs (the second has its code compiled); None if the first was cancelled."""
    best = None
    for _ in range(2):
        start = time.perf_counter()
        spark.addTag(name)
        alarm = threading.Timer(EACH, spark.interruptTag, [name])
        alarm.start()
        try:
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        except Exception as e:
            print(f"{name}: {type(e).__name__} after {time.perf_counter() - start:.1f} s", file=sys.stderr, flush=True)
            break
        finally:
            alarm.cancel()
            spark.removeTag(name)
    return best


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    took: dict[str, float] = {}
    missed: list[str] = []
    for name in HEADLINE:
        best = timed(spark, name) if time.perf_counter() - began < ALL else None
        if best is None:
            missed.append(name)
            continue
        took[name] = round(best, 3)
        print(f"{name}: {best:.3f} s", file=sys.stderr, flush=True)
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}
    print(json.dumps(out | ({"missed": missed} if missed else {})), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
