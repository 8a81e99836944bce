"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores.  Each query is built, planned and run in full; the value is the median
of three runs after one warm-up.  ``rows_per_sec`` and ``exchanges`` (of the
plan as built, without the jobs that run while it is built) stand beside it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from fieldtrace.settings import SESSION_SETTINGS
from registry import QUERIES

HEADLINE = (
    "event_table", "state_pair_point", "state_dig", "state_next_row", "subset_lead",
    "fill_down", "running_counter", "session_source", "near_marker", "dictionary_relabel",
    "duplicate_tagged", "mirror_partner", "zip_explode", "explode_sizes", "explode_tokens",
    "overlay", "extract_bracketed", "clock_text",
)
# Long ones, timed once beside the total.
MORE = ("stable_order", "sink_single_table", "sink_order", "event_table_blocked")
RUNS = 3


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shape(spark, sf_dir: str, name: str) -> tuple[int, int]:
    """Rows of the result and shuffles of its plan."""
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.count(), len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.showConsoleProgress", "false")
               # The sample is a few megabytes: keep its partitions apart.
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k"))
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, rate, shuffles = {}, {}, {}
    for name in HEADLINE:
        rows, shuffles[name] = shape(spark, sf_dir, name)
        timed(spark, sf_dir, name)
        took[name] = round(statistics.median(timed(spark, sf_dir, name)
                                             for _ in range(RUNS)), 3)
        rate[name] = round(rows / took[name])
    more = {name: round(timed(spark, sf_dir, name), 3) for name in MORE}
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "rows_per_sec": rate,
                      "exchanges": shuffles, "more": more, "sf": sf}))


if __name__ == "__main__":
    main()
