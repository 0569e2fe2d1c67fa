"""Times the headline queries: one warm-up, then the median of three noop writes each.

Reads run on stored tables, which are written first and timed on their own (``ingest_tables``). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries, sample  # noqa: E402
from runledger.session import build  # noqa: E402

READS = (
    "summary summary_by_instance_type latency_buckets cost_buckets attribution_by_user attribution_totals slow_queries "
    "recent_failures filter_values search_events event_costs shapes insights insight_totals storage_summary"
).split()
TEXT = "normalize_statements shape_keys statement_flags document_statements".split()
MERGES = "event_upsert shape_registry sync_state".split()
# New names only; those above keep theirs, so that rounds compare.
MORE = (
    "summary_of_one latency_buckets_of_one attribution_by_user_of_one slow_queries_of_one shapes_of_one insights_of_one "
    "chart_digest summary_from_cells attribution_from_cells shapes_from_cells event_lookup event_detail"
).split()
# Timed once: they write tables, drain streams, or run for long.
ONCE = "event_upsert_stored event_upsert_moved history_drained ingest_pass stream_latency stream_sync_state".split()
RUNS = 3


def timed(action: Callable[[], object]) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries.registry()

    def write(name: str) -> None:
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    took = {"ingest_tables": timed(lambda: sample.ledger(spark, sf_dir))}
    for name in (*READS, *TEXT, *MERGES):
        write(name)
        took[name] = statistics.median(timed(lambda: write(name)) for _ in range(RUNS))
    took["stream_upsert"] = timed(lambda: write("stream_upsert"))

    more = {}
    for name in MORE:
        write(name)
        more[name] = statistics.median(timed(lambda: write(name)) for _ in range(RUNS))
    more |= {name: timed(lambda: write(name)) for name in ONCE}

    statements = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in took.items()},
                "more_queries": {name: round(seconds, 3) for name, seconds in more.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": statements,
                "statements_per_sec": round(statements / took["shape_keys"]),
                "upserts_per_sec": round(statements / took["event_upsert"]),
                "stream_rows_per_sec": round(statements / took["stream_upsert"]),
                "spark": spark.version,
                "master": spark.sparkContext.master,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
