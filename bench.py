"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores.
Every query runs twice and the faster run counts, so that code generation and
the start of Python workers are not measured.  Results go to the no-op sink, so
all rows and columns are computed.  Beside the seconds stand the rows of each
result per second and the MB its faster run wrote to shuffles.
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import Observation, functions as F

from storyline.registry import QUERIES
from storyline.session import local_session

HEADLINE = (
    "units", "units_documents", "timeline_chunks", "card_events", "plan_segments", "overlap_clip",
    "first_seen_dedupe", "pick_rendition", "budget_prefix", "progress", "clean_suffix_start",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def run(name: str) -> tuple[float, int, float]:
        return _timed(spark, lambda: QUERIES[name](spark, sf_dir))

    runs = {name: min(run(name), run(name)) for name in HEADLINE}
    runs.update(_enrichment(spark, sf_dir))
    seconds = {name: s for name, (s, _, _) in runs.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rows_per_s": {name: round(n / s) for name, (s, n, _) in runs.items()},
                      "shuffle_mb": {name: mb for name, (_, _, mb) in runs.items()},
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


def _shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _timed(spark, query) -> tuple[float, int, float]:
    """Seconds, rows of the result and MB written to shuffles."""
    seen, before, started = Observation(), _shuffled(spark), time.perf_counter()
    query().observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3), seen.get["n"], round((_shuffled(spark) - before) / 1e6, 1)


def _enrichment(spark, sf_dir: str) -> dict[str, tuple[float, int, float]]:
    """The same enrichment with an empty and with a full cache."""
    from storyline.registry.states import enrich_conversations
    from storyline.session import scratch_path
    cache = scratch_path(spark, "bench-cache")
    return {name: _timed(spark, lambda: enrich_conversations(spark, sf_dir, cache))
            for name in ("cached_enrich_cold", "cached_enrich_warm")}


if __name__ == "__main__":
    main()
