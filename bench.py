"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the run. Each
query is run once to warm up code paths and once for the record; results go to the no-op sink, so
all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from adjudica import registry
from adjudica.sources import scratch
from verify import session

HEADLINE = [
    "rejection_summary",
    "rejection_counts",
    "compose_california",
    "validate_joint",
    "split_outcomes",
    "validator_udf",
    "replay_release",
    "violation_facts",
    "extract_fields",
    "complete_extractions",
    "within_budget",
    "dispatch_valid",
    "rejection_letters",
    "tokenise",
    "detokenise",
    "erase",
    "mask_by_role",
    "credibility_state",
    "credibility_path",
    "state_as_of_each",
    "sgd_fit",
    "composed_learner",
    "score_by_zip",
    "schema_diff",
    "stream_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = session(cores)
    times: dict[str, float] = {}
    for name in HEADLINE:
        run = registry.QUERIES[name]
        for _ in range(2):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        scratch.release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
