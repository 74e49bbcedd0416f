"""Time the headline queries and print one JSON line.

Each query runs twice and the better time counts: on tables this small the first run mostly
measures class loading and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "load_report",
    "clean_texts",
    "token_distribution",
    "packed_batches",
    "batch_requests",
    "cache_lookup",
    "parsed_themes",
    "theme_frequency",
    "case_map_running",
    "entry_themes",
    "consolidated_themes",
    "theme_examples",
    "merge_suggestions",
    "theme_cooccurrence",
    "similar_vectors",
    "session_stats",
)


RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus, max(8, int(cpus) if cpus.isdigit() else 8))
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
        print(name, *[round(r, 3) for r in runs], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of the better of two runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
