"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs whole and is written to the no-op sink. Each gets one warm-up run; the figure
is the median of the following $BENCH_RUNS runs (default 3). Searches and views (v_hotel_overall, q_*) read tables that
their first run has stored and scored; what that costs is the figure of score_tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlytics.session import local_session  # noqa: E402
from workbench.registry import REGISTRY  # noqa: E402

HEADLINES = [
    "calc_ratings",
    "whole_word_ratings",
    "score_tables",
    "v_seed_word_analysis",
    "seed_terms",
    "review_sentiment",
    "mined_seed_ratings",
    "v_hotel_overall",
    "q_advanced_search",
    "q_hotels_by_city",
    "q_hotel_rating_card",
    "q_recent_reviews",
    "refresh_hotels",
    "load_tables",
]


def timed(spark, key: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = sys.argv[1:] or HEADLINES
    spark = local_session(app="bench")
    seconds = {}
    for key in keys:
        timed(spark, key, sf_dir)
        seconds[key] = round(statistics.median(timed(spark, key, sf_dir) for _ in range(runs)), 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
