"""Times the headline queries on local Spark and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from titletide.plans.registry import ALL
from titletide.session import local_session

HEADLINES = ("price_index", "rare_index", "demand_index", "listing_summary", "mention_stats", "title_levels",
             "archive_new", "snapshot", "week_before", "crowd_prices", "dictionary_matches", "title_groups")
WARM_UP = ("price_index", "mention_stats")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run = lambda name: ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in WARM_UP:
        run(name)
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
