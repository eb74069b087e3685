"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. Every query is
run once unmeasured on the small data set next to it, so that code generation and class
loading of the first query are not counted, and then once measured.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waymark.plans import REGISTERED  # noqa: E402
from waymark.session import build_session  # noqa: E402
from waymark.storage import remove_written  # noqa: E402

HEADLINE = [
    "ingest_json_envelope", "first_writes", "unique_users_by_event", "unique_users_weekly",
    "tag_combination_counts", "single_tag_counts", "weekly_goal_tags", "bloom_membership",
    "approx_unique_users", "bayes_predictions", "bayes_predictions_orders",
    "bayes_predictions_weekly", "naive_bayes_events", "naive_bayes_users", "nudges_user",
    "nudges_all_users", "funnel_depth", "churn_predictions", "flags_for_users",
    "stream_first_writes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.checkpoint.dir": os.environ.get("BENCH_DIR") or tempfile.mkdtemp(
            prefix="bench-")})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        if os.path.isdir(small):
            REGISTERED[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        remove_written(spark)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(
        sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
