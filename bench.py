"""Benchmark the headline reports.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``
and prints ONE JSON line. Each query is executed to completion through the ``noop`` sink
(the whole plan runs, nothing is collected to the driver); the reported time is the median of
``$BENCH_REPEAT`` warm runs after one cold run, ``spread`` gives the fastest and slowest of them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from visitlens.session import get_session  # noqa: E402

HEADLINE = {
    "q1_category_top10": "category_top10",
    "q2_category_session_top10": "category_session_top10",
    "q3_area_product_top3": "area_product_top3",
    "q3_area_product_top3_lineitem": "area_product_top3_lineitem",
    "q4_blacklist_users": "blacklist_users",
    "q4_admitted_clicks": "admitted_clicks",
    "q5_area_city_ads_count": "area_city_ads_count",
    "q6_area_top3_ads": "area_top3_ads",
    "visit_filter": "visit_filter",
    "category_counts": "category_counts",
}
STREAM_BATCHES = 10


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    spark = get_session(f"local[{cpus}]", int(cpus), app_name="visitlens-bench",
                        extra={"spark.driver.memory": "8g"})
    if not spark.sparkContext.getCheckpointDir():
        import tempfile
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="visitlens-bench-"))
    from visitlens.plans.registry import QUERIES

    times, cold, spread = {}, {}, {}
    for label, name in HEADLINE.items():
        q = QUERIES[name]
        t0 = time.perf_counter()
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        cold[label] = round(time.perf_counter() - t0, 3)
        warm = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            warm.append(time.perf_counter() - t0)
        times[label] = round(median(warm), 3)
        spread[label] = [round(min(warm), 3), round(max(warm), 3)]
    # Streaming job (Q4-Q6): the click log in STREAM_BATCHES micro-batches, each with its fixed costs.
    # Reported apart from the batch total.
    from visitlens.streaming.registry import replay
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    t0 = time.perf_counter()
    sink = replay(spark, sf_dir, batch_rows=-(-events // STREAM_BATCHES))
    sec = time.perf_counter() - t0
    n_batches = spark.read.parquet(f"{sink}/batches").select("batch_id").distinct().count()
    stream = {"stream_replay_sec": round(sec, 3), "micro_batches": n_batches, "sec_per_batch": round(sec / n_batches, 3)}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_reports_total_warm_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "spread": spread,
        "ratio_to_category_counts": {k: round(v / times["category_counts"], 2) for k, v in times.items()},
        "stream": stream,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
