"""Times headline queries on the test tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from passbook import catalog  # noqa: E402
from passbook.session import local_session  # noqa: E402

HEADLINE = (
    "agg_category",
    "agg_metrics",
    "agg_comparison",
    "agg_trend_quarter",
    "agg_insights",
    "agg_dashboard",
    "filter_all",
    "filter_search",
    "topk_expenses",
    "sort_orders",
    "agg_day_groups",
    "job_categorise",
    "job_sms_to_candidates",
    "filter_sms_spam",
    "job_dedup",
    "job_stage",
    "win_echo",
    "win_date_fill",
    "join_nearest_amount",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = local_session("bench", cores)
    queries = catalog.queries()
    times: dict[str, float] = {}
    for key in HEADLINE:
        best = None
        for _ in range(rounds):
            start = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[key] = round(best, 3)
    result = {
        "metric": "headline queries, best of rounds, summed",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": cores,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
