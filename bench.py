"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from ledgerlane.operators import training
from ledgerlane.plans import run
from ledgerlane.session import local_session

HEADLINE = [
    "batch_scoring",
    "customer_360",
    "collections_worklist",
    "statement_trends",
    "overdue_heatmap",
    "scorecard_scores",
    "feature_contributions",
    "dashboard_kpis",
    "recent_interactions_10",
    "collection_email_prompts",
    "parsed_variations",
    "onboarding_messages",
    "service_prompts",
    "column_profile",
    "campaign_content_lookup",
    "score_histogram",
    "dq_fk_orphans",
]
WARM_UPS = 2
RUNS = 3


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8"))
    spark = local_session(cores, partitions, memory=os.environ.get("BENCH_MEMORY", "8g"))

    def once(name: str) -> float:
        start = time.perf_counter()
        run(name, spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for _ in range(WARM_UPS):
        for name in HEADLINE:
            once(name)

    def train() -> float:
        start = time.perf_counter()
        training.fit(training.split_rows(training.training_rows(training.training_ids(spark)))[0])
        return time.perf_counter() - start

    times = {name: round(statistics.median(once(name) for _ in range(RUNS)), 3) for name in HEADLINE}
    # batch_scoring fits on customers; the fit alone, on generated rows, is timed as well.
    times["train_model"] = round(statistics.median(train() for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(root.rstrip("/")),
                "cores": cores,
                "shuffle_partitions": partitions,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
