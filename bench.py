"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from learnlens.plans import catalog  # noqa: E402
from learnlens.session import build_session  # noqa: E402

HEADLINE = (
    "student_active_time", "student_active_time_monthly", "login_frequency", "time_spent_forums",
    "time_spent_assignments", "lo_access_frequency", "forum_posting_frequency", "time_spent_lo",
    "number_forums_viewed", "course_performance_feedback", "personalized_feedback", "timely_feedback",
    "monitoring_forums", "consistent_use_lms", "feedback_uniqueness", "dashboard",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "learnlens-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["course_roster"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        # The clock includes jobs that run while the plan is built.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
