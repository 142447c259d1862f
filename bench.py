"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the test data (default sf0.1), BENCH_CPUS the local cores.
``--all`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from hallkeeper.plans.registry import queries  # noqa: E402
from hallkeeper.session import local_session  # noqa: E402

HEADLINE = (
    "integrity_snapshot",
    "invoice_balances",
    "invoice_statuses",
    "application_queue",
    "transfer_queue",
    "room_catalog",
    "assignable_room_counts",
    "unread_counts",
    "dashboard_kpis",
    "priority_queues",
    "activity_metrics",
    "dashboard_snapshot",
    "view_student_financials",
    "view_monthly_revenue",
    "history_payments",
    "recent_access",
    "invoice_payments_nested",
    "room_roster",
    "rules_assignments",
    "rules_transfers",
    "cancel_requests",
    "reconcile_housing_counts",
    "reconcile_operational_counts",
    "approve_applications",
    "complete_due_transfers",
    "notifications_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "hallkeeper-bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    available = queries()
    names = tuple(available) if "--all" in sys.argv else HEADLINE
    # Class loading and code generation are not what is measured.
    available["invoice_balances"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = pathlib.Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
