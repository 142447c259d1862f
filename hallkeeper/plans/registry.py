"""Named queries over the test data, one per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hallkeeper.functions.columns import enum_literals, initials, shortened, status_slug, text_or
from hallkeeper.functions.ranking import union_all
from hallkeeper.operators import allocation, browse, candidates, changes, checks, facts, finance, histories, moves, queues, repairs, rules, snapshots, views
from hallkeeper.operators.repairs import Moment
from hallkeeper.plans import reach, reconcile
from hallkeeper.plans.sample_changes import REPAIRED_TABLES, later_tables, sample_images, sample_rows
from hallkeeper.schemas import KEYS
from hallkeeper.session import cut_lineage, new_folder
from hallkeeper.sources import imports
from hallkeeper.sources.bucketed import Store
from hallkeeper.sources.testdata import AS_OF, NOW, testdata_tables
from hallkeeper.streaming import images, notices
from hallkeeper.tables import Tables

AT = Moment(AS_OF, NOW)

Query = Callable[[SparkSession, str], DataFrame]


def _over_tables(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query that loads the tables and applies one operator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(testdata_tables(spark, sf_dir), *args, **kwargs)

    return run


def _check_queries() -> dict[str, Query]:
    def one(t: Tables, name: str) -> DataFrame:
        return checks.violations(t, name, AS_OF)

    found = {f"check_{name}": _over_tables(one, name) for name in checks.CHECK_NAMES}
    found["integrity_snapshot"] = _over_tables(checks.integrity_snapshot, AS_OF)
    found["students_without_student_account"] = _over_tables(checks.students_without_any_student_account)
    return found


def _fact_queries() -> dict[str, Query]:
    names = (
        "current_assignment", "active_per_room", "active_per_bed", "bed_counts", "paid_per_invoice",
        "latest_inspection", "last_maintenance",
    )
    return {name: _over_tables(getattr(facts, name)) for name in names}


def _finance_queries() -> dict[str, Query]:
    return {
        "invoice_balances": _over_tables(finance.invoice_balances),
        "unpaid_totals": _over_tables(finance.unpaid_totals),
        "penalty_summary": _over_tables(finance.penalty_summary),
        "invoice_statuses": _over_tables(finance.invoice_statuses, AS_OF),
        "view_student_financials": _over_tables(finance.student_financials),
        "view_monthly_revenue": _over_tables(finance.monthly_revenue),
        "view_overdue_invoices": _over_tables(finance.overdue_invoices, AS_OF),
    }


def _listing_queries() -> dict[str, Query]:
    return {
        "application_queue": _over_tables(queues.application_queue),
        "transfer_queue": _over_tables(queues.transfer_queue),
        "assignable_rooms": _over_tables(queues.assignable_rooms),
        "assignable_room_counts": _over_tables(queues.assignable_room_counts),
        "available_rooms": _over_tables(queues.available_rooms),
        "available_room_counts": _over_tables(queues.available_room_counts),
        "transfer_destinations": _over_tables(queues.transfer_destinations),
        "transfer_destination_counts": _over_tables(queues.transfer_destination_counts),
        "room_catalog": _over_tables(queues.room_catalog),
        "available_beds": _over_tables(queues.list_available_beds),
        "due_transfers": _over_tables(queues.due_transfers, AS_OF),
        "active_announcements": _over_tables(queues.active_announcements, NOW),
        "read_announcements": _over_tables(queues.read_announcements, NOW),
        "active_notifications": _over_tables(queues.active_notifications, NOW),
        "unread_counts": _over_tables(queues.unread_counts, NOW),
        "open_semesters": _over_tables(queues.open_semesters, AS_OF),
        "service_audience": _over_tables(queues.service_audience),
        "visible_service_counts": _over_tables(queues.visible_service_counts),
    }


def _snapshot_queries() -> dict[str, Query]:
    return {
        "records_snapshot": _over_tables(snapshots.records_snapshot),
        "dashboard_snapshot": _over_tables(snapshots.dashboard_snapshot, NOW),
        "room_roster": _over_tables(snapshots.room_roster),
        "roommate_counts": _over_tables(snapshots.roommate_counts),
        "accommodation_accepted": _over_tables(snapshots.accommodation_accepted),
        "active_portal_accounts": _over_tables(snapshots.active_portal_accounts),
        "latest_application": _over_tables(snapshots.latest_application),
        "student_profiles": _over_tables(snapshots.student_profiles),
        "room_documents": _over_tables(snapshots.room_documents),
        "request_documents": _over_tables(snapshots.request_documents),
        "announcement_documents": _over_tables(snapshots.announcement_documents, NOW),
        "top_announcements": _over_tables(snapshots.top_announcements, NOW),
        "service_activity": _over_tables(snapshots.service_activity),
        "history_payments": _over_tables(histories.payment_history),
        "history_penalties": _over_tables(histories.penalty_history),
        "history_incidents": _over_tables(histories.incident_history),
        "history_leave": _over_tables(histories.leave_history),
        "history_visitors": _over_tables(histories.visitor_history),
        "history_transfers": _over_tables(histories.transfer_history),
        "history_applications": _over_tables(histories.application_history),
        "history_lost_and_found": _over_tables(histories.lost_and_found_history),
        "history_meal_subscriptions": _over_tables(histories.meal_subscription_history),
        "history_maintenance": _over_tables(histories.maintenance_history),
        "history_complaints": _over_tables(histories.complaint_history),
        "recent_meals": _over_tables(histories.recent_meals),
        "recent_laundry": _over_tables(histories.recent_laundry),
        "recent_access": _over_tables(histories.recent_access),
        "recent_inspections": _over_tables(histories.recent_inspections),
        "latest_requests": _over_tables(histories.latest_requests),
        "maintenance_logs_nested": _over_tables(histories.maintenance_logs_nested),
        "application_assignments_nested": _over_tables(histories.application_assignments_nested),
        "invoice_payments_nested": _over_tables(histories.invoice_payments_nested),
        "programs_by_faculty": _over_tables(histories.programs_by_faculty),
    }


def _view_queries() -> dict[str, Query]:
    return {
        "dashboard_kpis": _over_tables(views.dashboard_kpis),
        "capacity": _over_tables(views.capacity),
        "priority_queues": _over_tables(views.priority_queues, AS_OF),
        "activity_metrics": _over_tables(views.activity_metrics, AS_OF),
        "activity_metrics_on_a_meal_day": _over_tables(views.activity_metrics, NOW.date()),
        "view_student_directory": _over_tables(views.student_directory),
        "view_room_occupancy": _over_tables(views.room_occupancy),
        "view_building_capacity": _over_tables(views.building_capacity),
        "view_available_beds": _over_tables(views.available_bed_slots),
        "view_actionable_inspections": _over_tables(views.actionable_inspections),
        "view_active_maintenance": _over_tables(views.active_maintenance),
        "view_expiring_contracts": _over_tables(views.expiring_contracts, AS_OF),
        "view_active_blacklist": _over_tables(views.active_blacklist, AS_OF),
        "view_daily_meals": _over_tables(views.daily_meals, NOW.date()),
        "view_active_leave": _over_tables(views.active_leave, AS_OF),
        "view_maintenance_kpis": _over_tables(views.maintenance_kpis),
    }


REPAIRED_CHECKS = (
    "missing_occupancy_logs", "occupancy_mismatch", "room_status_mismatch", "bed_occupancy_mismatch",
    "resolved_maintenance_missing_timestamp", "closed_complaints_missing_timestamp",
    "resolved_incidents_missing_timestamp", "decisions_missing_dates", "invoice_status_mismatch",
    "student_account_profile_mismatch", "stale_visitor_permissions", "stale_meal_subscriptions",
    "pending_penalties_past_due", "building_maintenance_rollup_mismatch", "assignment_checkout_before_checkin",
    "transfer_move_before_source_checkin",
)
"""Checks whose violations the pipelines remove."""


def _repair_queries() -> dict[str, Query]:
    def housing_step(t: Tables, step: str) -> DataFrame:
        """One step of the housing pipeline, on the state the steps before it leave."""
        before = []
        for repair in repairs.HOUSING:
            if repair.step == step:
                break
            before.append(repair)
        if before:
            t, _ = repairs.run_steps(t, before, AT)
        return repairs.step_changes(t, repairs.HOUSING, step, AT)

    def after_housing(t: Tables, table: str) -> DataFrame:
        return reconcile.reconcile_housing(t, AT).tables[table]

    def fills(t: Tables) -> DataFrame:
        recounted, _ = repairs.run_steps(t, repairs.HOUSING[:3], AT)
        return repairs.bed_fills(recounted)

    def checked_after(t: Tables) -> DataFrame:
        repaired = reconcile.reconcile_after(t, {"room_assignment", "invoice"}, AT, make_moves=False)
        return checks.integrity_snapshot(repaired, AS_OF, REPAIRED_CHECKS)

    def saved(t: Tables, table: str) -> DataFrame:
        return repairs.save_time_fills(t, table, t[table], AT)

    found = {f"repair_{r.step}": _over_tables(housing_step, r.step) for r in repairs.HOUSING}
    for table in ("room_assignment", "room_transfer", "maintenance_request"):
        found[f"save_time_fills_{table}"] = _over_tables(saved, table)
    for repair in repairs.OPERATIONAL:
        found[f"repair_{repair.step}"] = _over_tables(repairs.step_changes, repairs.OPERATIONAL, repair.step, AT)
    for table in ("occupancy_log", "bed_slot", "room_assignment", "room"):
        found[f"reconciled_{table}"] = _over_tables(after_housing, table)
    found["bed_fills"] = _over_tables(fills)
    found["reconcile_housing_counts"] = _over_tables(reconcile.housing_counts, AT)
    found["reconcile_operational_counts"] = _over_tables(reconcile.operational_counts, AT)
    found["integrity_after_repairs"] = _over_tables(checked_after)
    return found


def _rule_queries() -> dict[str, Query]:
    def raw_invoice_rules(t: Tables) -> DataFrame:
        return rules.import_rules(t.raw_invoice, "invoice", "LineNo")

    def raw_invoice_rows(t: Tables) -> DataFrame:
        return rules.import_rows(t.raw_invoice)

    imported_tables = ("penalty", "meal_subscription", "complaint")

    def lines_of(t: Tables, table: str) -> DataFrame:
        return t.raw_line.filter(F.col("table_name") == table)

    def table_rules(t: Tables) -> DataFrame:
        return union_all([imports.line_rules(lines_of(t, n), n, t[n].schema) for n in imported_tables])

    def penalty_rows(t: Tables) -> DataFrame:
        return imports.line_rows(lines_of(t, "penalty"), "penalty", t.penalty.schema)

    def complaints_after(t: Tables) -> DataFrame:
        return rules.apply_cancellations(t, "complaint", AT)

    return {
        "rules_finance_links": _over_tables(rules.finance_links),
        "rules_transfers": _over_tables(rules.transfer_rules),
        "rules_assignments": _over_tables(rules.assignment_rules),
        "rules_dates": _over_tables(rules.date_rules),
        "vocabulary_counts": _over_tables(rules.vocabulary_counts),
        "rules_import": _over_tables(raw_invoice_rules),
        "imported_invoices": _over_tables(raw_invoice_rows),
        "rules_import_tables": _over_tables(table_rules),
        "imported_penalties": _over_tables(penalty_rows),
        "rules_portal_registration": _over_tables(rules.portal_rules),
        "student_role": _over_tables(rules.student_role),
        "application_checks": _over_tables(rules.application_checks, AS_OF),
        "transfer_request_checks": _over_tables(rules.transfer_request_checks, AS_OF),
        "cancel_requests": _over_tables(rules.cancel_requests),
        "complaints_after_cancelling": _over_tables(complaints_after),
        "status_edits": _over_tables(rules.status_edits, AS_OF),
        "announcement_marks": _over_tables(rules.announcement_marks, NOW),
        "receipts_after_marks": _over_tables(rules.receipts_after_marks, NOW),
        "notification_marks": _over_tables(rules.notification_marks),
        "notifications_after_marks": _over_tables(rules.notifications_after_marks),
    }


def _allocation_queries() -> dict[str, Query]:
    def reconciled(t: Tables) -> Tables:
        """Tables with logs, bed flags and room counters set right."""
        return reconcile.reconcile_housing(t, AT).tables

    def approvals(t: Tables) -> DataFrame:
        return allocation.approvals(reconciled(t), AT)


    def approved(t: Tables) -> tuple[Tables, Tables]:
        """Reconciled tables, and those tables with the approvals carried out."""
        before = reconciled(t)
        outcomes = cut_lineage(allocation.approvals(before, AT))
        return before, allocation.apply_approvals(before, outcomes, AT)

    def added(t: Tables, table: str, key: str, *columns: str) -> DataFrame:
        before, after = approved(t)
        return after[table].join(before[table], key, "left_anti").select(*columns)

    def moved(t: Tables) -> Tables:
        return moves.apply_moves(t, moves.complete_due(t, AT), AT)

    def stays_after(t: Tables) -> DataFrame:
        stays = moved(t).room_assignment.groupBy("StudentID", "RoomID", "Status")
        return stays.agg(F.count(F.lit(1)).alias("Stays"))

    return {
        "stays_from_approvals": _over_tables(
            added, "room_assignment", "AssignmentID", "AssignmentID", "StudentID", "RoomID", "BedSlotID", "ApplicationID",
            "CheckInDate", "Status", "MonthlyRent", "DepositAmount",
        ),
        "notices_from_approvals": _over_tables(
            added, "notification", "NotificationID", "NotificationID", "StudentID", "Title", "Message", "Channel", "Type",
            "IsRead", "PriorityLevel", "PublishDate", "Status",
        ),
        "transfers_after_moves": _over_tables(lambda t: moved(t).room_transfer),
        "stays_after_moves": _over_tables(stays_after),
        "completed_due_transfers": _over_tables(reconcile.move_counts, AT),
        "approve_applications": _over_tables(approvals),
        "rules_assignment_candidates": _over_tables(lambda t: candidates.assignment_candidates(reconciled(t))),
        "complete_due_transfers": _over_tables(moves.move_outcomes, AT),
        "visitor_intake_permissions": _over_tables(lambda t: allocation.visitor_intake(t, AT).permissions),
        "visitor_intake_visitors": _over_tables(lambda t: allocation.visitor_intake(t, AT).visitors),
        "new_account_students": _over_tables(lambda t: allocation.new_accounts(t).students),
        "new_account_users": _over_tables(lambda t: allocation.new_accounts(t).users),
    }


def _browse_queries() -> dict[str, Query]:
    def labels(t: Tables) -> DataFrame:
        return browse.row_labels(t, "student").unionByName(browse.row_labels(t, "system_user"))

    def enums(t: Tables) -> DataFrame:
        column_type = F.concat(
            F.lit("enum('"), "BuildingName", F.lit("','it''s "), "GenderAllowed", F.lit("')")
        )
        return t.building.select("BuildingID", F.array_join(enum_literals(column_type), "|").alias("enum_values"))

    def beds_from_sql(t: Tables) -> DataFrame:
        """A reporting view read by name."""
        views.available_bed_slots(t).createOrReplaceTempView("vw_AvailableBeds")
        return t.building.sparkSession.sql(
            "SELECT BuildingID, count(*) AS Beds FROM vw_AvailableBeds GROUP BY BuildingID"
        )

    def student_initials(t: Tables) -> DataFrame:
        return t.student.select("StudentID", initials(F.col("FirstName"), F.col("LastName")).alias("Initials"))

    def texts(t: Tables) -> DataFrame:
        return t.maintenance_request.select(
            "RequestID",
            shortened(F.col("Title"), 11).alias("ShortTitle"),
            status_slug(F.col("Status")).alias("StatusSlug"),
            text_or(F.col("Category"), "General").alias("CategoryText"),
        )

    def active_students(t: Tables) -> DataFrame:
        return browse.row_count(t, "student", F.col("Status") == "Active")

    def cascade(t: Tables) -> DataFrame:
        return browse.cascade_keys(t, "student", t.student.filter(F.col("Status") == "Graduated"))

    def closed_logs(t: Tables) -> DataFrame:
        doomed = t.room_assignment.filter(F.col("Status") == "Cancelled")
        return browse.logs_closed_by_delete(t, doomed, AS_OF)

    return {
        "table_scan_rooms": _over_tables(browse.scan, "room", ["RoomID", "RoomNumber", "Capacity"]),
        "row_count_active_students": _over_tables(active_students),
        "table_inventory": _over_tables(browse.table_inventory),
        "search_students": _over_tables(browse.search, "student", " Customer#0000000"),
        "matching_transfers": _over_tables(browse.matching_rows, "room_transfer", "1998"),
        "labels_students": _over_tables(labels),
        "labels_buildings": _over_tables(browse.row_labels, "building"),
        "export_invoices": _over_tables(lambda t: browse.display_rows(t.invoice)),
        "enum_literals": _over_tables(enums),
        "status_texts": _over_tables(texts),
        "student_initials": _over_tables(student_initials),
        "view_scan_available_beds": _over_tables(beds_from_sql),
        "cascade_delete_graduates": _over_tables(cascade),
        "logs_closed_by_delete": _over_tables(closed_logs),
    }


def _change_queries() -> dict[str, Query]:
    def changed_columns(t: Tables) -> DataFrame:
        later = later_tables(t, AT)
        parts = [changes.snapshot_changes(name, t[name], later[name]) for name in REPAIRED_TABLES]
        differing = F.filter(F.map_keys("new"), lambda c: ~F.col("new")[c].eqNullSafe(F.col("old")[c]))
        return union_all(parts).select("table_name", "operation", "row_key", F.array_join(differing, ",").alias("columns"))

    def batch(t: Tables) -> DataFrame:
        return changes.notifications_for(sample_rows(t, AT), t)

    def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same notices from a file stream, read back from the file sink."""
        t = testdata_tables(spark, sf_dir)
        root = new_folder(spark, "notices")
        changed = sample_rows(t, AT)
        notices.write_changes(changed, f"{root}/changes")
        stream = notices.read_rows(spark, changed, f"{root}/changes")
        query = notices.start_notices(stream, t, f"{root}/notices", f"{root}/progress")
        query.awaitTermination()
        return spark.read.parquet(f"{root}/notices")

    def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Changes from row images that arrive out of order; some rows are new and some are deleted."""
        t = testdata_tables(spark, sf_dir)
        later = later_tables(t, AT)
        root = new_folder(spark, "images")
        noon = F.lit(NOW)
        parts = []
        for name in REPAIRED_TABLES:
            part = F.pmod(F.col(KEYS[name][0]), F.lit(50))
            parts.append(images.row_images(name, t[name].filter(part != 1), noon, "base"))
            parts.append(images.row_images(name, later[name].filter(part != 0), noon + F.expr("INTERVAL 1 HOUR"), "save"))
            parts.append(images.row_images(name, t[name].filter(part == 0), noon + F.expr("INTERVAL 2 HOURS"), "delete"))
        arrival = F.xxhash64("row_key", "changed_at", "kind")
        files = images.write_in_turns(union_all(parts), f"{root}/images", 3, arrival)
        images.write_in_turns(images.end_of_images(spark, NOW + dt.timedelta(days=9)), f"{root}/images", 1, F.lit(0))
        stream = spark.readStream.schema(images.IMAGE_ROWS).option("maxFilesPerTrigger", files).parquet(f"{root}/images")
        pairs = images.paired_changes(stream, "1 day")
        writer = pairs.writeStream.format("parquet").option("path", f"{root}/pairs").option("checkpointLocation", f"{root}/progress")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema(pairs.schema).parquet(f"{root}/pairs")
        differing = F.filter(F.map_keys("new"), lambda c: ~F.col("new")[c].eqNullSafe(F.col("old")[c]))
        columns = F.when(F.col("operation") == "update", F.array_join(differing, ",")).otherwise("")
        return found.select("table_name", "operation", "row_key", columns.alias("columns"))

    def reconciled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Reconciled tables in a store; a stream of saved rows; what the rows it reaches hold in the end."""
        base = reconcile.reconcile_after(testdata_tables(spark, sf_dir), {"room", "invoice"}, AT, make_moves=False)
        names = {n for group in reach.GROUPS for r, called in group.steps for n in (r.table, *r.also, *called)}
        root = new_folder(spark, "reconciled")
        store = Store(spark, f"{root}/store", {n: KEYS[n] for n in sorted(names)}, 8).create(base)
        notices.write_images(sample_images(store.tables(), AT), f"{root}/images")
        stream = notices.read_images(spark, f"{root}/images")
        notices.start_reconciling(stream, store, AT, f"{root}/batches", f"{root}/progress").awaitTermination()
        t = store.tables()
        shown = {
            "room": ("RoomID", F.concat_ws("|", "CurrentOccupancy", "Status")),
            "bed_slot": ("BedSlotID", F.col("IsOccupied").cast("string")),
            "room_assignment": ("AssignmentID", F.concat_ws("|", "Status", "BedSlotID")),
            "occupancy_log": ("LogID", F.concat_ws("|", "AssignmentID", "EndDate")),
            "invoice": ("InvoiceID", F.col("PaymentStatus")),
            "system_user": ("UserID", F.col("Email")),
        }
        return union_all(
            [
                t[n].select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("row_key"), v.alias("value"))
                for n, (k, v) in shown.items()
            ]
        )

    def stored(spark: SparkSession, sf_dir: str) -> Tables:
        """Housing repairs carried out twice on stored tables, changed rows only."""
        names = {"room", "bed_slot", "room_assignment", "occupancy_log"}
        folder = new_folder(spark, "store")
        store = Store(spark, folder, {n: KEYS[n] for n in sorted(names)}, 8).create(testdata_tables(spark, sf_dir))
        for _ in range(2):
            done = reconcile.reconcile_housing(store.tables(), AT)
            log = cut_lineage(done.changes)
            changed = {n: cut_lineage(repairs.changed_rows(done.tables, log, n)) for n in store.keys}
            for name, rows in changed.items():
                store.table(name).merge(rows)
        return store.tables()

    return {
        "streamed_changes": streamed_changes,
        "reconciled_stream": reconciled_stream,
        "stored_rooms_after_repairs": lambda spark, sf_dir: stored(spark, sf_dir).room,
        "stored_logs_after_repairs": lambda spark, sf_dir: stored(spark, sf_dir).occupancy_log,
        "changed_columns": _over_tables(changed_columns),
        "notifications_batch": _over_tables(batch),
        "notifications_streaming": streamed,
    }


def queries() -> dict[str, Query]:
    return {
        **_check_queries(),
        **_fact_queries(),
        **_finance_queries(),
        **_listing_queries(),
        **_snapshot_queries(),
        **_view_queries(),
        **_repair_queries(),
        **_rule_queries(),
        **_allocation_queries(),
        **_browse_queries(),
        **_change_queries(),
    }
