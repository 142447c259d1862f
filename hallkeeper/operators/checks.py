"""Cross-table integrity checks.

A :class:`Check` names one or more conditions over one frame. The frame holds
one row per suspect key and a bigint column per condition: how many violations
that key stands for (more than one only where a join fans out). Rows and counts
come from the same frame, and conditions that share a frame share its scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import billed_total, date_value
from hallkeeper.functions.ranking import union_all
from hallkeeper.operators import facts
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active
from hallkeeper.tables import Tables


@dataclass(frozen=True)
class Check:
    """Conditions over one frame of ``row_key`` and a count column each."""

    names: tuple[str, ...]
    frame: Callable[[Tables, Column], DataFrame]


def _flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _keyed(df: DataFrame, key: str, **counts: Column) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("row_key"), *[value.alias(name) for name, value in counts.items()]
    )


def _all_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    return _keyed(df, key, **{name: F.lit(1).cast("bigint")})


def _approved_without_assignment(t: Tables, as_of: Column) -> DataFrame:
    approved = t.registration.filter(F.col("Status") == "Approved")
    return _all_rows(approved.join(t.room_assignment, "ApplicationID", "left_anti"), "ApplicationID", "approved_without_assignment")


def _missing_logs(t: Tables, as_of: Column) -> DataFrame:
    unlogged = active(t.room_assignment).join(t.occupancy_log, "AssignmentID", "left_anti")
    return _all_rows(unlogged, "AssignmentID", "missing_occupancy_logs")


def _room_state(t: Tables, as_of: Column) -> DataFrame:
    rooms = t.room.join(facts.active_per_room(t), "RoomID", "left")
    count = F.coalesce("ActiveCount", F.lit(0))
    return _keyed(
        rooms,
        "RoomID",
        occupancy_mismatch=_flag(F.coalesce("CurrentOccupancy", F.lit(0)) != count),
        room_status_mismatch=_flag(
            F.col("Status").isin(*ASSIGNABLE_ROOM) & (F.col("Status") != facts.derived_room_status())
        ),
        active_room_over_capacity=_flag(F.col("ActiveCount") > F.col("Capacity")),
    )


def _bed_occupancy(t: Tables, as_of: Column) -> DataFrame:
    beds = t.bed_slot.join(facts.active_per_bed(t), "BedSlotID", "left")
    used = F.coalesce("ActiveCount", F.lit(0)) > 0
    return _keyed(beds, "BedSlotID", bed_occupancy_mismatch=_flag(F.col("IsOccupied") != used))


def _missing_beds(t: Tables, as_of: Column) -> DataFrame:
    bedless = active(t.room_assignment).filter(F.col("BedSlotID").isNull())
    rows = bedless.join(t.bed_slot, "RoomID", "left_semi")
    return _all_rows(rows, "AssignmentID", "active_assignments_missing_bed_slots")


def _orphan_beds(t: Tables, as_of: Column) -> DataFrame:
    return _all_rows(t.bed_slot.join(t.room, "RoomID", "left_anti"), "BedSlotID", "orphan_bed_slots")


def _bed_room(t: Tables, as_of: Column) -> DataFrame:
    beds = t.bed_slot.select("BedSlotID", F.col("RoomID").alias("BedRoomID"))
    rows = t.room_assignment.filter(F.col("BedSlotID").isNotNull()).join(beds, "BedSlotID")
    return _all_rows(rows.filter(F.col("RoomID") != F.col("BedRoomID")), "AssignmentID", "assignment_bed_room_mismatch")


def _application_student(t: Tables, as_of: Column) -> DataFrame:
    applicants = t.registration.select("ApplicationID", F.col("StudentID").alias("ApplicantID"))
    rows = t.room_assignment.filter(F.col("ApplicationID").isNotNull()).join(applicants, "ApplicationID")
    rows = rows.filter(F.col("StudentID") != F.col("ApplicantID"))
    return _all_rows(rows, "AssignmentID", "assignment_application_student_mismatch")


def _unavailable_room(t: Tables, as_of: Column) -> DataFrame:
    buildings = t.building.select("BuildingID", F.col("Status").alias("BuildingStatus"))
    closed = (
        t.room.select("RoomID", "BuildingID", F.col("Status").alias("RoomStatus"))
        .join(buildings, "BuildingID")
        .filter(~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM) | (F.col("BuildingStatus") != "Active"))
    )
    rows = active(t.room_assignment).join(closed, "RoomID")
    return _all_rows(rows, "AssignmentID", "active_assignment_in_unavailable_room")


def _missing_time(table: str, key: str, column: str, name: str) -> Check:
    def frame(t: Tables, as_of: Column) -> DataFrame:
        late = t[table].filter(F.col("Status").isin("Resolved", "Closed") & F.col(column).isNull())
        return _all_rows(late, key, name)

    return Check((name,), frame)


DECIDED = {
    "registration": ("ApplicationID", ("Approved", "Rejected", "Cancelled")),
    "room_transfer": ("TransferID", ("Approved", "Rejected", "Completed", "Cancelled")),
    "leave_permission": ("PermissionID", ("Approved", "Rejected", "Cancelled")),
    "visitor_permission": ("PermissionID", ("Approved", "Rejected", "Expired")),
}
"""Statuses that count as a decision, per table, with the table's key."""


def _decisions(t: Tables, as_of: Column) -> DataFrame:
    parts = []
    for table, (key, statuses) in DECIDED.items():
        rows = t[table].filter(F.col("Status").isin(*statuses) & F.col("ApprovalDate").isNull())
        tagged = rows.select(F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("tagged_key"))
        parts.append(_all_rows(tagged, "tagged_key", "decisions_missing_dates"))
    return union_all(parts)


def _invoice_status(t: Tables, as_of: Column) -> DataFrame:
    invoices = t.invoice.join(facts.paid_per_invoice(t), "InvoiceID", "left").withColumn("BilledTotal", billed_total())
    wrong = F.col("PaymentStatus") != facts.derived_invoice_status(as_of)
    return _keyed(invoices, "InvoiceID", invoice_status_mismatch=_flag(wrong))


def unmoved_transfers(t: Tables) -> DataFrame:
    """Transfers whose student has no active assignment in the destination room."""
    destination = active(t.room_assignment).select("StudentID", F.col("RoomID").alias("ToRoomID"))
    return t.room_transfer.filter(F.col("Status").isin("Completed", "Approved")).join(
        destination, ["StudentID", "ToRoomID"], "left_anti"
    )


def due(as_of: Column) -> Column:
    """Approved, and the move date (today when not given) has come."""
    return (F.col("Status") == "Approved") & (F.coalesce(F.col("EffectiveMoveDate"), as_of) <= as_of)


def _transfers(t: Tables, as_of: Column) -> DataFrame:
    return _keyed(
        unmoved_transfers(t),
        "TransferID",
        completed_transfers_without_new_assignment=_flag(F.col("Status") == "Completed"),
        approved_transfers_due_without_move=_flag(due(as_of)),
    )


def _payment_student(t: Tables, as_of: Column) -> DataFrame:
    owners = t.invoice.select("InvoiceID", F.col("StudentID").alias("InvoiceStudentID"))
    payments = t.payment_transaction.select("TransactionID", "InvoiceID", "StudentID").join(owners, "InvoiceID")
    wrong = payments.filter(F.col("StudentID") != F.col("InvoiceStudentID"))
    counted = wrong.groupBy("TransactionID").agg(F.count(F.lit(1)).alias("n"))
    return _keyed(counted, "TransactionID", payment_student_mismatch=F.col("n"))


def _account_profile(t: Tables, as_of: Column) -> DataFrame:
    students = t.student.select(
        "StudentID",
        F.col("Email").alias("StudentEmail"),
        F.col("FirstName").alias("StudentFirst"),
        F.col("LastName").alias("StudentLast"),
    )
    accounts = t.system_user.join(students, "StudentID")
    blank = F.lit("")
    differs = (
        (F.col("Email") != F.col("StudentEmail"))
        | (F.coalesce("FirstName", blank) != F.coalesce("StudentFirst", blank))
        | (F.coalesce("LastName", blank) != F.coalesce("StudentLast", blank))
    )
    return _all_rows(accounts.filter(differs), "UserID", "student_account_profile_mismatch")


def accounts_per_student(t: Tables) -> DataFrame:
    """(StudentID, Accounts, StudentAccounts) over active portal accounts."""
    roles = t.role.filter(F.lower("RoleName").contains("student")).select("RoleID", F.lit(1).alias("IsStudent"))
    users = t.system_user.filter((F.col("Status") == "Active") & F.col("StudentID").isNotNull())
    return (
        users.join(roles, "RoleID", "left")
        .groupBy("StudentID")
        .agg(F.count(F.lit(1)).alias("Accounts"), F.count("IsStudent").alias("StudentAccounts"))
    )


def _no_portal_account(t: Tables, as_of: Column) -> DataFrame:
    students = t.student.filter(F.col("Status") == "Active").join(accounts_per_student(t), "StudentID", "left")
    # A student without any active account gives one joined row; with accounts,
    # one row for each of them that has no student role.
    rows = F.coalesce(F.col("Accounts") - F.col("StudentAccounts"), F.lit(1)).cast("bigint")
    return _keyed(students, "StudentID", active_students_without_portal_account=rows)


def students_without_any_student_account(t: Tables) -> DataFrame:
    """The distinct variant: active students with no active student-role account."""
    owners = accounts_per_student(t).filter(F.col("StudentAccounts") > 0)
    return t.student.filter(F.col("Status") == "Active").join(owners, "StudentID", "left_anti").select("StudentID")


def _past(table: str, key: str, status: str, column: str, name: str) -> Check:
    def frame(t: Tables, as_of: Column) -> DataFrame:
        return _all_rows(t[table].filter((F.col("Status") == status) & (F.col(column) < as_of)), key, name)

    return Check((name,), frame)


def _inspection_rollup(t: Tables, as_of: Column) -> DataFrame:
    latest = facts.latest_inspections(t).withColumnRenamed("FurnitureCondition", "SeenCondition")
    rooms = t.room.join(latest, "RoomID")
    stale = (
        (F.col("LastInspectionDate") != F.col("InspectionDate"))
        | F.col("LastInspectionDate").isNull()
        | (F.coalesce("FurnitureCondition", F.lit("")) != F.coalesce("SeenCondition", F.lit("")))
    )
    wrong = rooms.filter(stale).groupBy("RoomID").agg(F.sum("Inspections").alias("n"))
    return _keyed(wrong, "RoomID", room_inspection_rollup_mismatch=F.col("n"))


def _maintenance_rollup(t: Tables, as_of: Column) -> DataFrame:
    seen = facts.last_maintenance(t).withColumnRenamed("LastMaintenanceDate", "SeenDate")
    buildings = t.building.join(seen, "BuildingID")
    stale = (F.col("LastMaintenanceDate") != F.col("SeenDate")) | F.col("LastMaintenanceDate").isNull()
    return _all_rows(buildings.filter(stale), "BuildingID", "building_maintenance_rollup_mismatch")


def _checkout(t: Tables, as_of: Column) -> DataFrame:
    wrong = t.room_assignment.filter(F.col("ActualCheckOutDate") < F.col("CheckInDate"))
    return _all_rows(wrong, "AssignmentID", "assignment_checkout_before_checkin")


def _move_before_checkin(t: Tables, as_of: Column) -> DataFrame:
    moved = t.room_transfer.filter((F.col("Status") == "Completed") & F.col("EffectiveMoveDate").isNotNull()).select(
        "TransferID", "StudentID", F.col("FromRoomID").alias("RoomID"), "EffectiveMoveDate"
    )
    sources = t.room_assignment.filter(F.col("Status") == "Completed")
    counted = facts.later_counts(moved, "EffectiveMoveDate", sources, "CheckInDate", ["StudentID", "RoomID"], "n")
    return _keyed(counted, "TransferID", transfer_move_before_source_checkin=F.coalesce("n", F.lit(0)).cast("bigint"))


CHECKS: tuple[Check, ...] = (
    Check(("approved_without_assignment",), _approved_without_assignment),
    Check(("missing_occupancy_logs",), _missing_logs),
    Check(("occupancy_mismatch", "room_status_mismatch", "active_room_over_capacity"), _room_state),
    Check(("bed_occupancy_mismatch",), _bed_occupancy),
    Check(("active_assignments_missing_bed_slots",), _missing_beds),
    Check(("orphan_bed_slots",), _orphan_beds),
    Check(("assignment_bed_room_mismatch",), _bed_room),
    Check(("assignment_application_student_mismatch",), _application_student),
    Check(("active_assignment_in_unavailable_room",), _unavailable_room),
    _missing_time("maintenance_request", "RequestID", "ResolvedAt", "resolved_maintenance_missing_timestamp"),
    _missing_time("complaint", "ComplaintID", "ClosedAt", "closed_complaints_missing_timestamp"),
    _missing_time("incident_report", "ReportID", "ResolvedAt", "resolved_incidents_missing_timestamp"),
    Check(("decisions_missing_dates",), _decisions),
    Check(("invoice_status_mismatch",), _invoice_status),
    Check(("completed_transfers_without_new_assignment", "approved_transfers_due_without_move"), _transfers),
    Check(("payment_student_mismatch",), _payment_student),
    Check(("student_account_profile_mismatch",), _account_profile),
    Check(("active_students_without_portal_account",), _no_portal_account),
    _past("visitor_permission", "PermissionID", "Approved", "EndDate", "stale_visitor_permissions"),
    _past("meal_subscription", "SubscriptionID", "Active", "EndDate", "stale_meal_subscriptions"),
    _past("penalty", "PenaltyID", "Pending", "DueDate", "pending_penalties_past_due"),
    Check(("room_inspection_rollup_mismatch",), _inspection_rollup),
    Check(("building_maintenance_rollup_mismatch",), _maintenance_rollup),
    Check(("assignment_checkout_before_checkin",), _checkout),
    Check(("transfer_move_before_source_checkin",), _move_before_checkin),
)

CHECK_NAMES: tuple[str, ...] = tuple(name for check in CHECKS for name in check.names)


def violations(t: Tables, name: str, as_of: dt.date) -> DataFrame:
    """Violating rows of one check: (check_name, row_key, violations)."""
    check = next(check for check in CHECKS if name in check.names)
    frame = check.frame(t, date_value(as_of))
    return frame.filter(F.col(name) > 0).select(
        F.lit(name).alias("check_name"), "row_key", F.col(name).alias("violations")
    )


def integrity_snapshot(t: Tables, as_of: dt.date, names: tuple[str, ...] = CHECK_NAMES) -> DataFrame:
    """(check_name, violations) for every check, zero counts kept."""
    parts = []
    for check in CHECKS:
        wanted = [name for name in check.names if name in names]
        if not wanted:
            continue
        totals = check.frame(t, date_value(as_of)).agg(
            *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in wanted]
        )
        pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in wanted])
        parts.append(totals.select(F.inline(pairs)))
    return union_all(parts)
