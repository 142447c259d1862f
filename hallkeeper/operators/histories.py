"""History lists, recent-item lists and nested collections per parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.ranking import Cell, id_block, row_rank, top_per_key
from hallkeeper.tables import Tables

PAGE_SIZE = 100
"""Items per nested page. A long list spreads over pages; nothing is cut off."""


def newest_first(df: DataFrame, key: str, moment: str, row_id: str, ties: Sequence[str] = (), out: str = "seq") -> DataFrame:
    """Number the rows of each key newest first (by moment, then id)."""
    present = df.filter(F.col(key).isNotNull())
    order = [F.desc(moment), F.desc(row_id), *[F.asc(c) for c in ties]]
    cells = [Cell(F.to_date(F.col(moment)), True), Cell(id_block(row_id), True)]
    return row_rank(present, [key], order, cells, out)


def payment_history(t: Tables) -> DataFrame:
    payments = t.payment_transaction.select(
        "TransactionID", "InvoiceID", "StudentID", "PaymentAmount", "PaymentDate", "PaymentStatus"
    )
    return newest_first(
        payments, "StudentID", "PaymentDate", "TransactionID", ("PaymentAmount", "PaymentStatus", "InvoiceID")
    )


def penalty_history(t: Tables) -> DataFrame:
    return newest_first(t.penalty, "StudentID", "PenaltyDate", "PenaltyID")


def incident_history(t: Tables) -> DataFrame:
    return newest_first(t.incident_report, "StudentID", "IncidentDate", "ReportID")


def leave_history(t: Tables) -> DataFrame:
    return newest_first(t.leave_permission, "StudentID", "RequestDate", "PermissionID")


def visitor_history(t: Tables) -> DataFrame:
    """Visitor permissions with the visitor's name."""
    visitors = t.visitor.select("VisitorID", F.concat_ws(" ", "FirstName", "LastName").alias("VisitorName"))
    permissions = t.visitor_permission.join(visitors, "VisitorID", "left")
    return newest_first(permissions, "StudentID", "RequestDate", "PermissionID")


def transfer_history(t: Tables) -> DataFrame:
    return newest_first(t.room_transfer, "StudentID", "RequestDate", "TransferID")


def application_history(t: Tables) -> DataFrame:
    return newest_first(t.registration, "StudentID", "ApplicationDate", "ApplicationID")


def lost_and_found_history(t: Tables) -> DataFrame:
    return newest_first(t.lost_and_found_item, "ReportedBy", "ReportDate", "ItemID")


def meal_subscription_history(t: Tables) -> DataFrame:
    return newest_first(t.meal_subscription, "StudentID", "StartDate", "SubscriptionID")


def maintenance_history(t: Tables) -> DataFrame:
    """Requests of each reporting student."""
    return newest_first(t.maintenance_request, "ReportedByStudentID", "ReportedAt", "RequestID")


def complaint_history(t: Tables) -> DataFrame:
    return newest_first(t.complaint, "StudentID", "SubmittedAt", "ComplaintID")


def recent_meals(t: Tables, k: int = 10) -> DataFrame:
    return top_per_key(
        t.meal_attendance, ["StudentID"], [F.desc("MealDate"), F.desc("CheckInDateTime"), F.desc("AttendanceID")], k
    )


def recent_laundry(t: Tables, k: int = 10) -> DataFrame:
    """Last laundry uses with the machine's building and service."""
    machines = t.laundry.select("LaundryID", "ServiceID", "BuildingID")
    buildings = t.building.select("BuildingID", "BuildingName")
    services = t.dorm_service.select("ServiceID", F.col("Name").alias("ServiceName"))
    recent = top_per_key(t.laundry_usage, ["StudentID"], [F.desc("UsageDate"), F.desc("UsageID")], k)
    return (
        recent.join(machines, "LaundryID", "left")
        .join(buildings, "BuildingID", "left")
        .join(services, "ServiceID", "left")
        .select("StudentID", "rn", "UsageID", "UsageDate", "Duration", "BuildingName", "ServiceName")
    )


def recent_access(t: Tables, k: int = 10) -> DataFrame:
    """Last access events with the building's name."""
    recent = top_per_key(t.access_log, ["StudentID"], [F.desc("LogTime"), F.desc("LogID")], k)
    return recent.join(t.building.select("BuildingID", "BuildingName"), "BuildingID", "left")


def recent_inspections(t: Tables, k: int = 5) -> DataFrame:
    """Last inspections of each room."""
    ties = [F.asc(c) for c in ("Status", "FurnitureCondition", "FollowUpRequired")]
    return top_per_key(t.room_inspection, ["RoomID"], [F.desc("InspectionDate"), F.desc("InspectionID"), *ties], k)


def latest_requests(t: Tables, k: int = 3) -> DataFrame:
    """Last maintenance requests of each reporting student."""
    requests = t.maintenance_request.filter(F.col("ReportedByStudentID").isNotNull())
    return top_per_key(requests, ["ReportedByStudentID"], [F.desc("ReportedAt"), F.desc("RequestID")], k)


def nested_pages(
    children: DataFrame,
    key: str,
    seq: str,
    item: Sequence[Column],
    parents: DataFrame,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Parents with their children as JSON arrays of at most ``page_size`` items.

    ``seq`` numbers the children of a parent from 1. Childless parents keep one
    row with an empty array. Items are grouped by parent and page before parents
    are looked up; the pages of a large parent then meet in a join straight from
    a shuffle, which adaptive execution can split.
    """
    page = F.floor((F.col(seq) - 1) / F.lit(page_size)).cast("bigint")
    entries = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("__seq"), F.struct(*item).alias("item"))))
    pages = (
        children.withColumn("Page", page)
        .groupBy(key, "Page")
        .agg(F.to_json(F.transform(entries, lambda e: e["item"]), {"ignoreNullFields": "false"}).alias("Items"))
        .join(parents.select(key), key, "left_semi")
    )
    childless = parents.select(key).join(children.select(key).distinct(), key, "left_anti")
    empty = childless.select(key, F.lit(0).cast("bigint").alias("Page"), F.lit("[]").alias("Items"))
    return pages.unionByName(empty)


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def maintenance_logs_nested(t: Tables) -> DataFrame:
    """Every maintenance request with its work logs, newest first."""
    logs = newest_first(t.maintenance_log, "RequestID", "LoggedAt", "LogID")
    item = [F.col("LogID"), F.col("ActionTaken"), _text("Cost")]
    return nested_pages(logs, "RequestID", "seq", item, t.maintenance_request)


def application_assignments_nested(t: Tables) -> DataFrame:
    """Every application with its room assignments, newest first."""
    rooms = t.room.join(t.building, "BuildingID").select("RoomID", "RoomNumber", "BuildingName")
    numbered = newest_first(
        t.room_assignment.select("ApplicationID", "AssignmentID", "RoomID", "CheckInDate", "Status"),
        "ApplicationID",
        "CheckInDate",
        "AssignmentID",
    )
    item = [F.col("AssignmentID"), F.col("RoomNumber"), F.col("BuildingName"), _text("CheckInDate"), F.col("Status")]
    return nested_pages(numbered.join(rooms, "RoomID", "left"), "ApplicationID", "seq", item, t.registration)


def invoice_payments_nested(t: Tables) -> DataFrame:
    """Every invoice with its completed payments, newest first."""
    completed = t.payment_transaction.filter(F.col("PaymentStatus") == "Completed").select(
        "InvoiceID", "TransactionID", "PaymentDate", "PaymentAmount", "StudentID"
    )
    numbered = newest_first(completed, "InvoiceID", "PaymentDate", "TransactionID", ("PaymentAmount", "StudentID"))
    item = [F.col("TransactionID"), _text("PaymentDate"), _text("PaymentAmount")]
    return nested_pages(numbered, "InvoiceID", "seq", item, t.invoice)


def programs_by_faculty(t: Tables) -> DataFrame:
    """Active programs of each faculty by name, in pages."""
    programs = t.academic_program.filter(F.col("Status") == "Active").select("FacultyID", "ProgramID", "Name")
    # Ids are unique, so a block bounds each cell; the name's first letters order the blocks.
    numbered = row_rank(
        programs,
        ["FacultyID"],
        [F.asc("Name"), F.asc("ProgramID")],
        [Cell(F.substring("Name", 1, 2)), Cell(F.col("Name")), Cell(id_block("ProgramID"))],
        "seq",
    )
    item = [F.col("ProgramID").cast("string").alias("id"), F.col("Name").alias("name")]
    return nested_pages(numbered, "FacultyID", "seq", item, programs.select("FacultyID").distinct())
