"""Dashboard metrics and reporting views.

Where the source only names a view, the definition here is our own and its
docstring says so.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import date_value, full_name, nonneg, percent_text, valid_at
from hallkeeper.functions.ranking import union_all
from hallkeeper.operators import checks, facts, finance, queues
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active, available_beds, free_bed
from hallkeeper.tables import Tables


def _count(df: DataFrame, name: str) -> DataFrame:
    """One row (metric, n)."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")


def capacity(t: Tables) -> DataFrame:
    """One row of the capacity numbers behind the occupancy KPI."""
    beds = t.bed_slot.select(F.count(F.lit(1)).alias("beds"), F.count_if(free_bed()).alias("free"))
    seats = t.room.select(F.coalesce(F.sum("Capacity"), F.lit(0)).alias("seats"))
    open_rooms = t.room.filter(F.col("Status").isin(*ASSIGNABLE_ROOM)).join(
        t.building.filter(F.col("Status") == "Active"), "BuildingID", "left_semi"
    )
    free_seats = open_rooms.select(
        F.coalesce(F.sum(nonneg(F.col("Capacity") - F.coalesce("CurrentOccupancy", F.lit(0)))), F.lit(0)).alias("n")
    )
    residents = active(t.room_assignment).select(F.count(F.lit(1)).alias("ActiveAssignments"))
    physical = F.col("beds") > 0
    return residents.select(
        "ActiveAssignments",
        beds.select("beds").scalar().alias("beds"),
        beds.select("free").scalar().alias("free_beds"),
        seats.scalar().alias("seats"),
        free_seats.scalar().alias("free_seats"),
    ).select(
        "ActiveAssignments",
        F.when(physical, F.col("beds")).otherwise(F.col("seats")).cast("bigint").alias("TotalCapacity"),
        F.when(physical, F.col("free_beds")).otherwise(F.col("free_seats")).cast("bigint").alias("AvailableBeds"),
        F.when(physical, "physical bed slots").otherwise("configured room capacity").alias("CapacityKind"),
    )


def dashboard_kpis(t: Tables) -> DataFrame:
    """(metric, value): the four headline figures, as shown text."""
    students = _count(t.student.filter(F.col("Status") == "Active"), "Active Students")
    rooms = queues._open(queues.rooms_with_beds(t)).filter(queues._has_seat() & facts.has_assignable_bed())
    maintenance = t.maintenance_request.filter(F.col("Status").isin("Open", "In Progress"))
    counts = [students, _count(rooms, "Available Rooms"), _count(maintenance, "Open Maintenance")]
    occupancy = capacity(t).select(
        F.lit("Occupancy").alias("metric"),
        percent_text(F.col("ActiveAssignments"), F.col("TotalCapacity")).alias("value"),
    )
    return union_all([c.select("metric", F.col("n").cast("string").alias("value")) for c in counts] + [occupancy])


def priority_queues(t: Tables, as_of: dt.date) -> DataFrame:
    """(metric, n): the eight queues that need staff."""
    pending = F.col("Status") == "Pending"
    unassigned = t.registration.filter(F.col("Status") == "Approved").join(
        t.room_assignment, "ApplicationID", "left_anti"
    )
    critical = (F.col("Priority") == "Critical") & ~F.col("Status").isin("Closed", "Cancelled")
    no_account = checks.integrity_snapshot(
        t, as_of, ("active_students_without_portal_account",)
    ).select(F.lit("Active students without portal account").alias("metric"), F.col("violations").alias("n"))
    return union_all(
        [
            _count(t.registration.filter(F.col("Status").isin("Pending", "Waitlisted")), "Pending housing applications"),
            _count(unassigned, "Approved applications awaiting assignment"),
            _count(t.invoice.filter(F.col("PaymentStatus") == "Overdue"), "Overdue invoices"),
            _count(t.maintenance_request.filter(critical), "Critical maintenance"),
            _count(t.complaint.filter(F.col("Status").isin("Open", "In Progress")), "Open complaints"),
            _count(t.leave_permission.filter(pending), "Pending leave permissions"),
            _count(t.visitor_permission.filter(pending), "Pending visitor approvals"),
            no_account,
        ]
    )


def activity_metrics(t: Tables, as_of: dt.date) -> DataFrame:
    """(metric, n): the six activity figures."""
    today = date_value(as_of)
    beds = capacity(t).select(F.lit("Available bed slots").alias("metric"), F.col("AvailableBeds").alias("n"))
    recent = t.payment_transaction.filter(F.col("PaymentDate") >= F.date_sub(today, 30))
    return union_all(
        [
            beds,
            _count(_actionable(t), "Actionable inspections"),
            _count(_expiring(t, as_of), "Expiring contracts"),
            _count(_blacklisted(t, as_of), "Active blacklist"),
            _count(recent, "Recent payments"),
            _count(t.meal_attendance.filter(F.col("MealDate") == today), "Meal check-ins"),
        ]
    )


def student_directory(t: Tables) -> DataFrame:
    """Students with faculty and program (own definition)."""
    faculties = t.faculty.select("FacultyID", F.col("Name").alias("FacultyName"))
    programs = t.academic_program.select("ProgramID", F.col("Name").alias("ProgramName"))
    return (
        t.student.join(faculties, "FacultyID", "left")
        .join(programs, "ProgramID", "left")
        .select("StudentID", full_name().alias("StudentName"), "Email", "Status", "FacultyName", "ProgramName")
    )


def room_occupancy(t: Tables) -> DataFrame:
    """Capacity, occupancy and beds of every room (own definition)."""
    rooms = facts.with_bed_counts(t.room, t).join(t.building.select("BuildingID", "BuildingName"), "BuildingID")
    return rooms.select(
        "RoomID",
        "BuildingName",
        "RoomNumber",
        "Capacity",
        "CurrentOccupancy",
        F.col("TotalBeds").cast("bigint").alias("TotalBeds"),
        available_beds().alias("AvailableBeds"),
    )


def building_capacity(t: Tables) -> DataFrame:
    """Rooms, seats, beds and residents per building (own definition).

    Beds and residents shrink to one row per room first.
    """
    rooms = facts.with_bed_counts(t.room.select("RoomID", "BuildingID", "Capacity"), t).join(
        facts.active_per_room(t), "RoomID", "left"
    )
    residents = F.coalesce("ActiveCount", F.lit(0))
    per_building = rooms.groupBy("BuildingID").agg(
        F.count(F.lit(1)).alias("Rooms"),
        F.sum("Capacity").cast("bigint").alias("ConfiguredCapacity"),
        F.sum("TotalBeds").cast("bigint").alias("Beds"),
        F.sum(residents).cast("bigint").alias("ActiveAssignments"),
        F.sum(F.greatest(F.col("Capacity") - residents, F.lit(0))).cast("bigint").alias("FreeCapacity"),
    )
    numbers = ["Rooms", "ConfiguredCapacity", "Beds", "ActiveAssignments", "FreeCapacity"]
    return t.building.select("BuildingID", "BuildingName").join(per_building, "BuildingID", "left").fillna(0, numbers)


def available_bed_slots(t: Tables) -> DataFrame:
    """Free, unreserved beds in assignable rooms of active buildings."""
    rooms = t.room.filter(F.col("Status").isin(*ASSIGNABLE_ROOM)).join(
        t.building.filter(F.col("Status") == "Active"), "BuildingID", "left_semi"
    )
    beds = t.bed_slot.filter(free_bed())
    return beds.join(rooms.select("RoomID", "BuildingID"), "RoomID").select(
        "BedSlotID", "RoomID", "BuildingID", "BedNumber"
    )


def _actionable(t: Tables) -> DataFrame:
    return t.room_inspection.filter((F.col("Status") == "Failed") | F.col("FollowUpRequired"))


def actionable_inspections(t: Tables) -> DataFrame:
    """Inspections that failed or need a follow-up."""
    return _actionable(t).select("InspectionID", "RoomID", "InspectionDate", "Status", "FollowUpRequired")


def active_maintenance(t: Tables) -> DataFrame:
    """Open requests with room, building and reporter."""
    places = t.room.join(t.building.select("BuildingID", "BuildingName"), "BuildingID").select(
        "RoomID", "RoomNumber", "BuildingName"
    )
    reporters = t.student.select(F.col("StudentID").alias("ReportedByStudentID"), full_name().alias("ReporterName"))
    return (
        t.maintenance_request.filter(F.col("Status").isin("Open", "In Progress"))
        .join(places, "RoomID", "left")
        .join(reporters, "ReportedByStudentID", "left")
        .select(
            "RequestID", "Title", "Priority", "Status", "ReportedAt", "RoomNumber", "BuildingName",
            "ReportedByStudentID", "ReporterName",
        )
    )


def _expiring(t: Tables, as_of: dt.date) -> DataFrame:
    today = date_value(as_of)
    return active(t.room_assignment).filter(F.col("CheckOutDate").between(today, F.date_add(today, 30)))


def expiring_contracts(t: Tables, as_of: dt.date) -> DataFrame:
    """Active assignments that end within 30 days."""
    return _expiring(t, as_of).select(
        "AssignmentID",
        "StudentID",
        "RoomID",
        "CheckOutDate",
        F.datediff("CheckOutDate", date_value(as_of)).cast("bigint").alias("DaysLeft"),
    )


def _blacklisted(t: Tables, as_of: dt.date) -> DataFrame:
    return t.blacklist.filter(
        (F.col("Status") == "Active") & (F.col("EndDate").isNull() | (F.col("EndDate") >= date_value(as_of)))
    )


def active_blacklist(t: Tables, as_of: dt.date) -> DataFrame:
    """Blacklist records in force, with the student's name."""
    names = t.student.select("StudentID", full_name().alias("StudentName"))
    return _blacklisted(t, as_of).join(names, "StudentID", "left").select(
        "BlacklistID", "StudentID", "StudentName", "StartDate", "EndDate"
    )


def daily_meals(t: Tables, as_of: dt.date) -> DataFrame:
    """Attendance of one day by meal type."""

    def n(status: str):
        return F.count_if(F.col("AttendanceStatus") == status).alias(status)

    today = t.meal_attendance.filter(F.col("MealDate") == date_value(as_of))
    return today.groupBy("MealDate", "MealType").agg(
        n("Present"), n("Absent"), n("Late"), F.count(F.lit(1)).alias("Total")
    )


def active_leave(t: Tables, as_of: dt.date) -> DataFrame:
    """Approved leave running on the day (own definition)."""
    running = valid_at(F.col("StartDate"), F.col("EndDate"), date_value(as_of))
    return t.leave_permission.filter((F.col("Status") == "Approved") & running).select(
        "PermissionID", "StudentID", "StartDate", "EndDate"
    )


def maintenance_kpis(t: Tables) -> DataFrame:
    """Requests, resolutions and mean resolution hours by month (own definition).

    A missing reporter or room does not matter here; months come from ReportedAt.
    """
    seconds = F.timestamp_diff("SECOND", F.col("ReportedAt"), F.col("ResolvedAt"))
    hours = F.when(F.col("ResolvedAt").isNotNull(), seconds / F.lit(3600.0))
    return t.maintenance_request.groupBy(F.trunc(F.to_date("ReportedAt"), "month").alias("Month")).agg(
        F.count(F.lit(1)).alias("Requests"),
        F.count("ResolvedAt").alias("Resolved"),
        F.count_if(F.col("Status").isin("Open", "In Progress")).alias("OpenNow"),
        F.round(F.avg(hours), 2).alias("AvgResolutionHours"),
    )


VIEWS = {
    "StudentDirectory": lambda t, as_of: student_directory(t),
    "RoomOccupancy": lambda t, as_of: room_occupancy(t),
    "ActiveMaintenanceRequests": lambda t, as_of: active_maintenance(t),
    "StudentFinancials": lambda t, as_of: finance.student_financials(t),
    "BuildingCapacityOverview": lambda t, as_of: building_capacity(t),
    "AvailableBeds": lambda t, as_of: available_bed_slots(t),
    "ActionableInspections": lambda t, as_of: actionable_inspections(t),
    "ExpiringContracts": expiring_contracts,
    "ActiveBlacklist": active_blacklist,
    "DailyMealSummary": daily_meals,
    "ActiveLeavePermissions": active_leave,
    "MonthlyRevenue": lambda t, as_of: finance.monthly_revenue(t),
    "MaintenanceKPIs": lambda t, as_of: maintenance_kpis(t),
    "OverdueInvoicesAlert": finance.overdue_invoices,
}
"""Reporting views by name; each takes the tables and the reference date."""


def register_views(t: Tables, as_of: dt.date) -> list[str]:
    """Make every reporting view readable from SQL as ``vw_<name>``."""
    for name, view in VIEWS.items():
        view(t, as_of).createOrReplaceTempView(f"vw_{name}")
    return [f"vw_{name}" for name in VIEWS]
