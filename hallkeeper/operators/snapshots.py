"""Per-student snapshots, profiles and JSON documents, for all students at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import zero_money
from hallkeeper.functions.ranking import first_per_key, union_all
from hallkeeper.functions.skew import spread_join
from hallkeeper.operators import facts, finance, histories, queues
from hallkeeper.operators.facts import active
from hallkeeper.tables import Tables

OPEN_REQUEST = ("Open", "In Progress")


def latest_application(t: Tables) -> DataFrame:
    """Newest application per student."""
    return first_per_key(t.registration, ["StudentID"], [F.desc("ApplicationDate"), F.desc("ApplicationID")])


def active_blacklist_entry(t: Tables) -> DataFrame:
    """First blacklist record per student whose status is Active (dates not looked at)."""
    entries = t.blacklist.filter(F.col("Status") == "Active")
    return first_per_key(entries, ["StudentID"], [F.asc("BlacklistID")])


def _count_by_student(df: DataFrame, key: str, statuses: tuple[str, ...], out: str) -> DataFrame:
    return (
        df.filter(F.col("Status").isin(*statuses) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("StudentID"))
        .agg(F.count(F.lit(1)).alias(out))
    )


def records_snapshot(t: Tables) -> DataFrame:
    """Active blacklist record, open incidents and open penalties of every student."""
    blacklisted = active_blacklist_entry(t).select("StudentID", F.col("BlacklistID").alias("ActiveBlacklistID"))
    incidents = _count_by_student(t.incident_report, "StudentID", ("Open", "Investigating"), "incidents")
    return (
        finance.penalty_summary(t)
        .join(blacklisted, "StudentID", "left")
        .join(incidents, "StudentID", "left")
        .select(
            "StudentID",
            "ActiveBlacklistID",
            F.coalesce("incidents", F.lit(0)).cast("bigint").alias("OpenIncidents"),
            "PendingPenaltyTotal",
            "PendingPenaltyCount",
        )
    )


def dashboard_snapshot(t: Tables, now: dt.datetime) -> DataFrame:
    """One wide row per student: room, open work, balance, notices, records.

    Every input is first reduced to one row per student, so the joins never
    multiply rows and share the StudentID partitioning.
    """
    room = facts.current_assignment(t).select("StudentID", "AssignmentID", "RoomID")
    application = latest_application(t).select(
        "StudentID",
        F.col("ApplicationID").alias("LatestApplicationID"),
        F.col("Status").alias("LatestApplicationStatus"),
    )
    maintenance = _count_by_student(t.maintenance_request, "ReportedByStudentID", OPEN_REQUEST, "maintenance")
    complaints = _count_by_student(t.complaint, "StudentID", OPEN_REQUEST, "complaints")
    wide = records_snapshot(t).join(queues.unread_counts(t, now), "StudentID", "left")
    for part in (room, application, maintenance, complaints, finance.unpaid_totals(t)):
        wide = wide.join(part, "StudentID", "left")
    return wide.select(
        "StudentID",
        "AssignmentID",
        "RoomID",
        F.coalesce("maintenance", F.lit(0)).cast("bigint").alias("ActiveMaintenance"),
        F.coalesce("complaints", F.lit(0)).cast("bigint").alias("OpenComplaints"),
        F.coalesce("UnpaidTotal", zero_money()).alias("UnpaidTotal"),
        "UnreadAnnouncements",
        "UnreadNotifications",
        "LatestApplicationID",
        "LatestApplicationStatus",
        "ActiveBlacklistID",
        "OpenIncidents",
        "PendingPenaltyTotal",
        "PendingPenaltyCount",
    )


def residents(t: Tables) -> DataFrame:
    """(RoomID, StudentID) of known students actively assigned to a room, once each."""
    pairs = active(t.room_assignment).select("RoomID", "StudentID").distinct()
    return pairs.join(t.student, "StudentID", "left_semi")


def room_roster(t: Tables) -> DataFrame:
    """Residents of every room with faculty and program.

    A student's roommates are the roster of their current room without
    themselves. Kept per room, the result is as long as the assignments; written
    out per student it would hold every pair within a room.
    """
    faculties = t.faculty.select("FacultyID", F.col("Name").alias("FacultyName"))
    programs = t.academic_program.select("ProgramID", F.col("Name").alias("ProgramName"))
    people = (
        t.student.select("StudentID", "FirstName", "LastName", "FacultyID", "ProgramID")
        .join(faculties, "FacultyID", "left")
        .join(programs, "ProgramID", "left")
        .drop("FacultyID", "ProgramID")
    )
    pairs = active(t.room_assignment).select("RoomID", "StudentID").distinct()
    return pairs.join(people, "StudentID").select(
        "RoomID", "StudentID", "FirstName", "LastName", "FacultyName", "ProgramName"
    )


def roommate_counts(t: Tables) -> DataFrame:
    """(StudentID, RoomID, Roommates) for every student with a current room."""
    per_room = residents(t).groupBy("RoomID").agg(F.count(F.lit(1)).alias("n"))
    rooms = facts.current_assignment(t).select("StudentID", "RoomID").join(t.student, "StudentID", "left_semi")
    return spread_join(rooms, per_room, ["RoomID"], hot_in=active(t.room_assignment)).select(
        "StudentID", "RoomID", (F.col("n") - 1).cast("bigint").alias("Roommates")
    )


def roommates_for(t: Tables, student_id: str) -> DataFrame:
    """One student's roommates by name."""
    room = facts.current_assignment(t).filter(F.col("StudentID") == student_id).select("RoomID")
    others = room_roster(t).join(room, "RoomID", "left_semi").filter(F.col("StudentID") != student_id)
    return others.orderBy("FirstName", "LastName")


def accommodation_accepted(t: Tables) -> DataFrame:
    """(StudentID, IsAccepted): does the student hold an active assignment?"""
    holders = active(t.room_assignment).select("StudentID", F.lit(True).alias("IsAccepted")).distinct()
    return t.student.select("StudentID").join(holders, "StudentID", "left").fillna(False, ["IsAccepted"])


def active_portal_accounts(t: Tables) -> DataFrame:
    """Accounts that may sign in: active user, active student, a student role."""
    roles = t.role.filter(F.lower("RoleName").contains("student")).select("RoleID", "RoleName")
    students = t.student.filter(F.col("Status") == "Active").select("StudentID")
    users = t.system_user.filter(F.col("Status") == "Active")
    return users.join(roles, "RoleID").join(students, "StudentID", "left_semi").select(
        "UserID", "StudentID", "Email", "RoleName"
    )


def student_profiles(t: Tables) -> DataFrame:
    """Profile JSON of every student."""
    faculties = t.faculty.select("FacultyID", F.col("Name").alias("faculty"))
    programs = t.academic_program.select("ProgramID", F.col("Name").alias("program"))
    wide = t.student.join(faculties, "FacultyID", "left").join(programs, "ProgramID", "left")
    document = F.struct(
        F.col("StudentID").alias("student_id"),
        F.col("FirstName").alias("first_name"),
        F.col("LastName").alias("last_name"),
        F.col("Email").alias("email"),
        F.col("GPA").cast("string").alias("gpa"),
        F.col("Status").alias("status"),
        "faculty",
        "program",
    )
    return wide.select("StudentID", F.to_json(document, {"ignoreNullFields": "false"}).alias("Document"))


def room_documents(t: Tables) -> DataFrame:
    """Room JSON of every student; students without a room get a null assignment."""
    places = t.room.join(t.building.select("BuildingID", "BuildingName"), "BuildingID").select(
        "RoomID", "RoomNumber", "BuildingName", "FloorNumber"
    )
    beds = t.bed_slot.select("BedSlotID", "BedNumber")
    current = (
        facts.current_assignment(t)
        .select("StudentID", "RoomID", "BedSlotID", "Status", "CheckInDate")
        .join(places, "RoomID")
        .join(beds, "BedSlotID", "left")
    )
    assignment = F.struct(
        F.col("RoomNumber").alias("room"),
        F.col("BuildingName").alias("building"),
        F.col("FloorNumber").alias("floor"),
        F.col("BedNumber").alias("bed"),
        F.col("Status").alias("status"),
        F.date_format("CheckInDate", "yyyy-MM-dd").alias("check_in_date"),
    )
    documents = current.select("StudentID", assignment.alias("assignment"))
    return t.student.select("StudentID").join(documents, "StudentID", "left").select(
        "StudentID", F.to_json(F.struct("assignment"), {"ignoreNullFields": "false"}).alias("Document")
    )


def request_documents(t: Tables) -> DataFrame:
    """Maintenance requests and complaints per student as paged JSON arrays."""

    def pages(history: DataFrame, key: str, item: list, kind: str) -> DataFrame:
        numbered = history.withColumnRenamed(key, "StudentID") if key != "StudentID" else history
        nested = histories.nested_pages(numbered, "StudentID", "seq", item, t.student)
        return nested.select("StudentID", F.lit(kind).alias("Kind"), "Page", "Items")

    def stamp(column: str, name: str):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)

    maintenance = [
        F.col("RequestID").alias("request_id"),
        F.col("Title").alias("title"),
        F.col("Category").alias("category"),
        F.col("Priority").alias("priority"),
        F.col("Status").alias("status"),
        stamp("ReportedAt", "reported_at"),
    ]
    complaint = [
        F.col("ComplaintID").alias("complaint_id"),
        F.col("Subject").alias("subject"),
        F.col("Category").alias("category"),
        F.col("Priority").alias("priority"),
        F.col("Status").alias("status"),
        stamp("SubmittedAt", "submitted_at"),
    ]
    return union_all(
        [
            pages(histories.maintenance_history(t), "ReportedByStudentID", maintenance, "maintenance"),
            pages(histories.complaint_history(t), "StudentID", complaint, "complaints"),
        ]
    )


def announcement_documents(t: Tables, now: dt.datetime) -> DataFrame:
    """JSON of every active announcement with the number of students who read it.

    The per-student flag lives in ``queues.read_announcements``.
    """
    readers = queues.read_announcements(t, now).groupBy("AnnouncementID").agg(F.count(F.lit(1)).alias("n"))
    document = F.struct(
        F.col("AnnouncementID").alias("announcement_id"),
        F.col("Title").alias("title"),
        F.col("Type").alias("type"),
        F.col("PriorityLevel").alias("priority_level"),
        F.date_format("PublishDate", "yyyy-MM-dd'T'HH:mm:ss").alias("publish_date"),
    )
    return queues.active_announcements(t, now).join(readers, "AnnouncementID", "left").select(
        "AnnouncementID",
        F.to_json(document, {"ignoreNullFields": "false"}).alias("Document"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("Readers"),
    )


def top_announcements(t: Tables, now: dt.datetime, k: int = 3) -> DataFrame:
    """The k newest active announcements: the dashboard's notice board."""
    return (
        queues.active_announcements(t, now)
        .select("AnnouncementID", "Title", "PublishDate", "PriorityLevel")
        .orderBy(F.desc("PublishDate"), F.desc("AnnouncementID"))
        .limit(k)
    )


def service_activity(t: Tables) -> DataFrame:
    """How much there is for each student's service page; the page lists the first of it (``recent_*``)."""

    def counted(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("StudentID")).agg(
            F.count(F.lit(1)).alias(out)
        )

    parts = [
        queues.visible_service_counts(t).select("StudentID", F.col("VisibleServices").alias("Services")),
        counted(t.meal_subscription, "StudentID", "MealSubscriptions"),
        counted(t.meal_attendance, "StudentID", "RecentMeals"),
        counted(t.laundry_usage, "StudentID", "RecentLaundry"),
        counted(t.access_log, "StudentID", "RecentAccess"),
        counted(t.lost_and_found_item, "ReportedBy", "LostAndFound"),
    ]
    wide = t.student.select("StudentID")
    for part in parts:
        wide = wide.join(part, "StudentID", "left")
    names = [part.columns[-1] for part in parts]
    return wide.select("StudentID", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
