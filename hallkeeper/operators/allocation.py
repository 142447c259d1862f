"""Batch allocation: approvals with rooms, visitor and account intake.

Where the source handles one request and raises on the first broken rule, these
take all requests, carry out those that can be, and return the others with the
reason. Inputs should be reconciled (``plans.reconcile``), so that stored room
counters equal the active assignments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.claims import Claim, grant_in_order
from hallkeeper.functions.columns import status_rank
from hallkeeper.functions.ranking import Cell, first_per_key, id_block, row_rank
from hallkeeper.functions.skew import sparse_join, spread_join
from hallkeeper.operators import rules
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active, free_bed
from hallkeeper.operators.queues import QUEUED_APPLICATION
from hallkeeper.operators.repairs import HOUSING, Moment, ranked_free_beds, run_steps
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables


def new_id(existing: DataFrame, id_column: str, source_id: Column) -> Column:
    """Id of a row made from the row ``source_id``: above every existing id, unique per source."""
    highest = existing.select(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    return highest + 1 + source_id


# Title and text of the notices.
APPROVED_NOTICE = (
    "Dorm application approved",
    "Your dorm application was approved and a room assignment is now active.",
)
MOVED_NOTICE = (
    "Room transfer completed",
    "Your room transfer was completed and your new room assignment is now active.",
)


def housing_notices(t: Tables, rows: DataFrame, source_id: str, title: str, message: str, at: Moment) -> DataFrame:
    """An unread housing notice of high priority to each row's student."""
    return rows.select(
        new_id(t.notification, "NotificationID", F.col(source_id)).alias("NotificationID"),
        "StudentID",
        F.lit(title).alias("Title"),
        F.lit(message).alias("Message"),
        F.lit("In-App").alias("Channel"),
        F.lit("Housing").alias("Type"),
        F.lit(False).alias("IsRead"),
        F.lit("High").alias("PriorityLevel"),
        at.time.alias("PublishDate"),
        F.lit("Sent").alias("Status"),
    )


# Applications


def approvals(t: Tables, at: Moment) -> DataFrame:
    """Every housing decision with its outcome, bed and terms.

    Decisions are served one after the other: those naming a bed first, then by
    queue order (status, priority, date, id). ``Reason`` is null when accepted.
    """
    applications = t.registration.select(
        "ApplicationID", "StudentID", F.col("Status").alias("ApplicationStatus"), "Priority", "ApplicationDate",
        F.col("StartDate").alias("WantedStart"), "SemesterID",
    )
    people = t.student.select("StudentID", F.col("Status").alias("StudentStatus"), "Gender")
    semesters = t.academic_semester.select("SemesterID", F.col("StartDate").alias("SemesterStart"))
    holders = active(t.room_assignment).select("StudentID", F.lit(True).alias("__holds")).distinct()
    people = people.join(holders, "StudentID", "left")
    beds = t.bed_slot.select("BedSlotID", F.col("RoomID").alias("BedRoomID"), free_bed().alias("BedFree"))

    decisions = t.housing_decision
    wide = decisions.join(applications, "ApplicationID", "left").join(semesters, "SemesterID", "left")
    wide = spread_join(wide, people, ["StudentID"], hot_in=t.registration)
    wide = spread_join(wide, rules.room_frame(t), ["RoomID"], hot_in=decisions)
    wide = sparse_join(wide, beds, ["BedSlotID"])

    seats = F.greatest(F.col("Capacity") - F.coalesce("CurrentOccupancy", F.lit(0)), F.lit(0))
    names_bed = F.col("BedSlotID").isNotNull()
    admitted = F.col("GenderAllowed").isin("Mixed") | F.coalesce(F.col("GenderAllowed") == F.col("Gender"), F.lit(False))
    static = rules.first_broken(
        ("application_not_found", F.col("StudentStatus").isNull()),
        ("student_not_active", F.col("StudentStatus") != "Active"),
        ("application_decided", ~F.col("ApplicationStatus").isin(*QUEUED_APPLICATION)),
        ("already_assigned", F.col("__holds")),
        ("room_not_found", F.col("RoomStatus").isNull()),
        ("building_not_active", F.col("BuildingStatus") != "Active"),
        ("room_not_assignable", ~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)),
        ("room_full", seats < 1),
        ("gender_not_admitted", ~admitted),
        ("bed_in_other_room", names_bed & ~F.coalesce(F.col("BedRoomID") == F.col("RoomID"), F.lit(False))),
        ("bed_not_available", names_bed & ~F.col("BedFree")),
        ("no_free_bed", ~names_bed & (F.col("TotalBeds") > 0) & (F.col("FreeBeds") < 1)),
    )
    check_in = F.coalesce("CheckInDate", "WantedStart", "SemesterStart", at.date)
    judged = cut_lineage(
        wide.select(
            "ApplicationID",
            "StudentID",
            "RoomID",
            "BedSlotID",
            check_in.alias("CheckIn"),
            "MonthlyRent",
            F.coalesce("DepositAmount", F.lit(0)).cast("decimal(10,2)").alias("DepositAmount"),
            F.when(names_bed, 0).otherwise(1).alias("__auto"),
            status_rank("ApplicationStatus", ("Pending", "Waitlisted")).alias("__rank"),
            "Priority",
            "ApplicationDate",
            seats.cast("bigint").alias("__seats"),
            F.when(F.col("TotalBeds") > 0, F.least(seats, F.col("FreeBeds"))).otherwise(seats).alias("__limit"),
            static.alias("Static"),
        )
    )

    contenders = cut_lineage(judged.filter(F.col("Static").isNull()).drop("Static"))
    order = [F.asc("__auto"), F.asc("__rank"), F.asc("Priority"), F.asc("ApplicationDate"), F.asc("ApplicationID")]
    cells = [
        Cell(F.col("__auto") * 1000000 + F.col("__rank") * 100000 + F.coalesce("Priority", F.lit(0))),
        Cell(F.col("ApplicationDate")),
        Cell(id_block("ApplicationID")),
    ]
    room_limit = F.when(F.col("__auto") == 0, F.col("__seats")).otherwise(F.col("__limit"))
    claims = [
        Claim("student", ("StudentID",), F.lit(1)),
        Claim("room", ("RoomID",), room_limit),
        Claim("bed", ("BedSlotID",), F.lit(1)),
    ]
    granted = cut_lineage(grant_in_order(contenders, "ApplicationID", order, cells, claims))

    # Beds not named by anyone granted go to the others in the same order.
    named = granted.filter(F.col("Granted") & F.col("BedSlotID").isNotNull()).select("BedSlotID")
    left_over = ranked_free_beds(t.bed_slot.join(named, "BedSlotID", "left_anti")).withColumnRenamed(
        "BedSlotID", "GivenBed"
    )
    waiting = granted.filter(F.col("Granted") & F.col("BedSlotID").isNull()).select(
        "ApplicationID", "RoomID", "__auto", "__rank", "Priority", "ApplicationDate"
    )
    given = row_rank(waiting, ["RoomID"], order, cells).join(left_over, ["RoomID", "rn"]).select("ApplicationID", "GivenBed")
    reason = (
        F.when(F.col("Granted"), F.lit(None).cast("string"))
        .when(F.col("__granted_student") >= 1, "already_assigned_in_batch")
        .when(F.col("__granted_room") >= F.col("__seats"), "room_full")
        .when(F.col("__granted_bed") >= 1, "bed_not_available")
        .otherwise("no_free_bed")
    )
    contested = granted.join(given, "ApplicationID", "left").withColumn("Reason", reason)
    rejected = judged.filter(F.col("Static").isNotNull()).select(
        "ApplicationID", "StudentID", "RoomID", F.col("Static").alias("Reason")
    )
    won = F.col("Reason").isNull()
    outcome = contested.select(
        "ApplicationID",
        "StudentID",
        "RoomID",
        "Reason",
        F.when(won, F.coalesce("BedSlotID", "GivenBed")).alias("BedSlotID"),
        *[F.when(won, F.col(c)).alias(n) for c, n in (("CheckIn", "CheckInDate"), ("MonthlyRent",) * 2, ("DepositAmount",) * 2)],
    )
    return outcome.unionByName(rejected, allowMissingColumns=True)


def apply_approvals(t: Tables, outcomes: DataFrame, at: Moment) -> Tables:
    """The tables after carrying out accepted approvals."""
    accepted = outcomes.filter(F.col("Reason").isNull())
    keys = accepted.select("ApplicationID", F.lit(True).alias("__ok"))
    ok = F.coalesce("__ok", F.lit(False))
    registration = t.registration.join(keys, "ApplicationID", "left")
    values = {
        "Status": F.when(ok, "Approved").otherwise(F.col("Status")),
        "ApprovalDate": F.when(ok, F.coalesce("ApprovalDate", at.date)).otherwise(F.col("ApprovalDate")),
    }
    decided = registration.select(*[values[c].alias(c) if c in values else F.col(c) for c in t.registration.columns])
    stays = accepted.select(
        new_id(t.room_assignment, "AssignmentID", F.col("ApplicationID")).alias("AssignmentID"),
        "StudentID", "RoomID", "BedSlotID", "ApplicationID", "CheckInDate", F.lit("Active").alias("Status"),
        "MonthlyRent", "DepositAmount",
    )
    notes = housing_notices(t, accepted, "ApplicationID", *APPROVED_NOTICE, at)
    after = t.replacing(
        registration=decided,
        room_assignment=t.room_assignment.unionByName(stays, allowMissingColumns=True),
        notification=t.notification.unionByName(notes, allowMissingColumns=True),
    )
    # Stored tables may lack columns that new rows have: rent, deposit and the parts of a notice. Logs, bed flags and room counters follow from the new stays.
    return run_steps(after, HOUSING, at)[0]


# Intake


@dataclass(frozen=True)
class Intake:
    """Rows to append, by table."""

    visitors: DataFrame
    permissions: DataFrame


def visitor_intake(t: Tables, at: Moment) -> Intake:
    """Visitor permission requests: visitors are reused by national id, else created.

    A request without a national id always creates a visitor; of several
    requests with the same unknown id the first creates it.
    """
    requests = t.visitor_intake.filter(F.col("EndDate") >= F.col("StartDate")).withColumn(
        "NationalID", F.nullif("NationalID", F.lit(""))
    )
    known = first_per_key(
        t.visitor.filter(F.col("NationalID").isNotNull()).select("NationalID", F.col("VisitorID").alias("KnownID")),
        ["NationalID"],
        [F.asc("KnownID")],
    )
    first = (
        requests.filter(F.col("NationalID").isNotNull())
        .groupBy("NationalID")
        .agg(F.min("RequestID").alias("FounderID"))
    )
    by_id = known.join(first.join(known, "NationalID", "left_anti"), "NationalID", "full")
    wide = spread_join(requests, by_id, ["NationalID"])
    founder = F.coalesce("FounderID", "RequestID")
    created = new_id(t.visitor, "VisitorID", founder)
    permissions = wide.select(
        "RequestID",
        F.coalesce("KnownID", created).alias("VisitorID"),
        "StudentID",
        at.date.alias("RequestDate"),
        "StartDate",
        "EndDate",
        F.lit("Pending").alias("Status"),
    )
    makes = F.col("KnownID").isNull() & (founder == F.col("RequestID"))
    visitors = wide.filter(makes).select(
        created.alias("VisitorID"), "FirstName", "LastName", "NationalID", F.lit(True).alias("IsActive")
    )
    return Intake(visitors, permissions)


@dataclass(frozen=True)
class Accounts:
    """New student and user rows, and the candidates they came from."""

    students: DataFrame
    users: DataFrame


def new_accounts(t: Tables) -> Accounts:
    """Student and user rows for portal candidates without a broken rule.

    Candidates are served by CandidateID; a student id, email or national id
    taken by an earlier one is taken.
    """
    broken = rules.portal_rules(t).select("CandidateID").distinct()
    clean = rules.portal_candidates(t).join(broken, "CandidateID", "left_anti")
    order, cells = [F.asc("CandidateID")], [Cell(id_block("CandidateID"))]
    claims = [
        Claim("student", ("StudentID",), F.lit(1)),
        Claim("email", ("Email",), F.lit(1)),
        Claim("national_id", ("__new_id",), F.lit(1)),
    ]
    # Only a new student record takes its national id.
    claiming = clean.withColumn("__new_id", F.when(F.col("FileStatus").isNull(), F.col("NationalIDOrPassport")))
    served = grant_in_order(cut_lineage(claiming), "CandidateID", order, cells, claims).filter(F.col("Granted"))
    students = served.filter(F.col("FileStatus").isNull()).select(
        "StudentID", "FirstName", "LastName", "Email", "NationalIDOrPassport", "DateOfBirth", "Gender",
        "FacultyID", "ProgramID", F.lit("Clear").alias("DisciplinaryStatus"), F.lit("Active").alias("Status"),
    )
    role = rules.student_role(t).select("RoleID").scalar()
    users = served.select(
        new_id(t.system_user, "UserID", F.col("CandidateID")).alias("UserID"), role.alias("RoleID"), "StudentID",
        "Email", "FirstName", "LastName", F.lit("Active").alias("Status"),
    )
    return Accounts(students, users)
