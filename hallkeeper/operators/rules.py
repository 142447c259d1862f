"""Row-validation rules over whole tables of stored or incoming rows.

Rule functions return ``(table_name, row_key, rule)``: one row per broken rule,
or, where the source stops at the first failure, the first broken rule in order.
``RULE_TEXT`` explains each rule name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import date_value, normalized_email
from hallkeeper.functions.ranking import union_all
from hallkeeper.functions.skew import spread_join
from hallkeeper.operators import facts, queues
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active, has_assignable_bed
from hallkeeper.operators.repairs import Moment
from hallkeeper.schemas import VOCABULARIES
from hallkeeper.tables import Tables

RULE_TEXT = {
    "payment_student": "a payment belongs to the student of its invoice",
    "invoice_student": "an invoice belongs to the student of its assignment",
    "same_room": "a transfer needs two different rooms",
    "no_active_source": "the student lives in the room the transfer leaves",
    "building_not_active": "the building is active",
    "room_not_assignable": "the room is available or occupied",
    "room_full": "the room has a free seat",
    "no_free_bed": "a room with beds has a free one",
    "other_active_assignment": "a student has one active assignment",
    "application_student": "an assignment belongs to the student of its application",
    "bed_missing": "the bed exists",
    "bed_in_other_room": "the bed stands in the room",
    "bed_not_available": "the bed is free and not reserved",
    "end_before_start": "a period ends on or after its start",
    "checkout_not_after_checkin": "the planned check-out is after the check-in",
    "actual_checkout_before_checkin": "the actual check-out is not before the check-in",
    "move_before_request": "the move is not before the request",
    "value_not_allowed": "the value is in the column's vocabulary",
    "required": "the value is present",
    "not_typed": "the text parses as the column's type",
}

PERIODS = {
    "registration": "ApplicationID",
    "leave_permission": "PermissionID",
    "visitor_permission": "PermissionID",
    "meal_subscription": "SubscriptionID",
}
"""Tables with a StartDate and EndDate, and their keys."""


def _broken(df: DataFrame, table: str, key: str, rule: str | Column) -> DataFrame:
    name = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), name.alias("rule"))


def first_broken(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition for failure holds; null when none does."""
    name, failed = rules[0]
    chain = F.when(failed, name)
    for name, failed in rules[1:]:
        chain = chain.when(failed, name)
    return chain


def finance_links(t: Tables) -> DataFrame:
    """Payments and invoices that name a different student than their parent."""
    invoices = t.invoice.select("InvoiceID", F.col("StudentID").alias("OwnerID"))
    payments = t.payment_transaction.select("TransactionID", "InvoiceID", "StudentID").join(invoices, "InvoiceID")
    stays = t.room_assignment.select("AssignmentID", F.col("StudentID").alias("OwnerID"))
    billed = t.invoice.select("InvoiceID", "AssignmentID", "StudentID").join(stays, "AssignmentID")
    differs = F.col("StudentID") != F.col("OwnerID")
    return union_all(
        [
            _broken(payments.filter(differs), "payment_transaction", "TransactionID", "payment_student"),
            _broken(billed.filter(differs), "invoice", "InvoiceID", "invoice_student"),
        ]
    )


def room_frame(t: Tables) -> DataFrame:
    """Rooms with building state and bed counts, under names that clash with no candidate column."""
    return queues.rooms_with_beds(t).select(
        "RoomID",
        F.col("Status").alias("RoomStatus"),
        "BuildingStatus",
        "GenderAllowed",
        "Capacity",
        "CurrentOccupancy",
        "TotalBeds",
        "FreeBeds",
        "OccupiedBeds",
        "MonthlyRent",
        "DepositAmount",
    )


def transfer_rules(t: Tables, candidates: DataFrame | None = None) -> DataFrame:
    """First broken rule per transfer, read as new rows.

    Candidates that already were Completed before the save may say so in a
    ``WasCompleted`` column; they need no active source stay.
    """
    rows = t.room_transfer if candidates is None else candidates
    if "WasCompleted" not in rows.columns:
        rows = rows.withColumn("WasCompleted", F.lit(False))
    rows = rows.select(
        "TransferID", "StudentID", "FromRoomID", "ToRoomID", "Status", "RequestDate", "EffectiveMoveDate", "WasCompleted"
    )
    sources = (
        active(t.room_assignment)
        .select("StudentID", F.col("RoomID").alias("FromRoomID"))
        .distinct()
        .withColumn("__lives", F.lit(True))
    )
    rooms = room_frame(t).withColumnRenamed("RoomID", "ToRoomID")
    wide = spread_join(rows, sources, ["StudentID", "FromRoomID"])
    wide = spread_join(wide, rooms, ["ToRoomID"], hot_in=rows)
    pending = F.coalesce("Status", F.lit("Pending")).isin("Pending", "Approved")
    needs_source = pending | ((F.col("Status") == "Completed") & ~F.col("WasCompleted"))
    known = pending & F.col("RoomStatus").isNotNull()
    rule = first_broken(
        ("same_room", F.col("FromRoomID") == F.col("ToRoomID")),
        ("no_active_source", F.col("__lives").isNull() & needs_source),
        ("building_not_active", known & (F.col("BuildingStatus") != "Active")),
        ("room_not_assignable", known & ~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)),
        ("room_full", known & (F.coalesce("CurrentOccupancy", F.lit(0)) >= F.col("Capacity"))),
        ("no_free_bed", known & ~has_assignable_bed()),
        ("move_before_request", F.col("EffectiveMoveDate") < F.col("RequestDate")),
    )
    return _broken(wide, "room_transfer", "TransferID", rule).filter(F.col("rule").isNotNull())


def assignment_rules(t: Tables) -> DataFrame:
    """First broken rule per active assignment, saved again as it is.

    Its own seat and its own bed do not count against it.
    """
    rows = active(t.room_assignment).select("AssignmentID", "StudentID", "RoomID", "BedSlotID", "ApplicationID")
    per_student = rows.groupBy("StudentID").agg(F.count(F.lit(1)).alias("__mine"))
    beds = t.bed_slot.select("BedSlotID", F.col("RoomID").alias("BedRoomID"), "IsReserved")
    applicants = t.registration.select("ApplicationID", F.col("StudentID").alias("ApplicantID"))
    wide = spread_join(rows, per_student, ["StudentID"])
    wide = spread_join(wide, room_frame(t), ["RoomID"], hot_in=rows)
    wide = wide.join(beds, "BedSlotID", "left").join(applicants, "ApplicationID", "left")
    others_seated = F.greatest(F.coalesce("CurrentOccupancy", F.lit(0)) - 1, F.lit(0))
    has_bed = F.col("BedSlotID").isNotNull()
    rule = first_broken(
        ("other_active_assignment", F.col("__mine") > 1),
        ("building_not_active", F.col("BuildingStatus") != "Active"),
        ("room_not_assignable", ~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)),
        ("room_full", others_seated >= F.col("Capacity")),
        ("application_student", F.col("ApplicantID") != F.col("StudentID")),
        ("bed_missing", has_bed & F.col("BedRoomID").isNull()),
        ("bed_in_other_room", F.col("BedRoomID") != F.col("RoomID")),
        ("bed_not_available", has_bed & F.col("IsReserved")),
        ("no_free_bed", ~has_bed & F.col("RoomStatus").isNotNull() & ~has_assignable_bed()),
    )
    return _broken(wide, "room_assignment", "AssignmentID", rule).filter(F.col("rule").isNotNull())


def date_rules(t: Tables) -> DataFrame:
    """Periods that end before they start, and stays or moves out of order."""
    parts = [
        _broken(t[table].filter(F.col("EndDate") < F.col("StartDate")), table, key, "end_before_start")
        for table, key in PERIODS.items()
    ]
    stays = t.room_assignment
    planned = stays.filter(F.col("CheckOutDate") <= F.col("CheckInDate"))
    actual = stays.filter(F.col("ActualCheckOutDate") < F.col("CheckInDate"))
    moves = t.room_transfer.filter(F.col("EffectiveMoveDate") < F.col("RequestDate"))
    parts += [
        _broken(planned, "room_assignment", "AssignmentID", "checkout_not_after_checkin"),
        _broken(actual, "room_assignment", "AssignmentID", "actual_checkout_before_checkin"),
        _broken(moves, "room_transfer", "TransferID", "move_before_request"),
    ]
    return union_all(parts)


def vocabulary_counts(t: Tables) -> DataFrame:
    """(table_name, column_name, value, rows, allowed) for every closed vocabulary in use.

    All columns of a table are counted in one pass.
    """
    parts = []
    for table in sorted({table for table, _ in VOCABULARIES if table in t}):
        columns = {column: values for (owner, column), values in VOCABULARIES.items() if owner == table}
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
        counted = t[table].select(F.inline(F.array(*pairs))).groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("rows")
        )
        allowed = F.lit(False)
        for column, values in columns.items():
            allowed = F.when(F.col("column_name") == column, F.col("value").isin(*values)).otherwise(allowed)
        parts.append(
            counted.select(
                F.lit(table).alias("table_name"),
                "column_name",
                "value",
                "rows",
                F.coalesce(allowed, F.lit(False)).alias("allowed"),
            )
        )
    return union_all(parts)


def typed_text(column: str, data_type: str) -> Column:
    """Text as a typed value; null when blank or not parseable."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    if data_type == "year":
        year = text.try_cast("int")
        return F.when(year.between(1901, 2155), year)
    if data_type == "timestamp":
        return F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return text.try_cast(data_type)


# What an imported invoice line must hold: column, type, required.
INVOICE_IMPORT = (
    ("InvoiceID", "bigint", True),
    ("TotalAmount", "decimal(10,2)", True),
    ("DueDate", "date", True),
    ("CreatedAt", "timestamp", False),
    ("AcademicYear", "year", False),
    ("PaymentStatus", "string", True),
)


def import_rules(rows: DataFrame, table: str, key: str, columns=INVOICE_IMPORT) -> DataFrame:
    """Every broken rule of raw text rows: (table_name, row_key, rule, column_name)."""
    entries = []
    for name, data_type, required in columns:
        blank = F.coalesce(F.trim(F.col(name)) == "", F.lit(True))
        rule = F.when(blank, F.lit("required") if required else F.lit(None).cast("string")).when(
            typed_text(name, data_type).isNull(), "not_typed"
        )
        allowed = VOCABULARIES.get((table, name))
        if allowed:
            rule = rule.when(~F.trim(F.col(name)).isin(*allowed), "value_not_allowed")
        entries.append(F.struct(rule.alias("rule"), F.lit(name).alias("column_name")))
    broken = F.filter(F.array(*entries), lambda e: e["rule"].isNotNull())
    return rows.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.inline(broken))


def import_rows(rows: DataFrame, columns=INVOICE_IMPORT) -> DataFrame:
    """Raw text rows as typed columns; what does not parse becomes null."""
    typed = {name: typed_text(name, data_type).alias(name) for name, data_type, _ in columns}
    return rows.select(*[typed.get(c, F.col(c)) for c in rows.columns])


def _normalized_candidates(t: Tables) -> DataFrame:
    return t.portal_candidate.select(
        "CandidateID",
        F.trim("StudentID").alias("StudentID"),
        normalized_email(F.col("Email")).alias("Email"),
        "FirstName",
        "LastName",
        "DateOfBirth",
        "Gender",
        "NationalIDOrPassport",
        "FacultyID",
        "ProgramID",
    )


def portal_candidates(t: Tables) -> DataFrame:
    """Registration candidates with their normalised key and any student on file."""
    on_file = t.student.select(
        "StudentID",
        F.col("Status").alias("FileStatus"),
        F.lower("Email").alias("FileEmail"),
        F.col("FirstName").alias("FileFirstName"),
        F.col("LastName").alias("FileLastName"),
        F.col("DateOfBirth").alias("FileDateOfBirth"),
        F.col("Gender").alias("FileGender"),
    )
    return _normalized_candidates(t).join(on_file, "StudentID", "left")


def portal_rules(t: Tables) -> DataFrame:
    """Every broken rule of portal registrations: (candidate_id, field, rule)."""
    user_emails = t.system_user.select(F.lower("Email").alias("Email"), F.lit(True).alias("__used")).distinct()
    owners = t.system_user.filter(F.col("StudentID").isNotNull()).select("StudentID", F.lit(True).alias("__owns"))
    file_emails = t.student.select(F.lower("Email").alias("Email"), F.lit(True).alias("__on_file")).distinct()
    emails = user_emails.join(file_emails, "Email", "full")
    ids = (
        t.student.filter(F.col("NationalIDOrPassport").isNotNull())
        .select("NationalIDOrPassport", F.lit(True).alias("__id_used"))
        .distinct()
    )
    programs = t.academic_program.select("ProgramID", F.col("FacultyID").alias("ProgramFacultyID"))
    rows = _normalized_candidates(t)
    wide = spread_join(portal_candidates(t), emails, ["Email"], hot_in=rows)
    wide = spread_join(wide, owners.distinct(), ["StudentID"], hot_in=rows)
    wide = spread_join(wide, ids, ["NationalIDOrPassport"], hot_in=rows)
    wide = wide.join(programs, "ProgramID", "left")
    known = F.col("FileStatus").isNotNull()

    def differs(column: str) -> Column:
        return known & ~F.col(column).eqNullSafe(F.col(f"File{column}"))

    rules = [
        ("StudentID", "id_has_spaces", F.col("StudentID").contains(" ")),
        ("ProgramID", "program_not_in_faculty", F.col("ProgramFacultyID") != F.col("FacultyID")),
        ("Email", "email_has_account", F.col("__used")),
        ("StudentID", "student_has_account", known & F.col("__owns")),
        ("StudentID", "student_not_active", known & (F.col("FileStatus") != "Active")),
        *[(c, "not_as_on_file", differs(c)) for c in ("Email", "FirstName", "LastName", "DateOfBirth", "Gender")],
        ("Email", "email_of_other_student", ~known & F.col("__on_file")),
        ("NationalIDOrPassport", "national_id_used", ~known & F.col("__id_used")),
    ]
    entries = [
        F.when(failed, F.struct(F.lit(column).alias("field"), F.lit(rule).alias("rule"))) for column, rule, failed in rules
    ]
    return wide.select(F.col("CandidateID"), F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


NEW_ROLE = "Student Resident"
"""The role made when no stored role fits."""


def student_role(t: Tables) -> DataFrame:
    """The role new portal accounts get: the best match for a student role, else a new one."""
    name = F.lower("RoleName")
    rank = F.when(name == NEW_ROLE.lower(), 1).when(name == "student", 2).when(name.contains("student"), 3)
    best = (
        t.role.select("RoleID", "RoleName", rank.alias("__rank"))
        .filter(F.col("__rank").isNotNull())
        .orderBy("__rank", "RoleID")
        .limit(1)
        .drop("__rank")
    )
    made = (
        t.role.agg(
            (F.coalesce(F.max("RoleID"), F.lit(0)) + 1).cast("int").alias("RoleID"), F.count(rank).alias("__fitting")
        )
        .filter(F.col("__fitting") == 0)
        .select("RoleID", F.lit(NEW_ROLE).alias("RoleName"))
    )
    return best.unionByName(made)


def application_checks(t: Tables, as_of: dt.date) -> DataFrame:
    """Dorm applications with their first broken rule (null when accepted) and filled defaults."""
    today = date_value(as_of)
    barred = (
        t.blacklist.filter((F.col("Status") == "Active") & (F.col("EndDate").isNull() | (F.col("EndDate") > today)))
        .select("StudentID", F.lit(True).alias("__barred"))
        .distinct()
    )
    semesters = queues.open_semesters(t, as_of).select(
        "SemesterID",
        F.lit(True).alias("__open"),
        F.col("StartDate").alias("SemesterStart"),
        F.col("EndDate").alias("SemesterEnd"),
    )
    running = (
        t.registration.filter(F.col("Status").isin(*queues.QUEUED_APPLICATION) & F.col("SemesterID").isNotNull())
        .select("StudentID", "SemesterID", F.lit(True).alias("__running"))
        .distinct()
    )
    rows = t.application_candidate
    wide = spread_join(rows, barred, ["StudentID"]).join(semesters, "SemesterID", "left")
    wide = spread_join(wide, running, ["StudentID", "SemesterID"], hot_in=rows)
    has_semester = F.col("SemesterID").isNotNull()
    rule = first_broken(
        ("gpa_out_of_range", ~F.col("GPA").between(0, 4)),
        ("semester_not_open", has_semester & F.col("__open").isNull()),
        ("blacklisted", F.col("__barred")),
        ("end_before_start", F.col("EndDate") < F.col("StartDate")),
        ("semester_or_dates", ~has_semester & (F.col("StartDate").isNull() | F.col("EndDate").isNull())),
        ("already_applied", F.col("__running")),
    )
    return wide.select(
        "CandidateID",
        "StudentID",
        "SemesterID",
        F.coalesce("StartDate", "SemesterStart").alias("StartDate"),
        F.coalesce("EndDate", "SemesterEnd").alias("EndDate"),
        "GPA",
        today.alias("ApplicationDate"),
        F.lit("Pending").alias("Status"),
        F.lit(5).alias("Priority"),
        rule.alias("rule"),
    )


def transfer_request_checks(t: Tables, as_of: dt.date) -> DataFrame:
    """Transfer requests with their first broken rule (null when accepted)."""
    current = facts.current_assignment(t).select("StudentID", F.col("RoomID").alias("FromRoomID"))
    people = t.student.select("StudentID", "Gender").join(current, "StudentID", "full")
    rooms = room_frame(t).withColumnRenamed("RoomID", "ToRoomID")
    asked = (
        t.room_transfer.filter(F.col("Status").isin("Pending", "Approved"))
        .select("StudentID", "FromRoomID", "ToRoomID", F.lit(True).alias("__asked"))
        .distinct()
    )
    rows = t.transfer_candidate
    wide = spread_join(rows, people, ["StudentID"])
    wide = spread_join(wide, rooms, ["ToRoomID"], hot_in=rows)
    wide = spread_join(wide, asked, ["StudentID", "FromRoomID", "ToRoomID"], hot_in=rows, hot_on=["StudentID"])
    listed = (
        F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)
        & (F.col("BuildingStatus") == "Active")
        & (F.col("GenderAllowed").isin("Mixed") | (F.col("GenderAllowed") == F.col("Gender")))
        & (F.coalesce("CurrentOccupancy", F.lit(0)) < F.col("Capacity"))
        & has_assignable_bed()
        & (F.col("ToRoomID") != F.col("FromRoomID"))
    )
    rule = first_broken(
        ("no_active_room", F.col("FromRoomID").isNull()),
        ("not_a_destination", ~F.coalesce(listed, F.lit(False))),
        ("room_not_available", facts.available_beds() < 1),
        ("already_requested", F.col("__asked")),
    )
    return wide.select(
        "CandidateID",
        "StudentID",
        "FromRoomID",
        "ToRoomID",
        date_value(as_of).alias("RequestDate"),
        F.lit("Pending").alias("Status"),
        rule.alias("rule"),
    )


# From which statuses a student may cancel, and the date the cancelling sets.
CANCELLABLE: dict[str, tuple[str, str, tuple[str, ...], str | None]] = {
    "registration": ("ApplicationID", "StudentID", ("Pending", "Waitlisted"), "ApprovalDate"),
    "maintenance_request": ("RequestID", "ReportedByStudentID", ("Open", "In Progress"), "ResolvedAt"),
    "complaint": ("ComplaintID", "StudentID", ("Open", "In Progress"), "ClosedAt"),
    "room_transfer": ("TransferID", "StudentID", ("Pending", "Approved"), "ApprovalDate"),
    "leave_permission": ("PermissionID", "StudentID", ("Pending", "Approved"), "ApprovalDate"),
    "visitor_permission": ("PermissionID", "StudentID", ("Pending", "Approved"), "ApprovalDate"),
    "lost_and_found_item": ("ItemID", "ReportedBy", ("Open", "Pending"), None),
}


def _cancel_outcomes(t: Tables, entity: str) -> DataFrame:
    key, owner, allowed, decided = CANCELLABLE[entity]
    asked = t.cancel_request.filter(F.col("Entity") == entity)
    rows = t[entity].select(F.col(key).alias("RowKey"), F.col(owner).alias("StudentID"), F.col("Status").alias("OldStatus"))
    outcome = (
        F.when(F.col("OldStatus").isNull(), "not_found")
        .when(F.col("OldStatus").isin(*allowed), "cancelled")
        .otherwise("status_not_cancellable")
    )
    return asked.join(rows, ["RowKey", "StudentID"], "left").select(
        "Entity", "RowKey", "StudentID", "OldStatus", outcome.alias("Outcome"),
        F.when(outcome == "cancelled", F.lit(decided).cast("string")).alias("DateColumn"),
    )


def cancel_requests(t: Tables) -> DataFrame:
    """Outcome of each cancel request: cancelled, not_found or status_not_cancellable."""
    return union_all([_cancel_outcomes(t, entity) for entity in CANCELLABLE])


def apply_cancellations(t: Tables, entity: str, at: Moment) -> DataFrame:
    """One table with its accepted cancel requests carried out at a moment."""
    key, _, _, decided = CANCELLABLE[entity]
    keys = (
        _cancel_outcomes(t, entity)
        .filter(F.col("Outcome") == "cancelled")
        .select(F.col("RowKey").alias(key), F.lit(True).alias("__cancel"))
        .distinct()
    )
    hit = F.coalesce("__cancel", F.lit(False))
    values = {"Status": F.when(hit, "Cancelled").otherwise(F.col("Status"))}
    if decided:
        value = at.time if decided.endswith("At") else at.date
        values[decided] = F.when(hit, value).otherwise(F.col(decided))
    rows = t[entity].join(keys, key, "left")
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in t[entity].columns])


def status_edits(t: Tables, as_of: dt.date) -> DataFrame:
    """Where each status edit goes: unchanged, update, blocked_without_room or move_now."""
    today = date_value(as_of)
    edits = t.status_edit.filter(F.col("Entity") == "registration")
    housed = t.room_assignment.select(F.col("ApplicationID").alias("RowKey"), F.lit(True).alias("__housed"))
    rows = t.registration.select(F.col("ApplicationID").alias("RowKey"), "Status")
    housed = housed.filter(F.col("RowKey").isNotNull()).distinct()
    applications = spread_join(edits.join(rows, "RowKey"), housed, ["RowKey"], hot_in=edits).select(
        "Entity",
        "RowKey",
        "NewStatus",
        F.when(F.col("NewStatus") == F.col("Status"), "unchanged")
        .when((F.col("NewStatus") == "Approved") & F.col("__housed").isNull(), "blocked_without_room")
        .otherwise("update")
        .alias("Route"),
    )
    moves = t.status_edit.filter(F.col("Entity") == "room_transfer").join(
        t.room_transfer.select(F.col("TransferID").alias("RowKey"), "Status"), "RowKey"
    )
    due = F.col("EffectiveMoveDate").isNull() | (F.col("EffectiveMoveDate") <= today)
    moving = (F.col("NewStatus") == "Completed") | ((F.col("NewStatus") == "Approved") & due)
    transfers = moves.select(
        "Entity",
        "RowKey",
        "NewStatus",
        F.when(F.col("NewStatus") == F.col("Status"), "unchanged").when(moving, "move_now").otherwise("update").alias("Route"),
    )
    return applications.unionByName(transfers)


def announcement_marks(t: Tables, now: dt.datetime) -> DataFrame:
    """Outcome per (student, announcement) marked as read: created, marked, already_read or not_active."""
    marks = t.read_mark.select("StudentID", "AnnouncementID").distinct()
    listed = queues.active_announcements(t, now).select("AnnouncementID", F.lit(True).alias("__active"))
    receipts = t.student_announcement.select("StudentID", "AnnouncementID", "IsRead")
    wide = marks.join(listed, "AnnouncementID", "left").join(receipts, ["StudentID", "AnnouncementID"], "left")
    outcome = (
        F.when(F.col("__active").isNull(), "not_active")
        .when(F.col("IsRead").isNull(), "created")
        .when(F.col("IsRead"), "already_read")
        .otherwise("marked")
    )
    return wide.select("StudentID", "AnnouncementID", outcome.alias("Outcome"))


def receipts_after_marks(t: Tables, now: dt.datetime) -> DataFrame:
    """Announcement receipts with all marks applied: (StudentID, AnnouncementID, IsRead)."""
    done = (
        announcement_marks(t, now)
        .filter(F.col("Outcome").isin("created", "marked"))
        .select("StudentID", "AnnouncementID", F.lit(True).alias("__read"))
    )
    receipts = t.student_announcement.select("StudentID", "AnnouncementID", "IsRead")
    merged = receipts.join(done, ["StudentID", "AnnouncementID"], "full")
    return merged.select("StudentID", "AnnouncementID", F.coalesce("__read", "IsRead").alias("IsRead"))


def notification_marks(t: Tables) -> DataFrame:
    """Outcome per notification marked as read: marked, already_read or not_found."""
    marks = t.read_mark.select("StudentID", "NotificationID").distinct()
    rows = t.notification.select("StudentID", "NotificationID", "IsRead")
    outcome = F.when(F.col("IsRead").isNull(), "not_found").when(F.col("IsRead"), "already_read").otherwise("marked")
    return marks.join(rows, ["StudentID", "NotificationID"], "left").select(
        "StudentID", "NotificationID", outcome.alias("Outcome")
    )


def notifications_after_marks(t: Tables) -> DataFrame:
    """Notifications with all marks applied."""
    done = notification_marks(t).filter(F.col("Outcome") == "marked").select("NotificationID", F.lit(True).alias("__read"))
    rows = t.notification.join(done, "NotificationID", "left")
    hit = F.coalesce("__read", F.lit(False))
    values = {
        "IsRead": F.when(hit, True).otherwise(F.col("IsRead")),
        "Status": F.when(hit, "Read").otherwise(F.col("Status")),
    }
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in t.notification.columns])


