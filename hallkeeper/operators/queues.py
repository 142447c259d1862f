"""Work queues and room, bed and notice listings.

Listings the portal computes for one student depend on the student only through
gender or building. They are computed once per gender or building; ``*_for``
functions cut out one student's part, and the counts per student come from
arithmetic. No student-by-room product is ever built.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import date_value, full_name, joined, status_rank, time_value, valid_at
from hallkeeper.operators import checks, facts
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, available_beds, free_bed, has_assignable_bed
from hallkeeper.tables import Tables

GENDERS = ("Male", "Female")
QUEUED_APPLICATION = ("Pending", "Waitlisted", "Approved")
DASH = "—"


def application_queue(t: Tables) -> DataFrame:
    """Applications still without a room, most urgent first."""
    students = t.student.select(
        "StudentID",
        full_name().alias("StudentName"),
        "Gender",
        "Email",
        "PhoneNumber",
        "City",
        "Country",
        "GPA",
    )
    semesters = t.academic_semester.select("SemesterID", F.col("Name").alias("SemesterName"), "AcademicYear")
    waiting = (
        t.registration.filter(F.col("Status").isin(*QUEUED_APPLICATION))
        .join(t.room_assignment, "ApplicationID", "left_anti")
        .join(students, "StudentID")
        .join(semesters, "SemesterID", "left")
    )
    shown = F.lit(DASH)
    return waiting.select(
        "ApplicationID",
        "StudentID",
        "StudentName",
        "Gender",
        "Email",
        "Status",
        "ApplicationDate",
        "StartDate",
        "EndDate",
        "SemesterName",
        "AcademicYear",
        "PhoneNumber",
        "City",
        "Country",
        "Priority",
        "GPA",
        F.coalesce(joined(" / ", F.col("SemesterName"), F.col("AcademicYear")), shown).alias("SemesterText"),
        F.coalesce(joined(" → ", F.col("StartDate"), F.col("EndDate")), shown).alias("RequestedDates"),
        F.coalesce(joined(", ", F.col("PhoneNumber"), F.col("City"), F.col("Country")), "Email", shown).alias("Contact"),
    ).orderBy(
        status_rank("Status", ("Pending", "Waitlisted")), "Priority", "ApplicationDate", "ApplicationID"
    )


def transfer_queue(t: Tables) -> DataFrame:
    """Open room transfers with both rooms, most urgent first."""
    places = t.room.join(t.building.select("BuildingID", "BuildingName"), "BuildingID").select(
        "RoomID", "RoomNumber", "BuildingName"
    )

    def side(prefix: str) -> DataFrame:
        return places.select(*[F.col(c).alias(f"{prefix}{c}") for c in places.columns])

    queue = (
        t.room_transfer.filter(F.col("Status").isin("Pending", "Approved"))
        .join(t.student.select("StudentID", full_name().alias("StudentName")), "StudentID")
        .join(side("From"), "FromRoomID")
        .join(side("To"), "ToRoomID")
    )
    return queue.select(
        "TransferID",
        "StudentID",
        "StudentName",
        "FromRoomID",
        "FromRoomNumber",
        "FromBuildingName",
        "ToRoomID",
        "ToRoomNumber",
        "ToBuildingName",
        "RequestDate",
        "EffectiveMoveDate",
        "Status",
        "PriorityLevel",
        "Reason",
        F.coalesce(joined(" / ", F.col("RequestDate"), F.col("EffectiveMoveDate")), F.lit(DASH)).alias("MoveText"),
    ).orderBy(status_rank("PriorityLevel", ("Urgent", "High", "Normal")), "RequestDate", "TransferID")


def rooms_with_beds(t: Tables) -> DataFrame:
    """Rooms with building, type and bed counts: the frame of every listing."""
    buildings = t.building.select(
        "BuildingID", "BuildingName", "BuildingCode", F.col("Status").alias("BuildingStatus"), "GenderAllowed"
    )
    types = t.room_type.select(
        "RoomTypeID",
        F.col("Name").alias("RoomTypeName"),
        F.col("BasePrice").alias("MonthlyRent"),
        F.col("SecurityDeposit").alias("DepositAmount"),
    )
    return facts.with_bed_counts(t.room, t).join(buildings, "BuildingID").join(types, "RoomTypeID", "left")


def _per_gender(rooms: DataFrame) -> DataFrame:
    """One row per gender the building admits."""
    genders = F.when(F.col("GenderAllowed") == "Mixed", F.array(*map(F.lit, GENDERS))).otherwise(
        F.array("GenderAllowed")
    )
    return rooms.select(F.explode(genders).alias("Gender"), "*")


def _open(rooms: DataFrame) -> DataFrame:
    return rooms.filter(F.col("Status").isin(*ASSIGNABLE_ROOM) & (F.col("BuildingStatus") == "Active"))


def _has_seat() -> Column:
    return F.coalesce("CurrentOccupancy", F.lit(0)) < F.col("Capacity")


def assignable_rooms(t: Tables) -> DataFrame:
    """Rooms staff may assign, once per admitted gender."""
    rooms = _open(rooms_with_beds(t)).filter(_has_seat() & has_assignable_bed())
    return _per_gender(rooms).select(
        "Gender",
        "RoomID",
        "RoomNumber",
        "FloorNumber",
        "Capacity",
        F.coalesce("CurrentOccupancy", F.lit(0)).alias("CurrentOccupancy"),
        "MonthlyRent",
        "DepositAmount",
        "BuildingName",
        "BuildingCode",
        "RoomTypeName",
    )


def available_rooms(t: Tables) -> DataFrame:
    """The portal's looser rule: a free bed counts even when the room is at capacity."""
    no_beds = F.col("TotalBeds") == 0
    seat = F.col("CurrentOccupancy").isNull() | (F.col("CurrentOccupancy") < F.col("Capacity"))
    rooms = _open(rooms_with_beds(t)).filter((no_beds & seat) | (F.col("FreeBeds") > 0))
    return _per_gender(rooms).select(
        "Gender", "RoomID", "BuildingName", "RoomNumber", "RoomTypeName", "TotalBeds", "FreeBeds"
    )


def transfer_destinations(t: Tables) -> DataFrame:
    """Rooms a resident may ask to move to, once per admitted gender."""
    seat = F.col("CurrentOccupancy").isNull() | (F.col("CurrentOccupancy") < F.col("Capacity"))
    rooms = _open(rooms_with_beds(t)).filter(seat & has_assignable_bed())
    return _per_gender(rooms).select("Gender", "RoomID", "BuildingName", "RoomNumber", "RoomTypeName")


def rooms_for(t: Tables, student_id: str, listing: DataFrame) -> DataFrame:
    """One student's part of a per-gender listing, by building and room number."""
    student = t.student.filter(F.col("StudentID") == student_id)
    return listing.join(student, "Gender", "left_semi").orderBy("BuildingName", "RoomNumber")


def _rooms_per_gender(listing: DataFrame) -> DataFrame:
    """(Gender, n), broadcast: never more rows than GENDERS has entries."""
    known = listing.filter(F.col("Gender").isin(*GENDERS))
    return F.broadcast(known.groupBy("Gender").agg(F.count(F.lit(1)).alias("n")))


def room_counts(t: Tables, listing: DataFrame, out: str) -> DataFrame:
    """(StudentID, n): how many rooms of a per-gender listing each student sees."""
    return t.student.select("StudentID", "Gender").join(_rooms_per_gender(listing), "Gender", "left").select(
        "StudentID", F.coalesce("n", F.lit(0)).cast("bigint").alias(out)
    )


def assignable_room_counts(t: Tables) -> DataFrame:
    return room_counts(t, assignable_rooms(t), "AssignableRooms")


def available_room_counts(t: Tables) -> DataFrame:
    return room_counts(t, available_rooms(t), "AvailableRooms")


def transfer_destination_counts(t: Tables) -> DataFrame:
    """(StudentID, FromRoomID, Destinations) for residents; their own room is left out."""
    listing = transfer_destinations(t)
    residents = facts.current_assignment(t).select("StudentID", F.col("RoomID").alias("FromRoomID"))
    seen = t.student.select("StudentID", "Gender").join(residents, "StudentID")
    own = listing.select("Gender", F.col("RoomID").alias("FromRoomID"), F.lit(1).alias("own"))
    return seen.join(_rooms_per_gender(listing), "Gender", "left").join(own, ["Gender", "FromRoomID"], "left").select(
        "StudentID",
        "FromRoomID",
        (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("bigint").alias("Destinations"),
    )


def room_catalog(t: Tables) -> DataFrame:
    """Every room with the label each gender sees and whether it can be requested."""
    genders = F.explode(F.array(*map(F.lit, GENDERS))).alias("Gender")
    rooms = rooms_with_beds(t).select(genders, "*")
    admitted = F.col("GenderAllowed").isin("Mixed") | (F.col("GenderAllowed") == F.col("Gender"))
    label = (
        F.when(F.col("BuildingStatus") != "Active", "Building unavailable")
        .when(~admitted, "Building restricted")
        .when(~F.col("Status").isin(*ASSIGNABLE_ROOM), "Unavailable")
        .when(available_beds() < 1, "Full")
        .when(~has_assignable_bed(), "No free bed slot")
        .otherwise("Can request")
    )
    return rooms.select(
        "Gender",
        "RoomID",
        "BuildingName",
        "RoomNumber",
        "RoomTypeName",
        available_beds().alias("AvailableBeds"),
        label.alias("PortalLabel"),
        (label == "Can request").alias("CanRequest"),
    )


def list_available_beds(t: Tables) -> DataFrame:
    """Free, unreserved beds of every room."""
    return t.bed_slot.filter(free_bed()).select("RoomID", "BedSlotID", "BedNumber", "BedPosition", "BedType")


def due_transfers(t: Tables, as_of: dt.date) -> DataFrame:
    """Approved transfers whose move is due, in processing order."""
    waiting = checks.unmoved_transfers(t).filter(checks.due(date_value(as_of)))
    return waiting.select(
        "TransferID", "StudentID", "FromRoomID", "ToRoomID", "ApprovalDate", "EffectiveMoveDate"
    ).orderBy(F.asc_nulls_first("ApprovalDate"), "TransferID")


def active_announcements(t: Tables, now: dt.datetime) -> DataFrame:
    """Published announcements valid now, newest first."""
    moment = time_value(now)
    return t.announcement.filter(
        (F.col("Status") == "Published") & valid_at(F.col("PublishDate"), F.col("ExpiryDate"), moment)
    ).orderBy(F.desc("PublishDate"), F.desc("AnnouncementID"))


def read_announcements(t: Tables, now: dt.datetime) -> DataFrame:
    """(StudentID, AnnouncementID) of active announcements the student has read.

    Every other active announcement is unread for that student, so this and
    ``active_announcements`` hold the whole per-student list without a product.
    """
    receipts = t.student_announcement.filter(F.col("IsRead")).select("StudentID", "AnnouncementID")
    return receipts.join(active_announcements(t, now), "AnnouncementID", "left_semi").select(
        "StudentID", "AnnouncementID"
    )


def announcements_for(t: Tables, student_id: str, now: dt.datetime) -> DataFrame:
    """One student's active announcements with read flag, newest first."""
    read = read_announcements(t, now).filter(F.col("StudentID") == student_id)
    flags = read.select("AnnouncementID", F.lit(True).alias("IsRead"))
    listing = active_announcements(t, now).join(flags, "AnnouncementID", "left").fillna(False, ["IsRead"])
    return listing.orderBy(F.desc("PublishDate"), F.desc("AnnouncementID"))


def active_notifications(t: Tables, now: dt.datetime) -> DataFrame:
    """Notifications valid now and not failed, of all students; ``notifications_of`` gives one student's list in order."""
    moment = time_value(now)
    return t.notification.filter(
        valid_at(F.col("PublishDate"), F.col("ExpiryDate"), moment) & (F.col("Status") != "Failed")
    ).select("StudentID", "NotificationID", "Title", "IsRead", "PublishDate", "ExpiryDate", "Status")


def notifications_of(t: Tables, now: dt.datetime, student_id: str) -> DataFrame:
    """One student's notifications valid now, newest first."""
    own = active_notifications(t, now).filter(F.col("StudentID") == student_id)
    return own.orderBy(F.desc("PublishDate"), F.desc("NotificationID"))


def unread_counts(t: Tables, now: dt.datetime) -> DataFrame:
    """(StudentID, UnreadAnnouncements, UnreadNotifications, UnreadTotal) for every student."""
    published = active_announcements(t, now).select(F.count(F.lit(1))).scalar()
    read = read_announcements(t, now).groupBy("StudentID").agg(F.count(F.lit(1)).alias("read"))
    notes = (
        active_notifications(t, now)
        .filter(~F.col("IsRead"))
        .groupBy("StudentID")
        .agg(F.count(F.lit(1)).alias("notes"))
    )
    announcements = (published - F.coalesce("read", F.lit(0))).cast("bigint")
    notifications = F.coalesce("notes", F.lit(0)).cast("bigint")
    return (
        t.student.select("StudentID")
        .join(read, "StudentID", "left")
        .join(notes, "StudentID", "left")
        .select(
            "StudentID",
            announcements.alias("UnreadAnnouncements"),
            notifications.alias("UnreadNotifications"),
            (announcements + notifications).alias("UnreadTotal"),
        )
    )


def open_semesters(t: Tables, as_of: dt.date) -> DataFrame:
    """Semesters an application may name today, latest start first."""
    today = date_value(as_of)
    opened = F.col("RegistrationOpenDate").isNull() | (F.col("RegistrationOpenDate") <= today)
    still = F.col("RegistrationCloseDate").isNull() | (F.col("RegistrationCloseDate") >= today)
    return t.academic_semester.filter(
        F.col("Status").isin("Upcoming", "Active")
        & (F.col("EndDate") >= today)
        & ((F.col("Status") == "Active") | (opened & still))
    ).orderBy(F.desc("StartDate"))


def resident_buildings(t: Tables) -> DataFrame:
    """(StudentID, RoomID, BuildingID) of every current assignment."""
    places = t.room.select("RoomID", "BuildingID")
    return facts.current_assignment(t).select("StudentID", "RoomID").join(places, "RoomID", "left")


def service_audience(t: Tables) -> DataFrame:
    """Active services with the number of residents each is shown to.

    A service without a building is shown to everyone.
    """
    services = t.dorm_service.filter(F.col("Status") == "Active")
    residents = resident_buildings(t)
    per_building = residents.groupBy("BuildingID").agg(F.count(F.lit(1)).alias("n"))
    everyone = residents.select(F.count(F.lit(1))).scalar()
    audience = F.when(F.col("BuildingID").isNull(), everyone).otherwise(F.coalesce("n", F.lit(0)))
    return services.join(per_building, "BuildingID", "left").select(
        "ServiceID", "Name", "BuildingID", audience.cast("bigint").alias("Residents")
    )


def visible_service_counts(t: Tables) -> DataFrame:
    """(StudentID, BuildingID, VisibleServices) for every student.

    Students without a room see every active service.
    """
    services = t.dorm_service.filter(F.col("Status") == "Active")
    per_building = (
        services.filter(F.col("BuildingID").isNotNull()).groupBy("BuildingID").agg(F.count(F.lit(1)).alias("n"))
    )
    campus = services.select(F.count_if(F.col("BuildingID").isNull())).scalar()
    total = services.select(F.count(F.lit(1))).scalar()
    seen = (
        t.student.select("StudentID")
        .join(resident_buildings(t), "StudentID", "left")
        .join(per_building, "BuildingID", "left")
    )
    visible = F.when(F.col("RoomID").isNull(), total).otherwise(campus + F.coalesce("n", F.lit(0)))
    return seen.select("StudentID", "BuildingID", visible.cast("bigint").alias("VisibleServices"))


def services_for(t: Tables, student_id: str) -> DataFrame:
    """One student's visible services by name."""
    services = t.dorm_service.filter(F.col("Status") == "Active").select("ServiceID", "Name", "BuildingID")
    home = resident_buildings(t).filter(F.col("StudentID") == student_id)
    roomless = home.select(F.count(F.lit(1)) == 0).scalar()
    nearby = services.join(home, "BuildingID", "left_semi")
    others = services.filter(F.col("BuildingID").isNull() | roomless)
    return nearby.unionByName(others).dropDuplicates(["ServiceID"]).orderBy("Name")
