"""Room assignments about to be saved: a batch of new and edited rows, judged in order.

Rows are judged against the stored rows and against each other: an accepted row takes its seat, its bed and its student,
so that a later one may find them gone. The stored row that an edit replaces does not count against it. What an edit
gives up is free for the next batch. Stored tables should be reconciled (``plans.reconcile``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.claims import Claim, grant_in_order
from hallkeeper.functions.ranking import Cell, id_block
from hallkeeper.functions.skew import sparse_join, spread_join
from hallkeeper.operators import rules
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables


def _with_stored(t: Tables, rows: DataFrame) -> DataFrame:
    """Candidates with the stored row they replace, and what is stored about their student, room, bed and application."""
    old = t.room_assignment.select(
        "AssignmentID",
        (F.col("Status") == "Active").alias("__was_active"),
        F.col("StudentID").alias("__old_student"),
        F.col("RoomID").alias("__old_room"),
        F.col("BedSlotID").alias("__old_bed"),
    )
    stays = active(t.room_assignment)
    held = stays.groupBy("StudentID").agg(F.count(F.lit(1)).alias("__held"))
    beds = t.bed_slot.select(
        "BedSlotID", F.col("RoomID").alias("BedRoomID"), F.col("IsOccupied").alias("__occupied"), "IsReserved"
    )
    applicants = t.registration.select("ApplicationID", F.col("StudentID").alias("ApplicantID"))
    wide = rows.join(old, "AssignmentID", "left")
    wide = spread_join(wide, held, ["StudentID"], hot_in=rows)
    wide = spread_join(wide, rules.room_frame(t), ["RoomID"], hot_in=rows)
    return sparse_join(sparse_join(wide, beds, ["BedSlotID"]), applicants, ["ApplicationID"])


def _stored_rule(taken: Column, has_bed: Column, own_bed: Column, others: Column) -> Column:
    """The first rule broken against stored rows alone."""
    return rules.first_broken(
        ("other_active_assignment", others > 0),
        ("room_not_found", F.col("RoomID").isNotNull() & F.col("RoomStatus").isNull()),
        ("building_not_active", F.col("BuildingStatus") != "Active"),
        ("room_not_assignable", ~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)),
        ("room_full", taken >= F.col("Capacity")),
        ("application_student", F.col("ApplicantID") != F.col("StudentID")),
        ("bed_missing", has_bed & F.col("BedRoomID").isNull()),
        ("bed_in_other_room", F.col("BedRoomID") != F.col("RoomID")),
        ("bed_not_available", (F.col("__occupied") & ~own_bed) | F.col("IsReserved")),
        ("no_free_bed", ~has_bed & (F.col("TotalBeds") > 0) & (F.col("FreeBeds") < 1)),
    )


def assignment_candidates(t: Tables) -> DataFrame:
    """Every candidate with its first broken rule, null where it is accepted: (LineNo, AssignmentID, StudentID, RoomID, rule).

    Rows that name a bed are served first, then by line. A row is edited once per batch; candidates that are not to be
    Active break no rule and take nothing.
    """
    rows = t.assignment_candidate
    has_bed = F.col("BedSlotID").isNotNull()
    was_active = F.coalesce("__was_active", F.lit(False))
    same_room = was_active & F.coalesce(F.col("__old_room") == F.col("RoomID"), F.lit(False))
    own_bed = F.coalesce(F.col("__old_bed") == F.col("BedSlotID"), F.lit(False))
    own_stay = (was_active & F.coalesce(F.col("__old_student") == F.col("StudentID"), F.lit(False))).cast("int")
    others = F.coalesce("__held", F.lit(0)) - own_stay
    taken = F.greatest(F.coalesce("CurrentOccupancy", F.lit(0)) - same_room.cast("int"), F.lit(0))
    to_be_active = F.coalesce(F.col("Status") == "Active", F.lit(False))
    seats = F.col("Capacity") - F.coalesce("CurrentOccupancy", F.lit(0))
    limit = F.when(has_bed | (F.col("TotalBeds") == 0), seats).otherwise(F.least(seats, F.col("FreeBeds")))
    judged = cut_lineage(
        _with_stored(t, rows).select(
            "LineNo", "AssignmentID", "StudentID", "RoomID",
            F.when(has_bed, 0).otherwise(1).alias("__auto"),
            F.when(to_be_active, _stored_rule(taken, has_bed, own_bed, others)).alias("__stored"),
            F.when(to_be_active, F.col("StudentID")).alias("__student"),
            F.when(to_be_active & ~same_room, F.col("RoomID")).alias("__room"),
            F.when(to_be_active & ~own_bed, F.col("BedSlotID")).alias("__bed"),
            seats.alias("__seats"), limit.alias("__limit"),
        )
    )
    claims = [
        Claim("row", ("AssignmentID",), F.lit(1)),
        Claim("student", ("__student",), F.lit(1)),
        # Rows that keep their seat have no room to claim and so no limit.
        Claim("room", ("__room",), F.when(F.col("__room").isNull(), 1).otherwise(F.coalesce("__limit", F.lit(0)))),
        Claim("bed", ("__bed",), F.lit(1)),
    ]
    contenders = cut_lineage(judged.filter(F.col("__stored").isNull()).drop("__stored"))
    order = [F.asc("__auto"), F.asc("LineNo")]
    granted = grant_in_order(contenders, "LineNo", order, [Cell(F.col("__auto")), Cell(id_block("LineNo"))], claims)
    in_batch = (
        F.when(F.col("Granted"), F.lit(None).cast("string"))
        .when(F.col("__granted_row") >= 1, "row_edited_in_batch")
        .when(F.col("__granted_student") >= 1, "other_active_assignment")
        .when(F.col("__room").isNotNull() & (F.col("__granted_room") >= F.col("__seats")), "room_full")
        .when(F.col("__granted_bed") >= 1, "bed_not_available")
        .otherwise("no_free_bed")
    )
    columns = ["LineNo", "AssignmentID", "StudentID", "RoomID"]
    refused = judged.filter(F.col("__stored").isNotNull()).select(*columns, F.col("__stored").alias("rule"))
    return granted.select(*columns, in_batch.alias("rule")).unionByName(refused)
