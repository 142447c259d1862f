"""Shared facts: one set-based definition each, reused by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hallkeeper.functions.columns import money
from hallkeeper.functions.ranking import first_per_key
from hallkeeper.functions.skew import spread_join
from hallkeeper.tables import Tables

ASSIGNABLE_ROOM = ("Available", "Occupied")


def active(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("Status") == "Active")


def free_bed() -> Column:
    """A bed that is neither occupied nor reserved."""
    return ~F.col("IsOccupied") & ~F.col("IsReserved")


def current_assignment(t: Tables) -> DataFrame:
    """Latest active assignment per student, by check-in date then id."""
    return first_per_key(
        active(t.room_assignment), ["StudentID"], [F.desc("CheckInDate"), F.desc("AssignmentID")]
    )


def active_per_room(t: Tables) -> DataFrame:
    """(RoomID, ActiveCount)."""
    return active(t.room_assignment).groupBy("RoomID").agg(F.count(F.lit(1)).alias("ActiveCount"))


def active_per_bed(t: Tables) -> DataFrame:
    """(BedSlotID, ActiveCount); assignments without a bed are left out."""
    held = active(t.room_assignment).filter(F.col("BedSlotID").isNotNull())
    return held.groupBy("BedSlotID").agg(F.count(F.lit(1)).alias("ActiveCount"))


def paid_per_invoice(t: Tables) -> DataFrame:
    """(InvoiceID, PaidAmount) over completed payments."""
    completed = t.payment_transaction.filter(F.col("PaymentStatus") == "Completed")
    return completed.groupBy("InvoiceID").agg(
        money(F.coalesce(F.sum("PaymentAmount"), F.lit(0))).alias("PaidAmount")
    )


def bed_counts(t: Tables) -> DataFrame:
    """(RoomID, TotalBeds, FreeBeds, OccupiedBeds). Bed ids are unique, so no DISTINCT."""
    return t.bed_slot.groupBy("RoomID").agg(
        F.count(F.lit(1)).alias("TotalBeds"),
        F.count_if(free_bed()).alias("FreeBeds"),
        F.count_if(F.col("IsOccupied")).alias("OccupiedBeds"),
    )


def with_bed_counts(rooms: DataFrame, t: Tables) -> DataFrame:
    """Rooms with their bed counts; rooms without beds get zeros."""
    counted = rooms.join(bed_counts(t), "RoomID", "left")
    return counted.fillna(0, ["TotalBeds", "FreeBeds", "OccupiedBeds"])


def available_beds() -> Column:
    """Beds not occupied (reserved ones included); seats left if the room has no beds."""
    by_bed = F.greatest(F.col("TotalBeds") - F.col("OccupiedBeds"), F.lit(0))
    by_seat = F.greatest(F.col("Capacity") - F.coalesce("CurrentOccupancy", F.lit(0)), F.lit(0))
    return F.when(F.col("TotalBeds") > 0, by_bed).otherwise(by_seat).cast("bigint")


def has_assignable_bed() -> Column:
    """No beds at all, or a free one."""
    return (F.col("TotalBeds") == 0) | (F.col("FreeBeds") > 0)


def latest_inspections(t: Tables) -> DataFrame:
    """Completed inspections of each room's latest date, ties counted.

    (RoomID, InspectionDate, FurnitureCondition, Inspections). Rows are first
    reduced to one per room, day and condition, so a much-inspected room does
    not travel as raw rows.
    """
    daily = (
        t.room_inspection.filter(F.col("Status") == "Completed")
        .groupBy("RoomID", "InspectionDate", "FurnitureCondition")
        .agg(F.count(F.lit(1)).alias("Inspections"))
    )
    newest = (
        t.room_inspection.filter(F.col("Status") == "Completed")
        .groupBy("RoomID")
        .agg(F.max("InspectionDate").alias("InspectionDate"))
    )
    return daily.join(newest, ["RoomID", "InspectionDate"]).select(
        "RoomID", "InspectionDate", "FurnitureCondition", "Inspections"
    )


def latest_inspection(t: Tables) -> DataFrame:
    """One completed inspection per room: latest date, then highest id."""
    completed = t.room_inspection.filter(F.col("Status") == "Completed")
    return first_per_key(
        completed.select("RoomID", "InspectionID", "InspectionDate", "FurnitureCondition"),
        ["RoomID"],
        [F.desc("InspectionDate"), F.desc("InspectionID"), F.asc("FurnitureCondition")],
    )


def last_maintenance(t: Tables) -> DataFrame:
    """(BuildingID, LastMaintenanceDate) from resolved requests.

    Requests shrink to one row per room before they meet the rooms.
    """
    by_room = (
        t.maintenance_request.filter(F.col("Status").isin("Resolved", "Closed") & F.col("ResolvedAt").isNotNull())
        .groupBy("RoomID")
        .agg(F.max(F.to_date("ResolvedAt")).alias("Resolved"))
    )
    return (
        by_room.join(t.room.select("RoomID", "BuildingID"), "RoomID")
        .groupBy("BuildingID")
        .agg(F.max("Resolved").alias("LastMaintenanceDate"))
    )


def derived_invoice_status(as_of: Column) -> Column:
    """Status an invoice should have, from PaidAmount and BilledTotal columns."""
    paid = F.coalesce(F.col("PaidAmount"), F.lit(0))
    return (
        F.when(F.col("PaymentStatus") == "Cancelled", "Cancelled")
        .when(paid >= F.col("BilledTotal"), "Paid")
        .when(F.col("DueDate") < as_of, "Overdue")
        .when(paid > 0, "Partial")
        .otherwise("Unpaid")
    )


def derived_room_status() -> Column:
    """Occupied when a room with seats is full of active residents."""
    count = F.coalesce(F.col("ActiveCount"), F.lit(0))
    full = (count >= F.col("Capacity")) & (F.col("Capacity") > 0)
    return F.when(full, "Occupied").otherwise("Available")


def later_counts(
    left: DataFrame, left_day: str, right: DataFrame, right_day: str, keys: Sequence[str], out: str
) -> DataFrame:
    """For each left row, the number of right rows of the same key with a later day.

    Both sides shrink to one row per key and day first, so no pairs are built:
    a group holds at most as many rows as the calendar has days.
    """
    keys = list(keys)
    days = (
        left.groupBy(*keys, F.col(left_day).alias("__day"))
        .agg(F.lit(0).cast("bigint").alias("__n"))
        .unionByName(right.groupBy(*keys, F.col(right_day).alias("__day")).agg(F.count(F.lit(1)).alias("__n")))
        .groupBy(*keys, "__day")
        .agg(F.sum("__n").alias("__n"))
    )
    after = Window.partitionBy(*keys).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    totals = days.select(*keys, "__day", F.coalesce(F.sum("__n").over(after), F.lit(0)).alias(out))
    return spread_join(left.withColumn("__day", F.col(left_day)), totals, [*keys, "__day"]).drop("__day")
