"""Repairs of derived state.

A repair reads tables and returns corrected copies of the tables it touches plus
a change log ``(step, table_name, row_key, column_name, old_value, new_value)``.
Only real changes are logged, compared null-safely. Inputs are never modified.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import billed_total, date_value, time_value
from hallkeeper.functions.ranking import Cell, id_block, row_rank, union_all
from hallkeeper.operators import checks, facts
from hallkeeper.operators.facts import active, free_bed
from hallkeeper.schemas import KEYS
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables

LOG_COLUMNS = ("step", "table_name", "row_key", "column_name", "old_value", "new_value")


@dataclass(frozen=True)
class Moment:
    """The reference date and time of a run."""

    as_of: dt.date
    now: dt.datetime

    @property
    def date(self) -> Column:
        return date_value(self.as_of)

    @property
    def time(self) -> Column:
        return time_value(self.now)


@dataclass(frozen=True)
class Repaired:
    """Corrected tables by name, and the log of what changed."""

    tables: dict[str, DataFrame]
    changes: DataFrame


@dataclass(frozen=True)
class Repair:
    """One named step: the table its count is taken on, how to run it, and other tables it touches."""

    step: str
    table: str
    run: Callable[[Tables, Moment], Repaired] = field(repr=False)
    also: tuple[str, ...] = ()


def _new(column: str) -> str:
    return f"__new_{column}"


def rewrite(frame: DataFrame, table: str, key: str, steps: dict[str, str]) -> Repaired:
    """Apply ``__new_<column>`` values of a frame that keeps the table's columns.

    ``steps`` names the step each rewritten column is logged under.
    """
    kept = [c for c in frame.columns if not c.startswith("__")]
    corrected = frame.select(*[F.col(_new(c)).alias(c) if c in steps else F.col(c) for c in kept])
    entries = [
        F.when(
            ~F.col(column).eqNullSafe(F.col(_new(column))),
            F.struct(
                F.lit(step).alias("step"),
                F.lit(table).alias("table_name"),
                F.col(key).cast("string").alias("row_key"),
                F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("old_value"),
                F.col(_new(column)).cast("string").alias("new_value"),
            ),
        )
        for column, step in steps.items()
    ]
    changes = frame.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    return Repaired({table: corrected}, changes)


def _setting(df: DataFrame, **values: Column) -> DataFrame:
    """Add the new value of each named column, keeping the column's type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select("*", *[value.cast(types[name]).alias(_new(name)) for name, value in values.items()])


def surrogate_ids(rows: DataFrame, existing: DataFrame, id_column: str, natural: str) -> DataFrame:
    """Number new rows after the highest existing id, in order of a unique integer.

    The running number is counted per block of ids, so no task sees all rows.
    """
    highest = existing.select(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    numbered = row_rank(
        rows.withColumn("__all", F.lit(1)), ["__all"], [F.asc(natural)], [Cell(id_block(natural))], "__number"
    )
    return numbered.withColumn(id_column, F.col("__number") + highest).drop("__all", "__number")


# Housing steps


def _insert_logs(t: Tables, at: Moment) -> Repaired:
    missing = active(t.room_assignment).join(t.occupancy_log, "AssignmentID", "left_anti")
    rows = missing.select(
        "StudentID", "RoomID", "AssignmentID", F.col("CheckInDate").alias("StartDate"),
        F.lit(None).cast("date").alias("EndDate"),
    )
    rows = surrogate_ids(rows, t.occupancy_log, "LogID", "AssignmentID").select(*t.occupancy_log.columns)
    changes = rows.select(
        F.lit("inserted_logs").alias("step"),
        F.lit("occupancy_log").alias("table_name"),
        F.col("LogID").cast("string").alias("row_key"),
        F.lit("AssignmentID").alias("column_name"),
        F.lit(None).cast("string").alias("old_value"),
        F.col("AssignmentID").cast("string").alias("new_value"),
    )
    return Repaired({"occupancy_log": t.occupancy_log.unionByName(rows)}, changes)


def _close_logs(t: Tables, at: Moment) -> Repaired:
    ended = t.room_assignment.filter(F.col("Status") != "Active").select(
        "AssignmentID", F.coalesce("ActualCheckOutDate", "CheckOutDate", at.date).alias("__closed")
    )
    logs = t.occupancy_log.join(ended, "AssignmentID", "left").select(*t.occupancy_log.columns, "__closed")
    frame = _setting(logs, EndDate=F.coalesce("EndDate", "__closed"))
    return rewrite(frame, "occupancy_log", "LogID", {"EndDate": "closed_logs"})


def _recount_beds(t: Tables, at: Moment) -> Repaired:
    beds = t.bed_slot.join(facts.active_per_bed(t), "BedSlotID", "left")
    frame = _setting(beds, IsOccupied=F.coalesce("ActiveCount", F.lit(0)) > 0).drop("ActiveCount")
    return rewrite(frame, "bed_slot", "BedSlotID", {"IsOccupied": "updated_beds"})


def ranked_free_beds(beds: DataFrame, known_rows: int | None = None) -> DataFrame:
    """(RoomID, BedSlotID, rn): free beds of each room in the order they are handed out."""
    free = beds.filter(free_bed()).select("RoomID", "BedSlotID", "BedNumber")
    cells = [Cell(F.substring("BedNumber", 1, 2)), Cell(F.col("BedNumber")), Cell(id_block("BedSlotID"))]
    order = [F.asc("BedNumber"), F.asc("BedSlotID")]
    return row_rank(free, ["RoomID"], order, cells, known_rows=known_rows).select("RoomID", "BedSlotID", "rn")


def bed_fills(t: Tables) -> DataFrame:
    """(AssignmentID, BedSlotID): free beds handed to active assignments without one.

    Within a room the n-th waiting assignment gets the n-th free bed, which is
    what serving them one after the other gives.
    """
    waiting = (
        active(t.room_assignment)
        .filter(F.col("BedSlotID").isNull())
        .select("RoomID", "AssignmentID", "CheckInDate")
        .join(t.bed_slot.filter(free_bed()), "RoomID", "left_semi")
    )
    cells = [Cell(F.col("CheckInDate")), Cell(id_block("AssignmentID"))]
    queue = row_rank(waiting, ["RoomID"], [F.asc("CheckInDate"), F.asc("AssignmentID")], cells)
    return queue.join(ranked_free_beds(t.bed_slot), ["RoomID", "rn"]).select("AssignmentID", "BedSlotID")


def _fill_beds(t: Tables, at: Moment) -> Repaired:
    # Four outputs read the fills, and the next step counts over them: work them out once.
    fills = cut_lineage(bed_fills(t))
    given = fills.select("AssignmentID", F.col("BedSlotID").alias("__bed"))
    stays = t.room_assignment.join(given, "AssignmentID", "left").select(*t.room_assignment.columns, "__bed")
    step = "assigned_missing_beds"
    assigned = rewrite(
        _setting(stays, BedSlotID=F.coalesce("BedSlotID", "__bed")), "room_assignment", "AssignmentID", {"BedSlotID": step}
    )
    taken = fills.select("BedSlotID", F.lit(True).alias("__taken"))
    beds = t.bed_slot.join(taken, "BedSlotID", "left").select(*t.bed_slot.columns, "__taken")
    occupied = rewrite(
        _setting(beds, IsOccupied=F.coalesce("__taken", "IsOccupied")), "bed_slot", "BedSlotID", {"IsOccupied": step}
    )
    return Repaired({**assigned.tables, **occupied.tables}, assigned.changes.unionByName(occupied.changes))


def _recount_rooms(t: Tables, at: Moment) -> Repaired:
    rooms = t.room.join(facts.active_per_room(t), "RoomID", "left")
    count = F.coalesce("ActiveCount", F.lit(0))
    occupancy = F.when(F.coalesce("CurrentOccupancy", F.lit(0)) != count, count).otherwise(F.col("CurrentOccupancy"))
    status = F.when(F.col("Status").isin(*facts.ASSIGNABLE_ROOM), facts.derived_room_status()).otherwise(F.col("Status"))
    frame = _setting(rooms, CurrentOccupancy=occupancy, Status=status).drop("ActiveCount")
    steps = {"CurrentOccupancy": "updated_room_occupancy", "Status": "updated_room_status"}
    return rewrite(frame, "room", "RoomID", steps)


# Operational steps


def _fill_when(step: str, table: str, key: str, column: str, statuses: Sequence[str], use_time: bool) -> Repair:
    """Fill a missing decision date or time on rows in one of ``statuses``."""

    def run(t: Tables, at: Moment) -> Repaired:
        value = at.time if use_time else at.date
        missing = F.col("Status").isin(*statuses) & F.col(column).isNull()
        frame = _setting(t[table], **{column: F.when(missing, value).otherwise(F.col(column))})
        return rewrite(frame, table, key, {column: step})

    return Repair(step, table, run)


def _expire(step: str, table: str, key: str, column: str, before: str, after: str) -> Repair:
    """Move rows from one status to another once their date has passed."""

    def run(t: Tables, at: Moment) -> Repaired:
        past = (F.col("Status") == before) & (F.col(column) < at.date)
        frame = _setting(t[table], Status=F.when(past, F.lit(after)).otherwise(F.col("Status")))
        return rewrite(frame, table, key, {"Status": step})

    return Repair(step, table, run)


def _fix_checkouts(t: Tables, at: Moment) -> Repaired:
    early = F.col("ActualCheckOutDate") < F.col("CheckInDate")
    value = F.when(early, F.col("CheckInDate")).otherwise(F.col("ActualCheckOutDate"))
    frame = _setting(t.room_assignment, ActualCheckOutDate=value)
    return rewrite(frame, "room_assignment", "AssignmentID", {"ActualCheckOutDate": "repaired_assignment_dates"})


def _fix_moves(t: Tables, at: Moment) -> Repaired:
    """Completed transfers dated before the stay they end.

    Several completed stays may match one transfer; the latest check-in wins.
    """
    step = "repaired_transfer_dates"
    sources = (
        t.room_assignment.filter(F.col("Status") == "Completed")
        .groupBy("StudentID", F.col("RoomID").alias("FromRoomID"))
        .agg(F.max("CheckInDate").alias("__source"))
    )
    transfers = t.room_transfer.join(sources, ["StudentID", "FromRoomID"], "left").select(
        *t.room_transfer.columns, "__source"
    )
    wrong = (F.col("Status") == "Completed") & (F.col("EffectiveMoveDate") < F.col("__source"))
    moved = rewrite(
        _setting(transfers, EffectiveMoveDate=F.when(wrong, F.col("__source")).otherwise(F.col("EffectiveMoveDate"))),
        "room_transfer",
        "TransferID",
        {"EffectiveMoveDate": step},
    )
    lifts = (
        transfers.filter(wrong)
        .groupBy("StudentID", F.col("ToRoomID").alias("RoomID"))
        .agg(F.max("__source").alias("__lift"))
    )
    stays = t.room_assignment.join(lifts, ["StudentID", "RoomID"], "left").select(*t.room_assignment.columns, "__lift")
    early = (F.col("Status") == "Active") & (F.col("CheckInDate") < F.col("__lift"))
    lifted = rewrite(
        _setting(stays, CheckInDate=F.when(early, F.col("__lift")).otherwise(F.col("CheckInDate"))),
        "room_assignment",
        "AssignmentID",
        {"CheckInDate": step},
    )
    return Repaired({**moved.tables, **lifted.tables}, moved.changes.unionByName(lifted.changes))


def _settle_invoices(t: Tables, at: Moment) -> Repaired:
    invoices = t.invoice.join(facts.paid_per_invoice(t), "InvoiceID", "left").withColumn("BilledTotal", billed_total())
    frame = _setting(invoices, PaymentStatus=facts.derived_invoice_status(at.date)).drop("PaidAmount", "BilledTotal")
    return rewrite(frame, "invoice", "InvoiceID", {"PaymentStatus": "invoice_statuses"})


def _sync_accounts(t: Tables, at: Moment) -> Repaired:
    fields = ("Email", "FirstName", "LastName")
    people = t.student.select("StudentID", F.lit(True).alias("__known"), *[F.col(c).alias(f"__s_{c}") for c in fields])
    users = t.system_user.join(people, "StudentID", "left").select(
        *t.system_user.columns, "__known", *[f"__s_{c}" for c in fields]
    )
    values = {c: F.when(F.col("__known"), F.col(f"__s_{c}")).otherwise(F.col(c)) for c in fields}
    return rewrite(_setting(users, **values), "system_user", "UserID", {c: "synced_student_accounts" for c in fields})


def _sync_inspections(t: Tables, at: Moment) -> Repaired:
    latest = facts.latest_inspection(t).select(
        "RoomID", F.col("InspectionDate").alias("__date"), F.col("FurnitureCondition").alias("__condition")
    )
    rooms = t.room.join(latest, "RoomID", "left").select(*t.room.columns, "__date", "__condition")
    seen = F.col("__date").isNotNull()
    frame = _setting(
        rooms,
        LastInspectionDate=F.when(seen, F.col("__date")).otherwise(F.col("LastInspectionDate")),
        FurnitureCondition=F.when(seen, F.col("__condition")).otherwise(F.col("FurnitureCondition")),
    )
    step = "room_inspection_rollups"
    return rewrite(frame, "room", "RoomID", {"LastInspectionDate": step, "FurnitureCondition": step})


def _sync_maintenance(t: Tables, at: Moment) -> Repaired:
    last = facts.last_maintenance(t).withColumnRenamed("LastMaintenanceDate", "__date")
    buildings = t.building.join(last, "BuildingID", "left").select(*t.building.columns, "__date")
    frame = _setting(buildings, LastMaintenanceDate=F.coalesce("__date", "LastMaintenanceDate"))
    return rewrite(frame, "building", "BuildingID", {"LastMaintenanceDate": "building_maintenance_rollups"})


HOUSING: tuple[Repair, ...] = (
    Repair("inserted_logs", "occupancy_log", _insert_logs),
    Repair("closed_logs", "occupancy_log", _close_logs),
    Repair("updated_beds", "bed_slot", _recount_beds),
    Repair("assigned_missing_beds", "room_assignment", _fill_beds, ("bed_slot",)),
    Repair("updated_rooms", "room", _recount_rooms),
)
"""Housing steps in order. The last one logs occupancy and status separately."""

HOUSING_COUNTS = {
    "inserted_logs": "occupancy_log",
    "closed_logs": "occupancy_log",
    "updated_beds": "bed_slot",
    "assigned_missing_beds": "room_assignment",
    "updated_room_occupancy": "room",
    "updated_room_status": "room",
}
"""Reported counts and the table whose changed rows each one counts."""

DECISION_FILLS: tuple[Repair, ...] = (
    _fill_when("maintenance_timestamps", "maintenance_request", "RequestID", "ResolvedAt", ("Resolved", "Closed"), True),
    _fill_when("complaint_timestamps", "complaint", "ComplaintID", "ClosedAt", ("Resolved", "Closed"), True),
    _fill_when("incident_timestamps", "incident_report", "ReportID", "ResolvedAt", ("Resolved", "Closed"), True),
    *[
        _fill_when(step, table, checks.DECIDED[table][0], "ApprovalDate", checks.DECIDED[table][1], False)
        for step, table in (
            ("registration_decisions", "registration"),
            ("transfer_decisions", "room_transfer"),
            ("leave_decisions", "leave_permission"),
            ("visitor_decisions", "visitor_permission"),
        )
    ],
)
"""Missing decision dates and times, in order."""

SAVE_FILLS: tuple[Repair, ...] = (
    *DECISION_FILLS,
    _fill_when(
        "assignment_checkouts", "room_assignment", "AssignmentID", "ActualCheckOutDate", ("Completed", "Cancelled"), False
    ),
)
"""The fills applied to rows as they are saved."""

OPERATIONAL: tuple[Repair, ...] = (
    *DECISION_FILLS,
    _expire("expired_visitor_permissions", "visitor_permission", "PermissionID", "EndDate", "Approved", "Expired"),
    _expire("expired_meal_subscriptions", "meal_subscription", "SubscriptionID", "EndDate", "Active", "Expired"),
    _expire("overdue_penalties", "penalty", "PenaltyID", "DueDate", "Pending", "Overdue"),
    Repair("repaired_assignment_dates", "room_assignment", _fix_checkouts),
    Repair("repaired_transfer_dates", "room_transfer", _fix_moves, ("room_assignment",)),
    Repair("invoice_statuses", "invoice", _settle_invoices),
    Repair("synced_student_accounts", "system_user", _sync_accounts),
    Repair("room_inspection_rollups", "room", _sync_inspections),
    Repair("building_maintenance_rollups", "building", _sync_maintenance),
)
"""Operational steps in order, up to the room moves."""


def run_steps(t: Tables, steps: Sequence[Repair], at: Moment) -> tuple[Tables, DataFrame]:
    """Apply steps in order; returns the repaired tables and the whole change log."""
    logs = []
    for repair in steps:
        result = repair.run(t, at)
        t = t.replacing(**result.tables)
        logs.append(result.changes.select(*LOG_COLUMNS))
    return t, union_all(logs)


def changed_rows(t: Tables, changes: DataFrame, table: str) -> DataFrame:
    """The rows of a repaired table that the change log names."""
    keys = changes.filter(F.col("table_name") == table).select("row_key").distinct()
    keyed = t[table].withColumn("row_key", F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS[table]]))
    return keyed.join(keys, "row_key", "left_semi").select(*t[table].columns)


def step_changes(t: Tables, steps: Sequence[Repair], step: str, at: Moment) -> DataFrame:
    """The change log of one step run on the given tables as they are."""
    repair = next(r for r in steps if r.step == step)
    return repair.run(t, at).changes.select(*LOG_COLUMNS)


def count_changes(changes: DataFrame, steps: dict[str, str]) -> DataFrame:
    """(step, changed_rows) with zero counts kept; rows of a step's own table count once."""
    own = reduce(or_, [(F.col("step") == step) & (F.col("table_name") == table) for step, table in steps.items()])
    # One short key per logged row; a distinct count per step and column would hold a wide row for each.
    counted = changes.filter(own).groupBy("step").agg(F.count_distinct("row_key").alias("changed_rows"))
    names = F.explode(F.array(*[F.lit(step) for step in steps])).alias("step")
    every = changes.sparkSession.range(1).select(names)
    return every.join(counted, "step", "left").select("step", F.coalesce("changed_rows", F.lit(0).cast("bigint")).alias("changed_rows"))


def save_time_fills(t: Tables, table: str, rows: DataFrame, at: Moment) -> DataFrame:
    """Incoming rows of one table with the missing decision dates and times filled."""
    for repair in SAVE_FILLS:
        if repair.table == table:
            rows = repair.run(t.replacing(**{table: rows}), at).tables[table]
    return rows
