"""Repairs after changes: only the rows that a change can reach.

``plans.reconcile`` repairs whole tables. Here the keys of changed rows are carried along the foreign keys to the rows
each repair step reads for them, the steps run on those rows alone, and the rows they change are given back. On tables
that were reconciled before the change, the outcome equals the whole pipelines' (due moves left out).

Every group of steps whose tables were changed runs, also where the whole pipeline would wait for another table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.ranking import union_all
from hallkeeper.operators import repairs
from hallkeeper.operators.repairs import LOG_COLUMNS, Moment, Repair, changed_rows, run_steps
from hallkeeper.schemas import KEYS
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables

Touched = Mapping[str, DataFrame]
"""Per table, the changed rows as they were and as they are."""


def _ids(t: Tables, touched: Touched, name: str, *columns: tuple[str, str]) -> DataFrame:
    """Distinct values of the columns (table, column) in changed rows, as ``name``; none if no such table changed."""
    found = [touched[table].select(F.col(c).alias(name)) for table, c in columns if table in touched]
    if not found:
        table, column = columns[0]
        return t[table].select(F.col(column).alias(name)).limit(0)
    return union_all(found).filter(F.col(name).isNotNull()).distinct()


def _any_of(rows: DataFrame, key: str, *joins: tuple[DataFrame, str]) -> DataFrame:
    """Rows that meet any of the keys (frame, column), once each."""
    parts = [rows.join(ids, column, "left_semi").select(*rows.columns) for ids, column in joins]
    return union_all(parts).dropDuplicates([key])


def _housing(t: Tables, touched: Touched) -> Tables:
    """Rooms and beds of changed rows, with all their stays and those stays' logs."""
    beds = cut_lineage(_ids(t, touched, "BedSlotID", ("bed_slot", "BedSlotID"), ("room_assignment", "BedSlotID")))
    rooms = _ids(t, touched, "RoomID", ("room", "RoomID"), ("room_assignment", "RoomID"), ("bed_slot", "RoomID"))
    beds_rooms = t.bed_slot.join(beds, "BedSlotID", "left_semi").select("RoomID")
    rooms = cut_lineage(rooms.unionByName(beds_rooms).distinct())
    slots = cut_lineage(_any_of(t.bed_slot, "BedSlotID", (rooms, "RoomID"), (beds, "BedSlotID")))
    named = _ids(t, touched, "AssignmentID", ("room_assignment", "AssignmentID"), ("occupancy_log", "AssignmentID"))
    stays = cut_lineage(
        _any_of(
            t.room_assignment, "AssignmentID",
            (rooms, "RoomID"), (slots.select("BedSlotID"), "BedSlotID"), (named, "AssignmentID"),
        )
    )
    # The row of the highest id is taken along, so that new rows are numbered as over the whole table.
    highest = t.occupancy_log.agg(F.max("LogID").alias("LogID"))
    changed = _ids(t, touched, "LogID", ("occupancy_log", "LogID"))
    logs = _any_of(
        t.occupancy_log, "LogID", (stays.select("AssignmentID"), "AssignmentID"), (changed, "LogID"), (highest, "LogID")
    )
    room = t.room.join(rooms, "RoomID", "left_semi").select(*t.room.columns)
    return t.replacing(bed_slot=slots, room_assignment=stays, occupancy_log=cut_lineage(logs), room=room)


def _own_rows(t: Tables, touched: Touched) -> Tables:
    """The changed rows themselves."""
    found = {}
    for name, rows in touched.items():
        key = list(KEYS[name])
        found[name] = t[name].join(rows.select(*key).distinct(), key, "left_semi").select(*t[name].columns)
    return t.replacing(**found)


def _student_moves(t: Tables, touched: Touched) -> Tables:
    """Transfers and stays of the students of changed ones."""
    students = cut_lineage(_ids(t, touched, "StudentID", ("room_transfer", "StudentID"), ("room_assignment", "StudentID")))
    return t.replacing(
        **{n: t[n].join(students, "StudentID", "left_semi").select(*t[n].columns) for n in ("room_transfer", "room_assignment")}
    )


def _parents(t: Tables, touched: Touched) -> Tables:
    """Invoices of changed payments, accounts of changed students, rooms of changed inspections; with what they sum up."""
    invoices = _ids(t, touched, "InvoiceID", ("invoice", "InvoiceID"), ("payment_transaction", "InvoiceID"))
    users = _ids(t, touched, "UserID", ("system_user", "UserID"))
    students = _ids(t, touched, "StudentID", ("student", "StudentID"))
    rooms = _ids(t, touched, "RoomID", ("room", "RoomID"), ("room_inspection", "RoomID"))

    def kept(name: str, ids: DataFrame, column: str) -> DataFrame:
        return t[name].join(ids, column, "left_semi").select(*t[name].columns)

    return t.replacing(
        invoice=kept("invoice", invoices, "InvoiceID"),
        payment_transaction=kept("payment_transaction", invoices, "InvoiceID"),
        system_user=_any_of(t.system_user, "UserID", (users, "UserID"), (students, "StudentID")),
        room=kept("room", rooms, "RoomID"),
        room_inspection=kept("room_inspection", rooms, "RoomID"),
    )


def _buildings(t: Tables, touched: Touched) -> Tables:
    """Buildings of changed rooms and requests, with all their rooms and those rooms' requests."""
    rooms = _ids(t, touched, "RoomID", ("maintenance_request", "RoomID"))
    direct = _ids(t, touched, "BuildingID", ("building", "BuildingID"), ("room", "BuildingID"))
    over = t.room.join(rooms, "RoomID", "left_semi").select("BuildingID")
    buildings = cut_lineage(direct.unionByName(over).distinct())
    room = t.room.join(buildings, "BuildingID", "left_semi").select(*t.room.columns)
    requests = t.maintenance_request.join(room.select("RoomID"), "RoomID", "left_semi")
    building = t.building.join(buildings, "BuildingID", "left_semi")
    return t.replacing(
        building=building.select(*t.building.columns),
        room=room,
        maintenance_request=requests.select(*t.maintenance_request.columns),
    )


@dataclass(frozen=True)
class Group:
    """Steps that run on one restriction of the tables, with the tables whose changes call for each step."""

    scope: Callable[[Tables, Touched], Tables]
    steps: tuple[tuple[Repair, frozenset[str]], ...]


def _steps(**called_by: set[str]) -> tuple[tuple[Repair, frozenset[str]], ...]:
    return tuple((r, frozenset(called_by[r.step])) for r in repairs.OPERATIONAL if r.step in called_by)


HOUSING_TABLES = frozenset({"room_assignment", "occupancy_log", "room", "bed_slot"})
JOINED = _steps(
    invoice_statuses={"invoice", "payment_transaction"},
    synced_student_accounts={"system_user", "student"},
    room_inspection_rollups={"room", "room_inspection"},
)
MOVES = _steps(repaired_transfer_dates={"room_transfer", "room_assignment"})
ROLLUPS = _steps(building_maintenance_rollups={"maintenance_request", "room", "building"})
_ELSEWHERE = {r.step for r, _ in (*JOINED, *MOVES, *ROLLUPS)}

GROUPS: tuple[Group, ...] = (
    Group(_housing, tuple((r, HOUSING_TABLES) for r in repairs.HOUSING)),
    Group(_own_rows, tuple((r, frozenset({r.table})) for r in repairs.OPERATIONAL if r.step not in _ELSEWHERE)),
    Group(_student_moves, MOVES),
    Group(_parents, JOINED),
    Group(_buildings, ROLLUPS),
)
"""In the order of the whole pipelines."""


@dataclass(frozen=True)
class Reached:
    """The repaired rows of each table, and the change log."""

    rows: dict[str, DataFrame]
    changes: DataFrame


def reconcile_changed(t: Tables, touched: Touched, at: Moment) -> Reached:
    """Repair what the changed rows can reach in tables ``t``, which hold the changes already."""
    rows: dict[str, DataFrame] = {}
    logs = []
    for group in GROUPS:
        steps = [r for r, tables in group.steps if tables & set(touched)]
        if not steps:
            continue
        after, log = run_steps(group.scope(t, touched), steps, at)
        log = cut_lineage(log)
        logs.append(log)
        for table in sorted({name for r in steps for name in (r.table, *r.also)}):
            new = cut_lineage(changed_rows(after, log, table))
            if new.isEmpty():
                continue
            key = list(KEYS[table])
            if table in rows:
                new = cut_lineage(rows[table].join(new, key, "left_anti").select(*new.columns).unionByName(new))
            rows[table] = new
            t = t.replacing(**{table: t[table].join(new, key, "left_anti").select(*t[table].columns).unionByName(new)})
    empty = "step string, table_name string, row_key string, column_name string, old_value string, new_value string"
    if not logs:
        return Reached(rows, next(iter(touched.values())).sparkSession.createDataFrame([], empty))
    return Reached(rows, union_all(logs).select(*LOG_COLUMNS))
