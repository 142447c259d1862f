"""The ordered repair pipelines, and which table changes call for them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.operators import moves, repairs
from hallkeeper.operators.repairs import Moment
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables

HOUSING_TRIGGERS = frozenset({"room_assignment", "occupancy_log", "room", "bed_slot"})
OPERATIONAL_TRIGGERS = frozenset(
    {
        "maintenance_request", "complaint", "incident_report", "registration", "room_transfer", "room_inspection",
        "leave_permission", "visitor_permission", "invoice", "payment_transaction", "penalty", "meal_subscription",
        "student", "system_user",
    }
)
"""Tables whose changes call for each pipeline."""

JOINED_TABLES = frozenset(
    {"occupancy_log", "bed_slot", "room_assignment", "room", "room_transfer", "invoice", "system_user", "building"}
)
"""Tables some step joins to others; the rest are rewritten row by row and cost nothing to work out again."""

OPERATIONAL_COUNTS = {repair.step: repair.table for repair in repairs.OPERATIONAL}


@dataclass(frozen=True)
class Reconciled:
    """Tables after a pipeline, and its change log."""

    tables: Tables
    changes: DataFrame


def reconcile_housing(t: Tables, at: Moment) -> Reconciled:
    """Logs, bed flags, missing beds, room counters: in that order."""
    tables, changes = repairs.run_steps(t, repairs.HOUSING, at)
    return Reconciled(tables, changes)


def reconcile_operational(t: Tables, at: Moment) -> Reconciled:
    """Decision dates, expiries, date fixes, invoices, accounts and rollups.

    Room moves that are due come after them: ``make_due_moves``.
    """
    tables, changes = repairs.run_steps(t, repairs.OPERATIONAL, at)
    return Reconciled(tables, changes)


def pipelines_for(changed: set[str]) -> tuple[str, ...]:
    """Pipelines to run after changes to the given tables."""
    wanted = []
    if changed & HOUSING_TRIGGERS:
        wanted.append("housing")
    if changed & OPERATIONAL_TRIGGERS:
        wanted.append("operational")
    return tuple(wanted)


def _cut(t: Tables, names: Iterable[str]) -> Tables:
    return t.replacing(**{name: cut_lineage(t[name]) for name in sorted(names)})


def make_due_moves(t: Tables, at: Moment) -> Tables:
    """The last operational step: carry out due room transfers and repair housing after them."""
    after = moves.apply_moves(t, moves.complete_due(t, at), at)
    return _cut(after, {"room_transfer", "notification", "room_assignment", "occupancy_log", "bed_slot", "room"})


def reconcile_after(t: Tables, changed: set[str], at: Moment, make_moves: bool = True) -> Tables:
    """Run the pipelines the changed tables call for, cutting lineage in between.

    ``make_moves=False`` leaves due room transfers for another run.
    """
    for name in pipelines_for(changed):
        steps = repairs.HOUSING if name == "housing" else repairs.OPERATIONAL
        after, _ = repairs.run_steps(t, steps, at)
        t = _cut(after, JOINED_TABLES & {table for step in steps for table in (step.table, *step.also)})
        if name == "operational" and make_moves:
            t = make_due_moves(t, at)
    return t


def housing_counts(t: Tables, at: Moment) -> DataFrame:
    """(step, changed_rows) of the housing pipeline."""
    return repairs.count_changes(reconcile_housing(t, at).changes, repairs.HOUSING_COUNTS)


def operational_counts(t: Tables, at: Moment) -> DataFrame:
    """(step, changed_rows) of the operational pipeline up to the room moves."""
    return repairs.count_changes(reconcile_operational(t, at).changes, OPERATIONAL_COUNTS)


def move_counts(t: Tables, at: Moment) -> DataFrame:
    """(step, changed_rows) of the last operational step: due transfers completed after the others have run."""
    ready = _cut(reconcile_operational(t, at).tables, {"room_transfer", "room_assignment"})
    done = moves.complete_due(ready, at).done
    return done.agg(F.count(F.lit(1)).alias("changed_rows")).select(F.lit("completed_due_transfers").alias("step"), "changed_rows")
