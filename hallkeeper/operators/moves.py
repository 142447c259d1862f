"""Batch room moves, in rounds over what the round before has changed.

Where the source moves one student at a time and raises on the first broken rule, all due transfers are taken at once;
those that cannot be carried out come back with the reason. Inputs should be reconciled (``plans.reconcile``).

A round admits every transfer it can. What a later round may admit follows from what the round before did, so each
round judges only its frontier:

* transfers into a room that somebody left, or that got a bed back;
* transfers out of a room the student has just moved into;
* transfers out of a room for which the student had an eligible transfer that found no place (it no longer holds the
  stay that another one could end).

No other waiting transfer can have become eligible. Residents, beds and stays are counted once; from then on every
round adds its moves to a journal, and a round's state is the first count plus the journal, for the rooms and students
of the frontier only. Nothing is rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.ranking import Cell, id_block, row_rank
from hallkeeper.functions.skew import spread_join
from hallkeeper.operators import rules
from hallkeeper.operators.allocation import MOVED_NOTICE, housing_notices
from hallkeeper.operators.facts import ASSIGNABLE_ROOM, active
from hallkeeper.operators.queues import due_transfers
from hallkeeper.operators.repairs import HOUSING, Moment, run_steps
from hallkeeper.session import Journal, cut_lineage
from hallkeeper.tables import Tables

MOVED = (
    "TransferID bigint, StudentID string, FromRoomID bigint, ToRoomID bigint, OldAssignmentID bigint, "
    "OldBedSlotID bigint, NewAssignmentID bigint, BedSlotID bigint, MoveDate date, MonthlyRent decimal(10,2), "
    "DepositAmount decimal(10,2), ContractDuration string"
)

SEATED = "AssignmentID bigint, RoomID bigint, BedSlotID bigint"


@dataclass(frozen=True)
class Moves:
    """Carried-out moves and refused transfers with their reason; ``judged`` has the number judged in each round."""

    done: DataFrame
    refused: DataFrame
    judged: tuple[int, ...] = field(default=())


def _order() -> list[Column]:
    return [F.asc("__approved"), F.asc("TransferID")]


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows to be joined by a shuffle: a broadcast of each join and round would add up on the driver as tables grow."""
    return rows.hint("merge")


def _cells() -> list[Cell]:
    return [Cell(F.col("__approved")), Cell(id_block("TransferID"))]


@dataclass(frozen=True)
class _State:
    """What was counted at the start, and the journals of what has happened since.

    ``residents`` (RoomID, Residents); ``beds`` (BedSlotID, RoomID, BedNumber, IsReserved, Holders); ``stays``, those a
    pending transfer could end; ``waiting`` (RoomID, AssignmentID, CheckInDate), stays without a bed in rooms that have
    some; all of the rooms and students of pending transfers.
    """

    residents: DataFrame
    beds: DataFrame
    stays: DataFrame
    waiting: DataFrame
    moved: Journal
    seated: Journal
    known_stays: int
    known_beds: int

    def residents_in(self, rooms: DataFrame) -> DataFrame:
        """(RoomID, Residents) of the given RoomID rows."""
        moved = self.moved.rows()
        came = moved.select(F.col("ToRoomID").alias("RoomID"), F.lit(1).cast("bigint").alias("Residents"))
        left = moved.select(F.col("FromRoomID").alias("RoomID"), F.lit(-1).cast("bigint").alias("Residents"))
        changes = self.residents.unionByName(came).unionByName(left)
        return changes.join(_shuffled(rooms), "RoomID", "left_semi").groupBy("RoomID").agg(F.sum("Residents").alias("Residents"))

    def beds_in(self, rooms: DataFrame) -> DataFrame:
        """(RoomID, BedSlotID, BedNumber, Open) of the given RoomID rows: open beds are unreserved and held by nobody."""
        moved = self.moved.rows()
        one = F.lit(1).cast("bigint")
        changes = (
            moved.select(F.col("OldBedSlotID").alias("BedSlotID"), (-one).alias("Change"))
            .unionByName(moved.select("BedSlotID", one.alias("Change")))
            .unionByName(self.seated.rows().select("BedSlotID", one.alias("Change")))
            .filter(F.col("BedSlotID").isNotNull())
            .groupBy("BedSlotID")
            .agg(F.sum("Change").alias("Change"))
        )
        beds = self.beds.join(_shuffled(rooms), "RoomID", "left_semi").join(_shuffled(changes), "BedSlotID", "left")
        holders = F.col("Holders") + F.coalesce("Change", F.lit(0))
        return beds.select("RoomID", "BedSlotID", "BedNumber", ((holders == 0) & ~F.col("IsReserved")).alias("Open"))

    def open_beds(self, rooms: DataFrame) -> DataFrame:
        """(RoomID, rn, __bed): open beds in hand-out order."""
        cells = [Cell(F.substring("BedNumber", 1, 2)), Cell(F.col("BedNumber")), Cell(id_block("BedSlotID"))]
        beds = self.beds_in(rooms).filter("Open").drop("Open")
        ranked = row_rank(beds, ["RoomID"], [F.asc("BedNumber"), F.asc("BedSlotID")], cells, known_rows=self.known_beds)
        return ranked.select("RoomID", "rn", F.col("BedSlotID").alias("__bed"))

    def stays_of(self, places: DataFrame) -> DataFrame:
        """Stays now active for the given (StudentID, FromRoomID) rows, with the bed they hold."""
        moved = self.moved.rows()
        arrived = moved.select(
            F.col("NewAssignmentID").alias("AssignmentID"), "StudentID", F.col("ToRoomID").alias("RoomID"), "BedSlotID",
            F.col("MoveDate").alias("CheckInDate"), "ContractDuration",
        )
        here = places.withColumnRenamed("FromRoomID", "RoomID")
        found = self.stays.unionByName(arrived).join(_shuffled(here), ["StudentID", "RoomID"], "left_semi")
        seated = self.seated.rows().select("AssignmentID", F.col("BedSlotID").alias("__bed"))
        left = moved.select(F.col("OldAssignmentID").alias("AssignmentID"))
        now = found.join(_shuffled(left), "AssignmentID", "left_anti")
        return now.join(_shuffled(seated), "AssignmentID", "left").withColumn("BedSlotID", F.coalesce("BedSlotID", "__bed")).drop("__bed")

    def seat(self, rooms: DataFrame, number: int) -> None:
        """Hand open beds of the given RoomID rows to stays without one, oldest check-in first."""
        moved = self.moved.rows().select(F.col("OldAssignmentID").alias("AssignmentID"))
        waiting = (
            self.waiting.join(_shuffled(rooms), "RoomID", "left_semi")
            .join(_shuffled(self.seated.rows()), "AssignmentID", "left_anti")
            .join(_shuffled(moved), "AssignmentID", "left_anti")
        )
        cells = [Cell(F.col("CheckInDate")), Cell(id_block("AssignmentID"))]
        order = [F.asc("CheckInDate"), F.asc("AssignmentID")]
        queue = row_rank(waiting, ["RoomID"], order, cells, known_rows=self.known_stays)
        given = queue.join(_shuffled(self.open_beds(rooms)), ["RoomID", "rn"])
        self.seated.append(given.select("AssignmentID", "RoomID", F.col("__bed").alias("BedSlotID")), number)


def _first_state(t: Tables, pending: DataFrame, touched: DataFrame) -> _State:
    spark = pending.sparkSession
    held = active(t.room_assignment).select(
        "AssignmentID", "StudentID", "RoomID", "BedSlotID", "CheckInDate", "ContractDuration"
    )
    holders = held.filter(F.col("BedSlotID").isNotNull()).groupBy("BedSlotID").agg(F.count(F.lit(1)).alias("Holders"))
    inside = held.join(_shuffled(touched), "RoomID", "left_semi")
    beds = cut_lineage(
        t.bed_slot.join(_shuffled(touched), "RoomID", "left_semi")
        .join(_shuffled(holders), "BedSlotID", "left")
        .select("BedSlotID", "RoomID", "BedNumber", "IsReserved", F.coalesce("Holders", F.lit(0).cast("bigint")).alias("Holders"))
    )
    places = pending.select("StudentID", F.col("FromRoomID").alias("RoomID"))
    stays = cut_lineage(held.join(_shuffled(places), ["StudentID", "RoomID"], "left_semi").select(*held.columns))
    residents = cut_lineage(inside.groupBy("RoomID").agg(F.count(F.lit(1)).alias("Residents")))
    without = inside.filter(F.col("BedSlotID").isNull()).join(_shuffled(beds), "RoomID", "left_semi")
    waiting = cut_lineage(without.select("RoomID", "AssignmentID", "CheckInDate"))
    state = _State(
        residents, beds, stays, waiting, Journal(spark, "moved", MOVED), Journal(spark, "seated", SEATED),
        stays.count() + waiting.count() + pending.count(), beds.count(),
    )
    state.seat(touched, 0)
    return state


def _judged(front: DataFrame, state: _State, known_rows: int) -> DataFrame:
    """Transfers with the destination's present state and the first broken rule."""
    places = front.select("StudentID", "FromRoomID").distinct()
    rooms = front.select(F.col("ToRoomID").alias("RoomID")).distinct()
    sources = state.stays_of(places).groupBy("StudentID", F.col("RoomID").alias("FromRoomID")).agg(F.count(F.lit(1)).alias("Sources"))
    beds = state.beds_in(rooms).groupBy("RoomID").agg(F.count(F.lit(1)).alias("TotalBeds"), F.count_if("Open").alias("FreeBeds"))
    counted = state.residents_in(rooms).join(_shuffled(beds), "RoomID", "full").withColumnRenamed("RoomID", "ToRoomID")
    wide = spread_join(front, sources, ["StudentID", "FromRoomID"], known_rows=known_rows, shuffled=True)
    wide = spread_join(wide, counted, ["ToRoomID"], hot_in=front, known_rows=known_rows, shuffled=True)
    wide = wide.fillna(0, ["Residents", "TotalBeds", "FreeBeds"])
    reason = rules.first_broken(
        ("no_active_source", F.col("Sources").isNull()),
        *[(name, F.col("Never") == name) for name in ("room_not_found", "building_not_active", "room_not_assignable")],
        ("room_full", F.col("Residents") >= F.col("Capacity")),
        ("gender_not_admitted", F.col("Never") == "gender_not_admitted"),
        ("no_free_bed", (F.col("TotalBeds") > 0) & (F.col("FreeBeds") < 1)),
    )
    return wide.withColumn("Reason", reason)


def _with_sources(eligible: DataFrame, state: _State, known_rows: int) -> DataFrame:
    """Eligible transfers with the stay each one ends.

    Of a student's transfers out of one room the n-th ends the n-th latest stay there; transfers beyond the stays wait.
    """
    place = ["StudentID", "FromRoomID"]
    stays = state.stays_of(eligible.select(*place).distinct()).select(
        "StudentID",
        F.col("RoomID").alias("FromRoomID"),
        F.col("AssignmentID").alias("OldAssignmentID"),
        F.col("BedSlotID").alias("OldBedSlotID"),
        F.col("CheckInDate").alias("SourceCheckIn"),
        "ContractDuration",
    )
    order = [F.desc("SourceCheckIn"), F.desc("OldAssignmentID")]
    cells = [Cell(F.col("SourceCheckIn"), True), Cell(id_block("OldAssignmentID"), True)]
    latest = row_rank(stays, place, order, cells, known_rows=state.known_stays)
    asked = row_rank(eligible, place, _order(), _cells(), known_rows=known_rows)
    return asked.join(_shuffled(latest), [*place, "rn"]).drop("rn")


def _admitted(eligible: DataFrame, state: _State, base: Column, known_rows: int) -> DataFrame:
    """Eligible transfers that get a place, with the stay they end, their bed and terms."""
    seats = F.col("Capacity") - F.col("Residents")
    room_for = F.when(F.col("TotalBeds") > 0, F.least(seats, F.col("FreeBeds"))).otherwise(seats)
    first = _with_sources(eligible, state, known_rows)
    ranked = row_rank(first, ["ToRoomID"], _order(), _cells(), known_rows=known_rows).filter(F.col("rn") <= room_for)
    rooms = eligible.select(F.col("ToRoomID").alias("RoomID")).distinct()
    beds = state.open_beds(rooms).withColumnRenamed("RoomID", "ToRoomID")
    return ranked.join(_shuffled(beds), ["ToRoomID", "rn"], "left").select(
        "TransferID", "StudentID", "FromRoomID", "ToRoomID", "OldAssignmentID", "OldBedSlotID",
        (base + 1 + F.col("TransferID")).alias("NewAssignmentID"),
        F.col("__bed").alias("BedSlotID"),
        F.greatest("WantedDate", "SourceCheckIn").alias("MoveDate"),
        "MonthlyRent",
        F.coalesce("DepositAmount", F.lit(0)).alias("DepositAmount"),
        "ContractDuration",
    )


def _next_frontier(waiting: DataFrame, moved: DataFrame, eligible: DataFrame, freed: DataFrame) -> DataFrame:
    """Waiting transfers that the round's moves may have made eligible."""
    place = ["StudentID", "FromRoomID"]
    left = moved.select(F.col("FromRoomID").alias("ToRoomID")).unionByName(freed.select(F.col("RoomID").alias("ToRoomID")))
    came = moved.select("StudentID", F.col("ToRoomID").alias("FromRoomID"))
    without_place = eligible.join(_shuffled(moved), "TransferID", "left_anti").select(*place)
    changed = came.unionByName(without_place).distinct().withColumn("__source", F.lit(True))
    near = waiting.join(_shuffled(left.distinct().withColumn("__room", F.lit(True))), "ToRoomID", "left")
    near = near.join(_shuffled(changed), place, "left")
    return near.filter(F.col("__room") | F.col("__source")).select(*waiting.columns)


def complete_transfers(t: Tables, transfer_ids: DataFrame, at: Moment) -> Moves:
    """Move students for the given TransferID rows, in rounds.

    A round judges its transfers against the current state, gives each eligible one the stay it ends, and admits them
    per destination in order of approval date (missing first) and id while seats and beds last. Seats and beds left
    behind are free in the next round, after residents without a bed have taken theirs. The first round judges all,
    later ones their frontier; a round that admits nobody is the last. Every round admits one transfer at least.
    """
    genders = t.student.select("StudentID", "Gender")
    asked = t.room_transfer.filter(F.col("Status").isin("Pending", "Approved")).join(
        _shuffled(transfer_ids), "TransferID", "left_semi"
    )
    rooms = rules.room_frame(t).select(
        F.col("RoomID").alias("ToRoomID"), "RoomStatus", "BuildingStatus", "GenderAllowed", "Capacity", "MonthlyRent", "DepositAmount"
    )
    admitted = F.col("GenderAllowed").isin("Mixed") | F.coalesce(F.col("GenderAllowed") == F.col("Gender"), F.lit(False))
    never = rules.first_broken(
        ("room_not_found", F.col("RoomStatus").isNull()),
        ("building_not_active", F.col("BuildingStatus") != "Active"),
        ("room_not_assignable", ~F.col("RoomStatus").isin(*ASSIGNABLE_ROOM)),
        ("gender_not_admitted", ~admitted),
    )
    pending = cut_lineage(
        spread_join(
            asked.join(_shuffled(genders), "StudentID"), rooms, ["ToRoomID"], hot_in=t.room_transfer, shuffled=True
        ).select(
            "TransferID", "StudentID", "FromRoomID", "ToRoomID",
            F.coalesce("EffectiveMoveDate", at.date).alias("WantedDate"),
            F.coalesce("ApprovalDate", F.lit("0001-01-01").cast("date")).alias("__approved"),
            "Capacity", "MonthlyRent", "DepositAmount", never.alias("Never"),
        )
    )
    ends = [pending.select(F.col(c).alias("RoomID")) for c in ("FromRoomID", "ToRoomID")]
    state = _first_state(t, pending, cut_lineage(ends[0].unionByName(ends[1]).distinct()))
    base = t.room_assignment.select(F.coalesce(F.max("AssignmentID"), F.lit(0))).scalar()

    possible = pending.filter(F.col("Never").isNull())
    front, judged = cut_lineage(possible), []
    while True:
        known_rows = front.count()
        if not known_rows:
            break
        judged.append(known_rows)
        number = len(judged)
        eligible = cut_lineage(_judged(front, state, known_rows).filter(F.col("Reason").isNull()))
        moved = state.moved.append(_admitted(eligible, state, base, known_rows), number)
        if moved.isEmpty():
            break
        freed = state.beds.join(
            _shuffled(moved.select(F.col("OldBedSlotID").alias("BedSlotID"))), "BedSlotID", "left_semi"
        )
        freed = freed.select("RoomID").distinct()
        state.seat(freed, number)
        waiting = possible.join(_shuffled(state.moved.rows()), "TransferID", "left_anti")
        front = cut_lineage(_next_frontier(waiting, moved, eligible, freed))

    left = pending.join(_shuffled(state.moved.rows()), "TransferID", "left_anti")
    refused = _judged(left, state, pending.count()).select("TransferID", "StudentID", "FromRoomID", "ToRoomID", "Reason")
    return Moves(state.moved.rows(), refused, tuple(judged))


def complete_due(t: Tables, at: Moment) -> Moves:
    """Carry out every approved transfer whose move is due and not yet made."""
    return complete_transfers(t, due_transfers(t, at.as_of).select("TransferID"), at)


def move_outcomes(t: Tables, at: Moment) -> DataFrame:
    """Due transfers with outcome: (TransferID, StudentID, ToRoomID, Round, BedSlotID, MoveDate, Reason)."""
    moves = complete_due(t, at)
    done = moves.done.select(
        "TransferID", "StudentID", "ToRoomID", "Round", "BedSlotID", "MoveDate", F.lit(None).cast("string").alias("Reason")
    )
    refused = moves.refused.select("TransferID", "StudentID", "ToRoomID", "Reason")
    return done.unionByName(refused, allowMissingColumns=True)


def apply_moves(t: Tables, moves: Moves, at: Moment) -> Tables:
    """The tables after the moves: stays, logs, transfers, notices, then housing repairs."""
    done = moves.done
    ends = done.select(F.col("OldAssignmentID").alias("AssignmentID"), F.col("MoveDate").alias("__end"))
    arrived = done.select(
        F.col("NewAssignmentID").alias("AssignmentID"), "StudentID", F.col("ToRoomID").alias("RoomID"), "BedSlotID",
        F.col("MoveDate").alias("CheckInDate"), F.lit("Active").alias("Status"), "ContractDuration",
        "MonthlyRent", "DepositAmount",
    )
    # A stay made by one move may be ended by a later one.
    stays = t.room_assignment.unionByName(arrived, allowMissingColumns=True).join(ends, "AssignmentID", "left")
    ended = F.col("__end").isNotNull()
    stay_values = {
        "Status": F.when(ended, "Completed").otherwise(F.col("Status")),
        "ActualCheckOutDate": F.when(ended, F.coalesce("ActualCheckOutDate", "__end")).otherwise(F.col("ActualCheckOutDate")),
    }
    dates = done.select("TransferID", F.col("MoveDate").alias("__moved"))
    transfers = t.room_transfer.join(dates, "TransferID", "left")
    hit = F.col("__moved").isNotNull()
    transfer_values = {
        "Status": F.when(hit, "Completed").otherwise(F.col("Status")),
        "ApprovalDate": F.when(hit, F.coalesce("ApprovalDate", at.date)).otherwise(F.col("ApprovalDate")),
        "EffectiveMoveDate": F.coalesce("__moved", "EffectiveMoveDate"),
    }

    def rewritten(df: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
        return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in columns])

    notes = housing_notices(t, done, "TransferID", *MOVED_NOTICE, at)
    after = t.replacing(
        room_assignment=rewritten(stays, [c for c in stays.columns if c != "__end"], stay_values),
        room_transfer=rewritten(transfers, t.room_transfer.columns, transfer_values),
        notification=t.notification.unionByName(notes, allowMissingColumns=True),
    )
    return run_steps(after, HOUSING, at)[0]
