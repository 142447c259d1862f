"""Incoming assignments against a plain loop that saves them one after the other."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hallkeeper.operators import candidates

ROW = "LineNo bigint, AssignmentID bigint, StudentID string, RoomID bigint, BedSlotID bigint, ApplicationID bigint, Status string"


def serve(rows, stays, rooms, beds, applicants):
    """rooms: id -> (capacity, status, building ok, occupancy); beds: id -> (room, occupied, reserved)."""
    edited, people, taken_seats, taken_beds, out = set(), set(), Counter(), set(), {}
    active = {k: s for k, s in stays.items() if s[3] == "Active"}

    def rule(line, key, student, room, bed, application, status):
        old = stays.get(key)
        was = old is not None and old[3] == "Active"
        if status == "Active":
            if any(s[0] == student for k, s in active.items() if k != key):
                return "other_active_assignment"
            if room not in rooms:
                return "room_not_found"
            capacity, state, good, occupancy = rooms[room]
            if not good:
                return "building_not_active"
            if state not in ("Available", "Occupied"):
                return "room_not_assignable"
            stays_put = was and old[1] == room
            if max(occupancy - stays_put, 0) >= capacity:
                return "room_full"
            if application in applicants and applicants[application] != student:
                return "application_student"
            own = bed is not None and old is not None and old[2] == bed
            slots = {b: x for b, x in beds.items() if x[0] == room}
            free = sum(not x[1] and not x[2] for x in slots.values())
            if bed is not None:
                if bed not in beds:
                    return "bed_missing"
                if beds[bed][0] != room:
                    return "bed_in_other_room"
                if (beds[bed][1] and not own) or beds[bed][2]:
                    return "bed_not_available"
            elif slots and not free:
                return "no_free_bed"
        if key in edited:
            return "row_edited_in_batch"
        if status == "Active":
            if student in people:
                return "other_active_assignment"
            if not stays_put and taken_seats[room] >= capacity - occupancy:
                return "room_full"
            if bed is not None and not own and bed in taken_beds:
                return "bed_not_available"
            if not stays_put and bed is None and slots and taken_seats[room] >= free:
                return "no_free_bed"
            people.add(student)
            if not stays_put:
                taken_seats[room] += 1
            if bed is not None and not own:
                taken_beds.add(bed)
        edited.add(key)
        return None

    for row in sorted(rows, key=lambda r: (r[4] is None, r[0])):
        out[row[0]] = rule(*row)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_saving_one_after_the_other(spark, small, seed):
    deal = random.Random(seed)
    n = 30
    capacity = {r: deal.randint(1, 4) for r in range(n)}
    building = {r: int(deal.random() < 0.1) for r in range(n)}
    state = {r: "Closed" if deal.random() < 0.1 else "Available" for r in range(n)}
    beds = {r * 10 + i: [r, False, deal.random() < 0.15] for r in range(n) for i in range(deal.choice([0, 2, 3, 4]))}
    stays = {}
    for k in range(70):
        room = deal.randrange(n)
        free = [b for b, x in beds.items() if x[0] == room and not x[1] and not x[2]]
        status = "Active" if deal.random() < 0.6 else "Completed"
        bed = free[0] if free and status == "Active" else None
        if bed is not None:
            beds[bed][1] = True
        stays[k] = (f"s{k}", room, bed, status)
    occupancy = Counter(s[1] for s in stays.values() if s[3] == "Active")
    applicants = {i: f"s{deal.randrange(150)}" for i in range(40)}
    rows = []
    for line in range(400):
        key = deal.randrange(70) if deal.random() < 0.4 else deal.randrange(1000, 1300)
        old = stays.get(key)
        student = old[0] if old and deal.random() < 0.8 else f"s{deal.randrange(60, 400)}"
        room = old[1] if old and deal.random() < 0.5 else deal.choice([*range(n), 99])
        bed = old[2] if old and deal.random() < 0.4 else deal.choice([None, room * 10, room * 10 + 1, room * 10 + 1, 7])
        application = deal.choice([None, None, *range(40)]) if deal.random() < 0.3 else None
        rows.append((line, key, student, room, bed, application, deal.choice(["Active"] * 5 + ["Pending"])))
    room_rows = [(r, capacity[r], occupancy[r], building[r] + 1, state[r]) for r in range(n)]
    t = small.replacing(
        room=small.room.limit(1).drop("RoomID", "Capacity", "CurrentOccupancy", "BuildingID", "Status").crossJoin(
            spark.createDataFrame(room_rows, "RoomID bigint, Capacity int, CurrentOccupancy int, BuildingID int, Status string")
        ),
        building=small.building.limit(1).drop("BuildingID", "Status").crossJoin(
            spark.createDataFrame([(1, "Active"), (2, "Closed")], "BuildingID int, Status string")
        ),
        bed_slot=spark.createDataFrame(
            [(b, x[0], str(b), x[1], x[2]) for b, x in beds.items()],
            "BedSlotID bigint, RoomID bigint, BedNumber string, IsOccupied boolean, IsReserved boolean",
        ),
        room_assignment=spark.createDataFrame(
            [(k, *s, dt.date(2024, 1, 1)) for k, s in stays.items()],
            "AssignmentID bigint, StudentID string, RoomID bigint, BedSlotID bigint, Status string, CheckInDate date",
        ),
        registration=spark.createDataFrame(list(applicants.items()), "ApplicationID bigint, StudentID string"),
        assignment_candidate=spark.createDataFrame(rows, ROW),
    )
    found = {r.LineNo: r.rule for r in candidates.assignment_candidates(t).collect()}
    rooms = {r: (capacity[r], state[r], building[r] == 0, occupancy[r]) for r in range(n)}
    want = serve(rows, stays, rooms, beds, applicants)
    assert found == want
    assert len(set(want.values())) >= 9


def test_no_candidates(small):
    t = small.replacing(assignment_candidate=small.assignment_candidate.filter(F.lit(False)))
    assert candidates.assignment_candidates(t).collect() == []


def test_rows_without_bed_or_application_are_dealt_to_all_tasks(spark, small):
    wide = candidates._with_stored(small, small.assignment_candidate)
    joins = [line for line in wide._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in line]
    for key in ("BedSlotID", "ApplicationID"):
        assert any(f"{key}#" in line and "__spread" in line for line in joins)
