"""Batch allocation against one-by-one loops in plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hallkeeper.functions import ranking
from hallkeeper.operators import allocation, checks, moves, queues, repairs
from hallkeeper.operators.repairs import Moment
from hallkeeper.plans import reconcile
from hallkeeper.session import cut_lineage
from hallkeeper.sources.testdata import AS_OF, NOW

AT = Moment(AS_OF, NOW)
ROOM_OK = ("Available", "Occupied")


@pytest.fixture(scope="module")
def housed(spark, small):
    """The smallest test data after housing repairs."""
    tables = reconcile.reconcile_housing(small, AT).tables
    names = ("room", "bed_slot", "room_assignment", "occupancy_log")
    return tables.replacing(**{name: cut_lineage(tables[name]) for name in names})


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


def serve_decisions(t):
    """Approve decisions one after the other: {ApplicationID: (bed, reason)}."""
    applications, people = rows_by(t.registration, "ApplicationID"), rows_by(t.student, "StudentID")
    rooms, buildings = rows_by(t.room, "RoomID"), rows_by(t.building, "BuildingID")
    beds_of, free = defaultdict(list), {}
    for b in t.bed_slot.collect():
        beds_of[b.RoomID].append(b)
        free[b.BedSlotID] = not b.IsOccupied and not b.IsReserved
    holders = {r.StudentID for r in t.room_assignment.filter("Status = 'Active'").collect()}
    seats = {r.RoomID: r.Capacity - (r.CurrentOccupancy or 0) for r in rooms.values()}
    room_of_bed = {b.BedSlotID: b.RoomID for beds in beds_of.values() for b in beds}
    batch = set()

    def place(decision):
        application = applications.get(decision.ApplicationID)
        person = people.get(application.StudentID) if application else None
        if person is None:
            return None, "application_not_found"
        if person.Status != "Active":
            return None, "student_not_active"
        if application.Status not in ("Pending", "Waitlisted", "Approved"):
            return None, "application_decided"
        if person.StudentID in holders:
            return None, "already_assigned"
        room = rooms.get(decision.RoomID)
        if room is None:
            return None, "room_not_found"
        building = buildings[room.BuildingID]
        if building.Status != "Active":
            return None, "building_not_active"
        if room.Status not in ROOM_OK:
            return None, "room_not_assignable"
        if (room.CurrentOccupancy or 0) >= room.Capacity:
            return None, "room_full"
        if building.GenderAllowed not in ("Mixed", person.Gender):
            return None, "gender_not_admitted"
        bed = decision.BedSlotID
        stored = [b for b in beds_of[room.RoomID] if not b.IsOccupied and not b.IsReserved]
        if bed is not None:
            if room_of_bed.get(bed) != room.RoomID:
                return None, "bed_in_other_room"
            if bed not in {b.BedSlotID for b in stored}:
                return None, "bed_not_available"
        elif beds_of[room.RoomID] and not stored:
            return None, "no_free_bed"
        # What earlier decisions of the batch took.
        if person.StudentID in batch:
            return None, "already_assigned_in_batch"
        if seats[room.RoomID] < 1:
            return None, "room_full"
        if bed is not None and not free[bed]:
            return None, "bed_not_available"
        if bed is None and beds_of[room.RoomID]:
            left = sorted((b.BedNumber, b.BedSlotID) for b in stored if free[b.BedSlotID])
            if not left:
                return None, "no_free_bed"
            bed = left[0][1]
        batch.add(person.StudentID)
        seats[room.RoomID] -= 1
        if bed is not None:
            free[bed] = False
        return bed, None

    def order(decision):
        a = applications.get(decision.ApplicationID)
        rank = {"Pending": 1, "Waitlisted": 2}.get(a.Status, 3)
        return (decision.BedSlotID is None, rank, a.Priority, a.ApplicationDate, a.ApplicationID)

    return {d.ApplicationID: place(d) for d in sorted(t.housing_decision.collect(), key=order)}


def crowded_decisions(spark, t):
    """Decisions that fight for few rooms: a third of them name the same one."""
    rng = random.Random(4)
    held = {r.StudentID for r in t.room_assignment.filter("Status = 'Active'").collect()}
    open_rooms = [r.RoomID for r in queues.assignable_rooms(t).filter("Gender = 'Male'").select("RoomID").distinct().collect()]
    beds = defaultdict(list)
    for b in t.bed_slot.filter("NOT IsOccupied AND NOT IsReserved").collect():
        beds[b.RoomID].append(b.BedSlotID)
    waiting = [a for a in t.registration.filter("Status IN ('Pending', 'Waitlisted')").collect()]
    rows = []
    for i, a in enumerate(waiting):
        room = open_rooms[0] if i % 3 == 0 else rng.choice(open_rooms[:25])
        bed = rng.choice(beds[room]) if beds[room] and rng.random() < 0.4 else None
        rows.append((a.ApplicationID, room, bed, None))
    free_students = [s.StudentID for s in t.student.filter("Status = 'Active'").collect() if s.StudentID not in held]
    assert rows
    return spark.createDataFrame(rows, "ApplicationID bigint, RoomID bigint, BedSlotID bigint, CheckInDate date"), free_students


@pytest.fixture(scope="module", params=["given", "crowded"])
def decided(request, spark, housed):
    t = housed
    if request.param == "crowded":
        # End most stays, so that applicants and rooms are free.
        ended = F.when(F.col("AssignmentID") % 10 != 0, "Completed").otherwise(F.col("Status"))
        t = t.replacing(room_assignment=t.room_assignment.withColumn("Status", ended))
        t = reconcile.reconcile_housing(t, AT).tables
        t = t.replacing(**{n: cut_lineage(t[n]) for n in ("room", "bed_slot", "room_assignment", "occupancy_log")})
        decisions, _ = crowded_decisions(spark, t)
        t = t.replacing(housing_decision=decisions)
    outcomes = cut_lineage(allocation.approvals(t, AT))
    return t, outcomes


def test_approvals_equal_one_by_one_service(decided):
    t, outcomes = decided
    got = {r.ApplicationID: (r.BedSlotID, r.Reason) for r in outcomes.collect()}
    want = serve_decisions(t)
    assert got == want


def test_approvals_keep_the_rules(decided):
    t, outcomes = decided
    accepted = outcomes.filter("Reason IS NULL")
    assert accepted.count() == accepted.select("StudentID").distinct().count()
    beds = [r.BedSlotID for r in accepted.collect() if r.BedSlotID is not None]
    assert len(beds) == len(set(beds))
    before = Counter(r.row_key for r in checks.violations(t, "active_room_over_capacity", AS_OF).collect())
    after = allocation.apply_approvals(t, outcomes, AT)
    over = Counter(r.row_key for r in checks.violations(after, "active_room_over_capacity", AS_OF).collect())
    assert over == before
    added = after.room_assignment.count() - t.room_assignment.count()
    assert added == accepted.count()
    for name in ("occupancy_mismatch", "bed_occupancy_mismatch", "missing_occupancy_logs"):
        assert checks.violations(after, name, AS_OF).count() == 0


def simulate_moves(t):
    """The documented rounds in plain Python: {TransferID: (round, bed)} and refusals."""
    people, rooms = rows_by(t.student, "StudentID"), rows_by(t.room, "RoomID")
    buildings = rows_by(t.building, "BuildingID")
    beds_of = defaultdict(list)
    for b in t.bed_slot.collect():
        beds_of[b.RoomID].append((b.BedNumber, b.BedSlotID, b.IsReserved))
    stays = {
        r.AssignmentID: dict(student=r.StudentID, room=r.RoomID, bed=r.BedSlotID, day=r.CheckInDate)
        for r in t.room_assignment.filter("Status = 'Active'").collect()
    }
    base = max(r.AssignmentID for r in t.room_assignment.select("AssignmentID").collect())
    due = [r.TransferID for r in queues.due_transfers(t, AS_OF).collect()]
    transfers = rows_by(t.room_transfer, "TransferID")
    pending = [transfers[i] for i in due if transfers[i].StudentID in people]
    touched = {r for x in pending for r in (x.FromRoomID, x.ToRoomID)}

    def order(x):
        return (x.ApprovalDate or dt.date.min, x.TransferID)

    def open_beds(room):
        used = {s["bed"] for s in stays.values()}
        return sorted((n, i) for n, i, reserved in beds_of[room] if i not in used and not reserved)

    def seat_waiting():
        for room in touched:
            waiting = sorted((s["day"], k) for k, s in stays.items() if s["room"] == room and s["bed"] is None)
            for (_, key), (_, bed) in zip(waiting, open_beds(room)):
                stays[key]["bed"] = bed

    seat_waiting()
    done, number = {}, 0
    while True:
        number += 1
        eligible, refused = [], {}
        for x in sorted(pending, key=order):
            sources = [(s["day"], k) for k, s in stays.items() if s["student"] == x.StudentID and s["room"] == x.FromRoomID]
            room = rooms.get(x.ToRoomID)
            residents = sum(s["room"] == x.ToRoomID for s in stays.values())
            building = buildings[room.BuildingID] if room else None
            reason = None
            if not sources:
                reason = "no_active_source"
            elif room is None:
                reason = "room_not_found"
            elif building.Status != "Active":
                reason = "building_not_active"
            elif room.Status not in ROOM_OK:
                reason = "room_not_assignable"
            elif residents >= room.Capacity:
                reason = "room_full"
            elif building.GenderAllowed not in ("Mixed", people[x.StudentID].Gender):
                reason = "gender_not_admitted"
            elif beds_of[x.ToRoomID] and not open_beds(x.ToRoomID):
                reason = "no_free_bed"
            if reason:
                refused[x.TransferID] = reason
            else:
                eligible.append((x, sorted(sources, reverse=True), room.Capacity - residents))
        first, used = [], Counter()
        for x, sources, seats in eligible:
            number_there = used[x.StudentID, x.FromRoomID]
            used[x.StudentID, x.FromRoomID] += 1
            if number_there < len(sources):
                first.append((x, sources[number_there], seats))
        admitted, taken, snapshot = [], Counter(), {}
        for x, source, seats in first:
            beds = snapshot.setdefault(x.ToRoomID, open_beds(x.ToRoomID))
            limit = min(seats, len(beds)) if beds_of[x.ToRoomID] else seats
            if taken[x.ToRoomID] < limit:
                bed = beds[taken[x.ToRoomID]][1] if beds_of[x.ToRoomID] else None
                taken[x.ToRoomID] += 1
                admitted.append((x, source, bed))
        if not admitted:
            return done, refused
        for x, (day, key), bed in admitted:
            del stays[key]
            moved = max(x.EffectiveMoveDate or AS_OF, day)
            stays[base + 1 + x.TransferID] = dict(student=x.StudentID, room=x.ToRoomID, bed=bed, day=moved)
            done[x.TransferID] = (number, bed, moved)
        seat_waiting()
        gone = {x.TransferID for x, _, _ in admitted}
        pending = [x for x in pending if x.TransferID not in gone]


def roomier(t):
    """Raise capacities, so that many transfers go through over several rounds."""
    room = t.room.withColumn("Capacity", (F.col("Capacity") + F.col("RoomID") % 3).cast("int"))
    return t.replacing(room=room)


def one_student(t):
    """A third of the stays and transfers belong to one student, who also moves twice out of some rooms."""
    t = roomier(t)

    def hot(column):
        return F.when(F.col(column) % 3 == 0, "7").otherwise(F.col("StudentID"))

    return t.replacing(
        room_assignment=t.room_assignment.withColumn("StudentID", hot("RoomID")),
        room_transfer=t.room_transfer.withColumn("StudentID", hot("FromRoomID")),
    )


@pytest.mark.parametrize("change", [lambda t: t, roomier, one_student], ids=["given", "roomier", "one_student"])
def test_moves_equal_the_documented_rounds(housed, change):
    t = change(housed)
    t = t.replacing(room_assignment=cut_lineage(t.room_assignment))
    found = moves.complete_due(t, AT)
    done = {r.TransferID: (r.Round, r.BedSlotID, r.MoveDate) for r in found.done.collect()}
    refused = {r.TransferID: r.Reason for r in found.refused.collect()}
    assert (done, refused) == simulate_moves(t)


def test_moves_are_applied(housed):
    t = roomier(housed)
    found = moves.complete_due(t, AT)
    done = found.done.collect()
    assert done
    after = moves.apply_moves(t, found, AT)
    before = {r.row_key for r in checks.violations(t, "active_room_over_capacity", AS_OF).collect()}
    over = {r.row_key for r in checks.violations(after, "active_room_over_capacity", AS_OF).collect()}
    assert over <= before
    stays = rows_by(after.room_assignment, "AssignmentID")
    ended = {m.OldAssignmentID for m in done}
    for m in done:
        assert stays[m.OldAssignmentID].Status == "Completed"
        assert stays[m.OldAssignmentID].ActualCheckOutDate is not None
        new = stays[m.NewAssignmentID]
        assert (new.StudentID, new.RoomID) == (m.StudentID, m.ToRoomID)
        assert new.Status == ("Completed" if m.NewAssignmentID in ended else "Active")
    transfers = rows_by(after.room_transfer, "TransferID")
    assert all(transfers[m.TransferID].Status == "Completed" for m in done)
    for name in ("occupancy_mismatch", "bed_occupancy_mismatch", "missing_occupancy_logs"):
        assert checks.violations(after, name, AS_OF).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_bed_fills_equal_a_sequential_loop(spark, small, monkeypatch, seed):
    monkeypatch.setattr(ranking, "ID_BITS", 3)
    rng = random.Random(seed)
    beds, stays = [], []
    for room in range(200):
        for n in range(rng.randrange(6)):
            beds.append((room * 10 + n, room, str(rng.randrange(12)), rng.random() < 0.3, rng.random() < 0.2))
        for _ in range(rng.randrange(6)):
            stays.append((len(stays), f"s{len(stays)}", room, None, dt.date(2024, 1, rng.randrange(1, 4)), "Active"))
    t = small.replacing(
        bed_slot=spark.createDataFrame(beds, "BedSlotID bigint, RoomID bigint, BedNumber string, IsOccupied boolean, IsReserved boolean"),
        room_assignment=spark.createDataFrame(
            stays, "AssignmentID bigint, StudentID string, RoomID bigint, BedSlotID bigint, CheckInDate date, Status string"
        ),
    )
    want, taken = {}, {b[0] for b in beds if b[3]}
    for stay in sorted(stays, key=lambda s: (s[2], s[4], s[0])):
        left = sorted((b[2], b[0]) for b in beds if b[1] == stay[2] and b[0] not in taken and not b[4])
        if left:
            want[stay[0]] = left[0][1]
            taken.add(left[0][1])
    assert {r.AssignmentID: r.BedSlotID for r in repairs.bed_fills(t).collect()} == want


def test_second_pipeline_run_changes_nothing(small):
    once = reconcile.reconcile_after(small, {"room_assignment", "invoice"}, AT, make_moves=False)
    again = reconcile.reconcile_housing(once, AT).changes.unionByName(reconcile.reconcile_operational(once, AT).changes)
    assert again.collect() == []


def test_whole_operational_run_makes_the_due_moves(small):
    after = reconcile.reconcile_after(small, {"room_transfer"}, AT)
    due = {r.TransferID for r in queues.due_transfers(small, AT.as_of).collect()}
    left = {r.TransferID for r in queues.due_transfers(after, AT.as_of).collect()}
    assert left < due
    completed = after.room_transfer.filter("Status = 'Completed'").select("TransferID")
    assert {r.TransferID for r in completed.collect()} >= due - left
    for name in ("occupancy_mismatch", "invoice_status_mismatch", "pending_penalties_past_due"):
        assert checks.violations(after, name, AS_OF).count() == 0


def test_new_accounts_are_unique_and_clean(spark, small):
    rows = [
        (i, sid, mail, "Student", "X", dt.date(2000, 1, 1), "Male", nid, 0, 0)
        for i, (sid, mail, nid) in enumerate(
            [("x1", "a@x", "p1"), ("x1", "b@x", None), ("x2", "b@x", "p1"), ("x3", "b@x", "p2"), ("x4", "A@x ", None), ("x 5", "c@x", None)]
        )
    ]
    schema = (
        "CandidateID bigint, StudentID string, Email string, FirstName string, LastName string, DateOfBirth date, "
        "Gender string, NationalIDOrPassport string, FacultyID int, ProgramID int"
    )
    accounts = allocation.new_accounts(small.replacing(portal_candidate=spark.createDataFrame(rows, schema)))
    # x1 comes first; its second try, x2 (national id taken) and x4 (email taken) lose; x3 gets b@x.
    assert {(r.StudentID, r.Email) for r in accounts.users.collect()} == {("x1", "a@x"), ("x3", "b@x")}
    assert {r.StudentID for r in accounts.students.collect()} == {"x1", "x3"}


def test_later_rounds_judge_only_what_has_changed(spark, small):
    """A chain of five moves next to a hundred transfers into rooms that stay full."""
    rooms = [*range(6), *range(100, 200), *range(200, 300)]
    pairs = [(i, i + 1) for i in range(5)] + [(100 + i, 200 + i) for i in range(100)]
    stays = [(r, f"s{r}", r, None, dt.date(2024, 1, 1), "Active", "Year") for r in rooms if r != 5]
    asked = [(a, f"s{a}", a, b, "Approved", dt.date(1998, 1, 1), None) for a, b in pairs]
    t = small.replacing(
        student=spark.createDataFrame([(f"s{r}", "Female") for r in rooms], "StudentID string, Gender string"),
        room=small.room.limit(1).drop("RoomID", "Capacity", "CurrentOccupancy", "BuildingID", "Status").crossJoin(
            spark.createDataFrame(
                [(r, 1, int(r != 5), 1, "Available") for r in rooms],
                "RoomID bigint, Capacity int, CurrentOccupancy int, BuildingID int, Status string",
            )
        ),
        building=small.building.limit(1).withColumns(
            {"BuildingID": F.lit(1), "Status": F.lit("Active"), "GenderAllowed": F.lit("Mixed")}
        ),
        bed_slot=small.bed_slot.limit(0),
        room_assignment=spark.createDataFrame(
            stays,
            "AssignmentID bigint, StudentID string, RoomID bigint, BedSlotID bigint, CheckInDate date, Status string, ContractDuration string",
        ),
        room_transfer=spark.createDataFrame(
            asked,
            "TransferID bigint, StudentID string, FromRoomID bigint, ToRoomID bigint, Status string, ApprovalDate date, EffectiveMoveDate date",
        ),
    )
    found = moves.complete_due(t, AT)
    assert {r.TransferID: r.Round for r in found.done.collect()} == {4: 1, 3: 2, 2: 3, 1: 4, 0: 5}
    assert {r.Reason for r in found.refused.collect()} == {"room_full"}
    assert found.judged == (105, 1, 1, 1, 1)


def test_moves_send_no_growing_side_to_the_driver(housed, capsys):
    """Each round joins by shuffles, however small its tables are."""
    found = moves.complete_due(roomier(housed), AT)
    assert found.done.count()
    found.refused.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan
