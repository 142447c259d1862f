"""Edge rows for the semantics that are easy to get wrong."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hallkeeper import Tables
from hallkeeper.functions import columns as col
from hallkeeper.operators import browse, changes, checks, facts, finance, queues, repairs, rules, snapshots, views
from hallkeeper.operators.repairs import Moment

DAY = dt.date(2024, 1, 15)
AT = Moment(DAY, dt.datetime(2024, 1, 15, 12))

ROOM = (
    "RoomID bigint, BuildingID int, RoomTypeID int, RoomNumber string, FloorNumber int, Capacity int, "
    "CurrentOccupancy int, Status string, FurnitureCondition string, LastInspectionDate date"
)
BED = "BedSlotID bigint, RoomID bigint, BedNumber string, IsOccupied boolean, IsReserved boolean, BedPosition string, BedType string"
STAY = (
    "AssignmentID bigint, StudentID string, RoomID bigint, BedSlotID bigint, ApplicationID bigint, CheckInDate date, "
    "CheckOutDate date, ActualCheckOutDate date, Status string, ContractDuration string"
)
INVOICE = (
    "InvoiceID bigint, StudentID string, TotalAmount decimal(10,2), TaxAmount decimal(10,2), "
    "DiscountAmount decimal(10,2), LateFee decimal(10,2), DueDate date, PaymentStatus string"
)
PAYMENT = "TransactionID bigint, InvoiceID bigint, StudentID string, PaymentAmount decimal(10,2), PaymentDate date, PaymentStatus string"
BUILDING = "BuildingID int, BuildingCode string, BuildingName string, Status string, GenderAllowed string, LastMaintenanceDate date"
ROOM_TYPE = "RoomTypeID int, Name string, BasePrice decimal(10,2), SecurityDeposit decimal(10,2)"


def invoice(number, status="Unpaid", total="100", due=DAY):
    zero = Decimal(0)
    return dict(
        InvoiceID=number, StudentID="s", TotalAmount=Decimal(total), TaxAmount=zero, DiscountAmount=zero, LateFee=zero,
        DueDate=due, PaymentStatus=status,
    )


def payment(number, amount, status="Completed"):
    return dict(TransactionID=number, InvoiceID=number, StudentID="s", PaymentAmount=Decimal(amount), PaymentStatus=status)


def test_invoice_branches_in_order(table):
    before, after = DAY - dt.timedelta(1), DAY + dt.timedelta(1)
    t = Tables(
        dict(
            invoice=table(
                INVOICE, invoice(1, "Cancelled"), invoice(2, due=before), invoice(3, due=after), invoice(4, due=after),
                invoice(5, due=before), invoice(6, due=DAY),
            ),
            payment_transaction=table(
                PAYMENT, payment(1, "100"), payment(2, "40"), payment(3, "40"), payment(4, "100"),
                payment(5, "99", "Pending"),
            ),
        )
    )
    got = {r.InvoiceID: r.DerivedStatus for r in finance.invoice_statuses(t, DAY).collect()}
    # A part-paid late invoice is overdue; due today is not late yet.
    assert got == {1: "Cancelled", 2: "Overdue", 3: "Partial", 4: "Paid", 5: "Overdue", 6: "Unpaid"}
    balances = {r.InvoiceID: (r.PaidAmount, r.BalanceDue) for r in finance.invoice_balances(t).collect()}
    assert balances[1] == (Decimal("100.00"), Decimal("0.00"))
    assert balances[2] == (Decimal("40.00"), Decimal("60.00"))
    assert balances[6] == (Decimal("0.00"), Decimal("100.00"))


def test_overpaid_balance_is_floored_at_zero(table):
    t = Tables(
        dict(invoice=table(INVOICE, invoice(1, "Partial")), payment_transaction=table(PAYMENT, payment(1, "250")))
    )
    assert finance.invoice_balances(t).first().BalanceDue == Decimal("0.00")


def test_null_status_is_not_a_violation(table):
    """``<>`` and NOT IN with null are unknown, so the row is not counted."""
    t = Tables(
        dict(
            room=table(ROOM, dict(RoomID=1, BuildingID=1, Capacity=1, CurrentOccupancy=None, Status=None)),
            room_assignment=table(STAY, dict(AssignmentID=1, StudentID="s", RoomID=1, Status="Active")),
            building=table(BUILDING, dict(BuildingID=1, Status=None)),
        )
    )
    assert checks.violations(t, "room_status_mismatch", DAY).count() == 0
    assert checks.violations(t, "active_assignment_in_unavailable_room", DAY).count() == 0
    # A null counter is zero, which differs from one resident.
    assert checks.violations(t, "occupancy_mismatch", DAY).count() == 1


def test_room_without_seats_is_available(table):
    t = Tables(
        dict(
            room=table(
                ROOM,
                dict(RoomID=1, Capacity=0, CurrentOccupancy=0, Status="Occupied"),
                dict(RoomID=2, Capacity=1, CurrentOccupancy=1, Status="Available"),
                dict(RoomID=3, Capacity=1, CurrentOccupancy=1, Status="Maintenance"),
            ),
            room_assignment=table(STAY, *[dict(AssignmentID=i, RoomID=i, Status="Active") for i in (2, 3)]),
        )
    )
    after = repairs.HOUSING[-1].run(t, AT)
    assert {r.RoomID: r.Status for r in after.tables["room"].collect()} == {1: "Available", 2: "Occupied", 3: "Maintenance"}


def test_portal_account_check_counts_joined_rows(table):
    users = "UserID bigint, RoleID int, StudentID string, Email string, FirstName string, LastName string, Status string"
    t = Tables(
        dict(
            student=table("StudentID string, Status string", *[dict(StudentID=s, Status="Active") for s in "abcd"]),
            role=table("RoleID int, RoleName string", dict(RoleID=1, RoleName="Former STUDENT"), dict(RoleID=2, RoleName="Staff")),
            system_user=table(
                users,
                dict(UserID=1, RoleID=1, StudentID="a", Status="Active"),
                dict(UserID=2, RoleID=2, StudentID="a", Status="Active"),  # student and staff: still one row
                dict(UserID=3, RoleID=2, StudentID="b", Status="Active"),
                dict(UserID=4, RoleID=2, StudentID="b", Status="Active"),  # two staff accounts: two rows
                dict(UserID=5, RoleID=1, StudentID="c", Status="Suspended"),  # not active: as if none
                dict(UserID=6, RoleID=1, StudentID="d", Status="Active"),
            ),
        )
    )
    rows = checks.violations(t, "active_students_without_portal_account", DAY).collect()
    assert {r.row_key: r.violations for r in rows} == {"a": 1, "b": 2, "c": 1}
    assert {r.StudentID for r in checks.students_without_any_student_account(t).collect()} == {"b", "c"}


def test_tied_inspections_fan_out_in_the_check_and_not_in_the_repair(table):
    inspection = "InspectionID bigint, RoomID bigint, InspectionDate date, Status string, FurnitureCondition string, FollowUpRequired boolean"
    rows = [dict(InspectionID=i, RoomID=1, InspectionDate=DAY, Status="Completed", FurnitureCondition=c) for i, c in ((1, "Good"), (2, "Poor"))]
    rows.append(dict(InspectionID=3, RoomID=1, InspectionDate=DAY + dt.timedelta(1), Status="Scheduled", FurnitureCondition="Fair"))
    t = Tables(
        dict(
            room=table(ROOM, dict(RoomID=1, FurnitureCondition="Good", LastInspectionDate=None)),
            room_inspection=table(inspection, *rows),
        )
    )
    assert checks.violations(t, "room_inspection_rollup_mismatch", DAY).first().violations == 2
    step = next(r for r in repairs.OPERATIONAL if r.step == "room_inspection_rollups")
    room = step.run(t, AT).tables["room"].first()
    assert (room.LastInspectionDate, room.FurnitureCondition) == (DAY, "Poor")


def listing_tables(table, *rooms, beds=()):
    return Tables(
        dict(
            room=table(ROOM, *rooms),
            bed_slot=table(BED, *beds),
            building=table(BUILDING, dict(BuildingID=1, BuildingName="B", Status="Active", GenderAllowed="Mixed")),
            room_type=table(ROOM_TYPE, dict(RoomTypeID=1, Name="T")),
        )
    )


def bed(number, room, occupied=False, reserved=False):
    return dict(BedSlotID=number, RoomID=room, BedNumber=str(number), IsOccupied=occupied, IsReserved=reserved)


def test_three_rules_for_a_free_room(table):
    def room(number, occupancy):
        return dict(RoomID=number, BuildingID=1, Capacity=2, CurrentOccupancy=occupancy, Status="Available", RoomNumber=str(number))

    t = listing_tables(
        table, room(1, 2), room(2, None), room(3, 1), room(4, 2),
        beds=[bed(10, 1), bed(30, 3, reserved=True)],
    )
    male = F.col("Gender") == "Male"
    ids = lambda df: sorted(r.RoomID for r in df.filter(male).collect())
    assert ids(queues.assignable_rooms(t)) == [2]  # at capacity or no free bed: out
    assert ids(queues.available_rooms(t)) == [1, 2]  # a free bed counts although the room is full
    assert ids(queues.transfer_destinations(t)) == [2]
    labels = {r.RoomID: (r.AvailableBeds, r.PortalLabel) for r in queues.room_catalog(t).filter(male).collect()}
    assert labels[3] == (1, "No free bed slot")  # a reserved bed counts as available
    assert labels[4] == (0, "Full")
    assert labels[1] == (1, "Can request")


def test_blacklist_rules_differ_on_the_last_day(table):
    blacklist = "BlacklistID bigint, StudentID string, StartDate date, EndDate date, Status string, AppealStatus string"
    rows = table(blacklist, dict(BlacklistID=1, StudentID="s", StartDate=DAY, EndDate=DAY, Status="Active"))
    t = Tables(dict(blacklist=rows, student=table("StudentID string, FirstName string, LastName string", dict(StudentID="s"))))
    assert views.active_blacklist(t, DAY).count() == 1  # ends today: still in force
    assert views.active_blacklist(t, DAY + dt.timedelta(1)).count() == 0
    assert snapshots.active_blacklist_entry(t).count() == 1  # looks at the status only


def test_visitor_dates_are_filled_before_expiry(table):
    schema = "PermissionID bigint, VisitorID bigint, StudentID string, RequestDate date, StartDate date, EndDate date, Status string, ApprovalDate date"
    t = Tables(dict(visitor_permission=table(schema, dict(PermissionID=1, EndDate=DAY - dt.timedelta(1), Status="Approved"))))
    steps = [r for r in repairs.OPERATIONAL if r.table == "visitor_permission"]
    after, log = repairs.run_steps(t, steps, AT)
    row = after.visitor_permission.first()
    assert (row.Status, row.ApprovalDate) == ("Expired", DAY)
    assert [r.step for r in log.collect()] == ["visitor_decisions", "expired_visitor_permissions"]


def test_occupancy_percent_rounds_half_to_even(spark):
    shown = [
        r[0]
        for r in spark.createDataFrame([(1, 8), (3, 8), (0, 0), (5, 4)], "a int, b int")
        .select(col.percent_text(F.col("a"), F.col("b")))
        .collect()
    ]
    assert shown == ["12%", "38%", "0%", "125%"]


def test_nonneg_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-3,), (2,)], "a int").select(col.nonneg(F.col("a"))).collect()
    assert [r[0] for r in rows] == [None, 0, 2]


def test_current_assignment_breaks_ties_by_id(table):
    t = Tables(
        dict(
            room_assignment=table(
                STAY,
                dict(AssignmentID=1, StudentID="s", CheckInDate=DAY, Status="Active"),
                dict(AssignmentID=2, StudentID="s", CheckInDate=DAY, Status="Active"),
                dict(AssignmentID=3, StudentID="s", CheckInDate=DAY + dt.timedelta(9), Status="Completed"),
            )
        )
    )
    assert facts.current_assignment(t).first().AssignmentID == 2


def test_pair_counts_without_pairs(table):
    """Transfers dated before a completed stay count once per such stay."""
    transfer = "TransferID bigint, StudentID string, FromRoomID bigint, EffectiveMoveDate date, Status string"
    stays = [dict(AssignmentID=i, StudentID="s", RoomID=1, CheckInDate=DAY + dt.timedelta(i), Status="Completed") for i in range(4)]
    t = Tables(
        dict(
            room_transfer=table(transfer, *[
                dict(TransferID=i, StudentID="s", FromRoomID=1, EffectiveMoveDate=DAY + dt.timedelta(i), Status="Completed")
                for i in (-1, 1, 3)
            ]),
            room_assignment=table(STAY, *stays),
        )
    )
    rows = checks.violations(t, "transfer_move_before_source_checkin", DAY).collect()
    assert {r.row_key: r.violations for r in rows} == {"-1": 4, "1": 2}


def test_a_student_role_is_made_when_none_fits(table):
    role = "RoleID int, RoleName string"
    staff = Tables(dict(role=table(role, dict(RoleID=4, RoleName="Staff"))))
    assert [tuple(r) for r in rules.student_role(staff).collect()] == [(5, "Student Resident")]
    some = Tables(dict(role=table(role, dict(RoleID=1, RoleName="Ex-student"), dict(RoleID=9, RoleName="STUDENT"))))
    assert [tuple(r) for r in rules.student_role(some).collect()] == [(9, "STUDENT")]


def test_labels_and_names(table):
    t = Tables(
        dict(
            building=table(BUILDING, dict(BuildingID=1, BuildingName="North", BuildingCode="", Status="Active")),
            role=table("RoleID int, RoleName string", dict(RoleID=7, RoleName=None)),
        )
    )
    assert browse.row_labels(t, "building").first().label == "North / Active"
    assert browse.row_labels(t, "role").first().label == "7"


@pytest.mark.parametrize(
    ("name", "words"), [("RoomType", "Room Type"), ("StudentID", "Student ID"), ("HomeZIP", "Home ZIP"), ("a_b", "a b")]
)
def test_humanized_names(spark, name, words):
    assert spark.range(1).select(col.humanized(F.lit(name))).first()[0] == words


def test_enum_literals(spark):
    rows = [("enum('a','it''s')",), ("varchar(3)",), ("ENUM('x')",)]
    got = spark.createDataFrame(rows, "t string").select(col.enum_literals(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "it's"], [], ["x"]]


def test_changed_fields_need_an_update(spark, table):
    rows = [
        ("penalty", "update", "1", {"Amount": "5", "StudentID": "s"}, {"Amount": "6", "StudentID": "s"}),
        ("penalty", "update", "2", {"Amount": "5", "StudentID": "s"}, {"Amount": "5", "StudentID": "s"}),
        ("penalty", "insert", "3", None, {"Amount": None, "Type": "Noise", "StudentID": "s"}),
        ("complaint", "update", "4", {"Status": "Open", "StudentID": "s"}, {"Status": "Resolved", "StudentID": "s"}),
        ("incident_report", "insert", "5", None, {"Title": "T", "SeverityLevel": "Critical", "StudentID": None}),
    ]
    batch = spark.createDataFrame(rows, changes.CHANGE_SCHEMA)
    titles = {r.row_key: r.Title for r in changes.matched_notices(batch).collect()}
    assert titles == {"1": "Penalty updated", "3": "Penalty added", "5": "Incident report linked"}
    with_triggers = changes.matched_notices(batch, include_trigger_rules=True)
    assert "4" in {r.row_key for r in with_triggers.collect()}
    message = changes.matched_notices(batch).filter("row_key = '3'").first().Message
    assert message == "A Noise record of EGP 0 was added to your student record."


def test_typed_import_rules(spark):
    rows = [(1, "x", "1.5", "2020-02-30", "2020-01-01T05:00:00", "1900", "Paid"), (2, "7", "", "2020-01-31", None, "1901", "paid")]
    names = "LineNo int, InvoiceID string, TotalAmount string, DueDate string, CreatedAt string, AcademicYear string, PaymentStatus string"
    raw = spark.createDataFrame(rows, names)
    got = {(r.row_key, r.column_name): r.rule for r in rules.import_rules(raw, "invoice", "LineNo").collect()}
    assert got == {
        ("1", "InvoiceID"): "not_typed",
        ("1", "DueDate"): "not_typed",
        ("1", "AcademicYear"): "not_typed",
        ("2", "TotalAmount"): "required",
        ("2", "PaymentStatus"): "value_not_allowed",
    }


def test_one_students_notifications_are_in_order(small):
    from hallkeeper.sources.testdata import NOW

    every = queues.active_notifications(small, NOW)
    student = every.groupBy("StudentID").count().orderBy("count", ascending=False).first().StudentID
    own = queues.notifications_of(small, NOW, student).collect()
    assert len(own) == every.filter(every.StudentID == student).count() > 1
    assert own == sorted(own, key=lambda r: (r.PublishDate, r.NotificationID), reverse=True)


def test_typed_rows_give_the_notices_of_their_text(small, capsys):
    """Null, missing and changed fields alike; no text is made of whole rows."""
    from hallkeeper.plans.registry import AT
    from hallkeeper.plans.sample_changes import sample_changes, sample_rows

    typed, text = sample_rows(small, AT), sample_changes(small, AT)
    found = changes.notifications_for(typed, small)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(found) == rows(changes.notifications_for(text, small))
    found.explain()
    assert "map(" not in capsys.readouterr().out
    for name in ("penalty", "complaint", "blacklist"):
        gone = changes.snapshot_rows(name, small[name], small[name].filter("false"))
        assert changes.matched_notices({name: gone}).isEmpty()
