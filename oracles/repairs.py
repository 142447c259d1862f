"""Oracle SQL for repairs: change logs, counts and repaired tables."""

from __future__ import annotations

import re

from oracles.checks import PAID

AS_OF = "DATE '1998-06-30'"
NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def log(step: str, table: str, key: str, column: str, body: str) -> str:
    """``body`` gives k, old and new of the rows looked at."""
    return f"""SELECT '{step}' AS step, '{table}' AS table_name, CAST(k AS VARCHAR) AS row_key, '{column}' AS column_name,
        CAST(old AS VARCHAR) AS old_value, CAST(new AS VARCHAR) AS new_value
        FROM ({body}) z WHERE old IS DISTINCT FROM new"""


# The housing pipeline as a chain: each name is the state after its step.
CHAIN = f"""
    h1_new AS (SELECT (SELECT max(LogID) FROM occupancy_log) + row_number() OVER (ORDER BY a.AssignmentID) AS LogID,
        a.StudentID, a.RoomID, a.AssignmentID, a.CheckInDate AS StartDate, CAST(NULL AS DATE) AS EndDate
      FROM room_assignment a WHERE a.Status = 'Active'
        AND a.AssignmentID NOT IN (SELECT AssignmentID FROM occupancy_log)),
    h1 AS (SELECT * FROM occupancy_log UNION ALL SELECT * FROM h1_new),
    h2 AS (SELECT l.* EXCLUDE (EndDate), CASE WHEN l.EndDate IS NULL AND a.Status <> 'Active'
        THEN coalesce(a.ActualCheckOutDate, a.CheckOutDate, {AS_OF}) ELSE l.EndDate END AS EndDate, l.EndDate AS old
      FROM h1 l LEFT JOIN room_assignment a USING (AssignmentID)),
    h3 AS (SELECT b.* EXCLUDE (IsOccupied), b.BedSlotID IN (SELECT BedSlotID FROM room_assignment
        WHERE Status = 'Active' AND BedSlotID IS NOT NULL) AS IsOccupied, b.IsOccupied AS old FROM bed_slot b),
    free AS (SELECT RoomID, BedSlotID, row_number() OVER (PARTITION BY RoomID ORDER BY BedNumber, BedSlotID) AS n
      FROM h3 WHERE NOT IsOccupied AND NOT IsReserved),
    waiting AS (SELECT RoomID, AssignmentID,
        row_number() OVER (PARTITION BY RoomID ORDER BY CheckInDate, AssignmentID) AS n
      FROM room_assignment WHERE Status = 'Active' AND BedSlotID IS NULL),
    fills AS (SELECT AssignmentID, BedSlotID FROM waiting JOIN free USING (RoomID, n)),
    counted AS (SELECT r.*, coalesce(a.c, 0) AS c, CASE WHEN coalesce(a.c, 0) >= r.Capacity AND r.Capacity > 0
        THEN 'Occupied' ELSE 'Available' END AS derived
      FROM room r LEFT JOIN (SELECT RoomID, count(*) AS c FROM room_assignment WHERE Status = 'Active' GROUP BY 1) a
        USING (RoomID))
"""

HOUSING = {
    "inserted_logs": log(
        "inserted_logs", "occupancy_log", "LogID", "AssignmentID",
        "SELECT LogID AS k, CAST(NULL AS BIGINT) AS old, AssignmentID AS new FROM h1_new",
    ),
    "closed_logs": log("closed_logs", "occupancy_log", "LogID", "EndDate", "SELECT LogID AS k, old, EndDate AS new FROM h2"),
    "updated_beds": log(
        "updated_beds", "bed_slot", "BedSlotID", "IsOccupied", "SELECT BedSlotID AS k, old, IsOccupied AS new FROM h3"
    ),
    "assigned_missing_beds": log(
        "assigned_missing_beds", "room_assignment", "AssignmentID", "BedSlotID",
        "SELECT AssignmentID AS k, CAST(NULL AS BIGINT) AS old, BedSlotID AS new FROM fills",
    )
    + " UNION ALL "
    + log(
        "assigned_missing_beds", "bed_slot", "BedSlotID", "IsOccupied",
        "SELECT BedSlotID AS k, false AS old, true AS new FROM fills",
    ),
    "updated_rooms": log(
        "updated_room_occupancy", "room", "RoomID", "CurrentOccupancy",
        "SELECT RoomID AS k, coalesce(CurrentOccupancy, CASE WHEN c = 0 THEN 0 END) AS old, c AS new FROM counted",
    )
    + " UNION ALL "
    + log(
        "updated_room_status", "room", "RoomID", "Status",
        "SELECT RoomID AS k, Status AS old, derived AS new FROM counted WHERE Status IN ('Available', 'Occupied')",
    ),
}


def fill(step: str, table: str, key: str, column: str, statuses: str, value: str) -> str:
    return log(
        step, table, key, column,
        f"SELECT {key} AS k, {column} AS old, coalesce({column}, {value}) AS new FROM {table} WHERE Status IN ({statuses})",
    )


def expire(step: str, table: str, key: str, column: str, before: str, after: str) -> str:
    return log(
        step, table, key, "Status",
        f"SELECT {key} AS k, Status AS old, '{after}' AS new FROM {table} WHERE Status = '{before}' AND {column} < {AS_OF}",
    )


MOVES = """(SELECT x.TransferID, any_value(x.StudentID) AS StudentID, any_value(x.ToRoomID) AS ToRoomID,
      any_value(x.EffectiveMoveDate) AS old, max(a.CheckInDate) AS new
    FROM room_transfer x JOIN room_assignment a
      ON a.StudentID = x.StudentID AND a.RoomID = x.FromRoomID AND a.Status = 'Completed'
    WHERE x.Status = 'Completed' AND x.EffectiveMoveDate < a.CheckInDate GROUP BY x.TransferID)"""

DONE = "'Resolved', 'Closed'"
OPERATIONAL = {
    "maintenance_timestamps": fill("maintenance_timestamps", "maintenance_request", "RequestID", "ResolvedAt", DONE, NOW),
    "complaint_timestamps": fill("complaint_timestamps", "complaint", "ComplaintID", "ClosedAt", DONE, NOW),
    "incident_timestamps": fill("incident_timestamps", "incident_report", "ReportID", "ResolvedAt", DONE, NOW),
    "registration_decisions": fill(
        "registration_decisions", "registration", "ApplicationID", "ApprovalDate", "'Approved', 'Rejected', 'Cancelled'", AS_OF
    ),
    "transfer_decisions": fill(
        "transfer_decisions", "room_transfer", "TransferID", "ApprovalDate",
        "'Approved', 'Rejected', 'Completed', 'Cancelled'", AS_OF,
    ),
    "leave_decisions": fill(
        "leave_decisions", "leave_permission", "PermissionID", "ApprovalDate", "'Approved', 'Rejected', 'Cancelled'", AS_OF
    ),
    "visitor_decisions": fill(
        "visitor_decisions", "visitor_permission", "PermissionID", "ApprovalDate", "'Approved', 'Rejected', 'Expired'", AS_OF
    ),
    "expired_visitor_permissions": expire(
        "expired_visitor_permissions", "visitor_permission", "PermissionID", "EndDate", "Approved", "Expired"
    ),
    "expired_meal_subscriptions": expire(
        "expired_meal_subscriptions", "meal_subscription", "SubscriptionID", "EndDate", "Active", "Expired"
    ),
    "overdue_penalties": expire("overdue_penalties", "penalty", "PenaltyID", "DueDate", "Pending", "Overdue"),
    "repaired_assignment_dates": log(
        "repaired_assignment_dates", "room_assignment", "AssignmentID", "ActualCheckOutDate",
        """SELECT AssignmentID AS k, ActualCheckOutDate AS old, CheckInDate AS new FROM room_assignment
           WHERE ActualCheckOutDate < CheckInDate""",
    ),
    "repaired_transfer_dates": log(
        "repaired_transfer_dates", "room_transfer", "TransferID", "EffectiveMoveDate",
        f"SELECT TransferID AS k, old, new FROM {MOVES} m",
    )
    + " UNION ALL "
    + log(
        "repaired_transfer_dates", "room_assignment", "AssignmentID", "CheckInDate",
        f"""SELECT a.AssignmentID AS k, any_value(a.CheckInDate) AS old, max(m.new) AS new FROM {MOVES} m
            JOIN room_assignment a ON a.StudentID = m.StudentID AND a.RoomID = m.ToRoomID AND a.Status = 'Active'
            WHERE a.CheckInDate < m.new GROUP BY a.AssignmentID""",
    ),
    "invoice_statuses": log(
        "invoice_statuses", "invoice", "InvoiceID", "PaymentStatus",
        f"""SELECT i.InvoiceID AS k, i.PaymentStatus AS old, CASE WHEN i.PaymentStatus = 'Cancelled' THEN 'Cancelled'
          WHEN coalesce(p.PaidAmount, 0) >= i.TotalAmount + i.TaxAmount + i.LateFee - i.DiscountAmount THEN 'Paid'
          WHEN i.DueDate < {AS_OF} THEN 'Overdue' WHEN coalesce(p.PaidAmount, 0) > 0 THEN 'Partial'
          ELSE 'Unpaid' END AS new FROM invoice i LEFT JOIN {PAID} p USING (InvoiceID)""",
    ),
    "synced_student_accounts": " UNION ALL ".join(
        log(
            "synced_student_accounts", "system_user", "UserID", column,
            f"SELECT u.UserID AS k, u.{column} AS old, s.{column} AS new FROM system_user u JOIN student s USING (StudentID)",
        )
        for column in ("Email", "FirstName", "LastName")
    ),
    "room_inspection_rollups": " UNION ALL ".join(
        log(
            "room_inspection_rollups", "room", "RoomID", column,
            f"""SELECT r.RoomID AS k, r.{column} AS old, n.{source} AS new FROM room r JOIN (
                SELECT *, row_number() OVER (PARTITION BY RoomID
                  ORDER BY InspectionDate DESC, InspectionID DESC, FurnitureCondition) AS place
                FROM room_inspection WHERE Status = 'Completed') n ON n.RoomID = r.RoomID AND n.place = 1""",
        )
        for column, source in (("LastInspectionDate", "InspectionDate"), ("FurnitureCondition", "FurnitureCondition"))
    ),
    "building_maintenance_rollups": log(
        "building_maintenance_rollups", "building", "BuildingID", "LastMaintenanceDate",
        """SELECT b.BuildingID AS k, any_value(b.LastMaintenanceDate) AS old, max(CAST(q.ResolvedAt AS DATE)) AS new
           FROM maintenance_request q JOIN room r USING (RoomID) JOIN building b USING (BuildingID)
           WHERE q.Status IN ('Resolved', 'Closed') AND q.ResolvedAt IS NOT NULL GROUP BY b.BuildingID""",
    ),
}

COUNTED_TABLE = {
    "repaired_transfer_dates": "room_transfer",
    "assigned_missing_beds": "room_assignment",
}


def count_of(step: str, body: str) -> str:
    table = COUNTED_TABLE.get(step)
    where = f"step = '{step}'" + (f" AND table_name = '{table}'" if table else "")
    return f"SELECT '{step}' AS step, (SELECT count(DISTINCT row_key) FROM ({body}) q WHERE {where}) AS changed_rows"


def streamed() -> str:
    """The pipelines, the saved rows, and the housing steps once more over the state they leave."""
    names = r"\b(h1_new|h1|h2|h3|free|waiting|fills|counted)\b"
    again = re.sub(names, r"\1_2", CHAIN)
    for table in ("room_assignment", "occupancy_log", "bed_slot", "room"):
        again = re.sub(rf"\b{table}\b", f"{table}_1", again)
    lifted = f"""SELECT row_key, max(new_value) AS day FROM ({OPERATIONAL['repaired_transfer_dates']}) z
        WHERE table_name = 'room_assignment' GROUP BY row_key"""
    invoices = OPERATIONAL["invoice_statuses"]
    invoices = invoices[invoices.index("SELECT i.InvoiceID") : invoices.rindex(") z")].replace("FROM invoice i", "FROM invoices_1 i")
    ends = f"Status = 'Active' AND CheckOutDate BETWEEN {AS_OF} - 60 AND {AS_OF} - 1"
    rows = {
        "room": ("RoomID", """concat_ws('|', CASE WHEN CurrentOccupancy IS NULL AND c = 0 THEN NULL ELSE c END,
            CASE WHEN Status IN ('Available', 'Occupied') THEN derived ELSE Status END)""", "counted_2"),
        "bed_slot": ("BedSlotID", "CAST(IsOccupied OR BedSlotID IN (SELECT BedSlotID FROM fills_2) AS VARCHAR)", "h3_2"),
        "room_assignment": ("a.AssignmentID", "concat_ws('|', a.Status, coalesce(a.BedSlotID, f.BedSlotID))",
                            "room_assignment_1 a LEFT JOIN fills_2 f USING (AssignmentID)"),
        "occupancy_log": ("LogID", "concat_ws('|', AssignmentID, EndDate)", "h2_2"),
        "invoice": ("k", "new", f"({invoices}) v"),
        "system_user": ("u.UserID", """CASE WHEN s.StudentID IS NULL THEN u.Email
            WHEN s.City = 'FURNITURE' THEN 'new.' || s.Email ELSE s.Email END""",
                        "system_user u LEFT JOIN student s USING (StudentID)"),
    }
    shown = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST({k} AS VARCHAR) AS row_key, {v} AS value FROM {source}"
        for n, (k, v, source) in rows.items()
    )
    return f"""WITH {CHAIN}, lifted AS ({lifted}),
        room_assignment_1 AS (SELECT a.* REPLACE (coalesce(a.BedSlotID, f.BedSlotID) AS BedSlotID,
            coalesce(CAST(d.day AS DATE), a.CheckInDate) AS CheckInDate,
            CASE WHEN {ends} THEN 'Completed' ELSE a.Status END AS Status)
          FROM room_assignment a LEFT JOIN fills f USING (AssignmentID)
          LEFT JOIN lifted d ON d.row_key = CAST(a.AssignmentID AS VARCHAR)),
        occupancy_log_1 AS (SELECT * EXCLUDE (old) FROM h2),
        bed_slot_1 AS (SELECT * EXCLUDE (old) FROM h3),
        room_1 AS (SELECT * EXCLUDE (c, derived, CurrentOccupancy), CASE WHEN CurrentOccupancy IS NULL AND c = 0
          THEN NULL ELSE c END AS CurrentOccupancy FROM counted),
        invoices_1 AS (SELECT * REPLACE (CASE WHEN DueDate BETWEEN {AS_OF} - 60 AND {AS_OF} - 1 THEN DueDate + 90
          ELSE DueDate END AS DueDate) FROM invoice),
        {again} {shown}"""


def oracles() -> dict[str, str]:
    found = {f"repair_{step}": f"WITH {CHAIN} {body}" for step, body in HOUSING.items()}
    found.update({f"repair_{step}": body for step, body in OPERATIONAL.items()})
    counts = [count_of(step, body) for step, body in HOUSING.items() if step != "updated_rooms"]
    counts += [
        count_of(step, HOUSING["updated_rooms"]) for step in ("updated_room_occupancy", "updated_room_status")
    ]
    found["reconcile_housing_counts"] = f"WITH {CHAIN} " + " UNION ALL ".join(counts)
    # Resolution times are filled before the maintenance rollup reads them.
    filled = OPERATIONAL["building_maintenance_rollups"].replace(
        "max(CAST(q.ResolvedAt AS DATE))", f"max(CAST(coalesce(q.ResolvedAt, {NOW}) AS DATE))"
    ).replace(" AND q.ResolvedAt IS NOT NULL", "")
    operational = {**OPERATIONAL, "building_maintenance_rollups": filled}
    found["reconcile_operational_counts"] = " UNION ALL ".join(count_of(s, body) for s, body in operational.items())
    found["reconciled_occupancy_log"] = f"WITH {CHAIN} SELECT * EXCLUDE (old) FROM h2"
    found["reconciled_bed_slot"] = f"""WITH {CHAIN} SELECT b.* EXCLUDE (old, IsOccupied),
        b.IsOccupied OR b.BedSlotID IN (SELECT BedSlotID FROM fills) AS IsOccupied FROM h3 b"""
    found["reconciled_room_assignment"] = f"""WITH {CHAIN} SELECT a.* EXCLUDE (BedSlotID),
        coalesce(a.BedSlotID, f.BedSlotID) AS BedSlotID FROM room_assignment a LEFT JOIN fills f USING (AssignmentID)"""
    found["reconciled_room"] = f"""WITH {CHAIN} SELECT * EXCLUDE (c, derived, CurrentOccupancy, Status),
        CASE WHEN CurrentOccupancy IS NULL AND c = 0 THEN NULL ELSE CAST(c AS INTEGER) END AS CurrentOccupancy,
        CASE WHEN Status IN ('Available', 'Occupied') THEN derived ELSE Status END AS Status FROM counted"""
    for table, column, statuses, value in (
        ("room_assignment", "ActualCheckOutDate", "'Completed', 'Cancelled'", AS_OF),
        ("room_transfer", "ApprovalDate", "'Approved', 'Rejected', 'Completed', 'Cancelled'", AS_OF),
        ("maintenance_request", "ResolvedAt", DONE, NOW),
    ):
        found[f"save_time_fills_{table}"] = f"""SELECT * EXCLUDE ({column}), CASE WHEN Status IN ({statuses})
            THEN coalesce({column}, {value}) ELSE {column} END AS {column} FROM {table}"""
    found["reconciled_stream"] = streamed()
    found["stored_rooms_after_repairs"] = found["reconciled_room"]
    found["stored_logs_after_repairs"] = found["reconciled_occupancy_log"]
    found["bed_fills"] = f"WITH {CHAIN} SELECT * FROM fills"
    found["integrity_after_repairs"] = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST(0 AS BIGINT) AS violations" for name in REPAIRED_CHECKS
    )
    return found


REPAIRED_CHECKS = (
    "missing_occupancy_logs", "occupancy_mismatch", "room_status_mismatch", "bed_occupancy_mismatch",
    "resolved_maintenance_missing_timestamp", "closed_complaints_missing_timestamp",
    "resolved_incidents_missing_timestamp", "decisions_missing_dates", "invoice_status_mismatch",
    "student_account_profile_mismatch", "stale_visitor_permissions", "stale_meal_subscriptions",
    "pending_penalties_past_due", "building_maintenance_rollup_mismatch", "assignment_checkout_before_checkin",
    "transfer_move_before_source_checkin",
)
