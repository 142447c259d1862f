"""Oracle SQL for intake, browsing, deletes and notices."""

from __future__ import annotations

from hallkeeper.operators.browse import delete_order
from hallkeeper.schemas import MODULES, model_name
from oracles.repairs import CHAIN, OPERATIONAL
from oracles.rules import oracles as rule_oracles

AS_OF = "DATE '1998-06-30'"

# Decisions judged on the repaired tables; the contested ones are walked one by one in order.
APPROVALS = f"""WITH RECURSIVE {CHAIN},
    beds AS (SELECT b.BedSlotID, b.RoomID, b.BedNumber, NOT b.IsOccupied AND NOT b.IsReserved
        AND b.BedSlotID NOT IN (SELECT BedSlotID FROM fills) AS open FROM h3 b),
    per_room AS (SELECT RoomID, count(*) AS total, count(*) FILTER (WHERE open) AS free FROM beds GROUP BY RoomID),
    places AS (SELECT r.RoomID, r.Capacity, greatest(r.Capacity - CASE WHEN r.CurrentOccupancy IS NULL AND r.c = 0
          THEN 0 ELSE r.c END, 0) AS seats, CASE WHEN r.Status IN ('Available', 'Occupied') THEN r.derived
          ELSE r.Status END AS RoomStatus, b.Status AS BuildingStatus, b.GenderAllowed, y.BasePrice, y.SecurityDeposit,
        coalesce(p.total, 0) AS total, coalesce(p.free, 0) AS free
      FROM counted r JOIN building b USING (BuildingID) LEFT JOIN room_type y USING (RoomTypeID)
      LEFT JOIN per_room p ON p.RoomID = r.RoomID),
    judged AS (SELECT d.ApplicationID, g.StudentID, d.RoomID, d.BedSlotID,
        coalesce(d.CheckInDate, g.StartDate, m.StartDate, {AS_OF}) AS CheckInDate, w.BasePrice AS MonthlyRent,
        CAST(coalesce(w.SecurityDeposit, 0) AS DECIMAL(10,2)) AS DepositAmount, g.Priority, g.ApplicationDate,
        CASE g.Status WHEN 'Pending' THEN 1 WHEN 'Waitlisted' THEN 2 ELSE 3 END AS place, w.seats, w.total, w.free,
        CASE WHEN s.StudentID IS NULL THEN 'application_not_found' WHEN s.Status <> 'Active' THEN 'student_not_active'
          WHEN g.Status NOT IN ('Pending', 'Waitlisted', 'Approved') THEN 'application_decided'
          WHEN g.StudentID IN (SELECT StudentID FROM room_assignment WHERE Status = 'Active') THEN 'already_assigned'
          WHEN w.RoomID IS NULL THEN 'room_not_found' WHEN w.BuildingStatus <> 'Active' THEN 'building_not_active'
          WHEN w.RoomStatus NOT IN ('Available', 'Occupied') THEN 'room_not_assignable'
          WHEN w.seats < 1 THEN 'room_full'
          WHEN w.GenderAllowed NOT IN ('Mixed', s.Gender) THEN 'gender_not_admitted'
          WHEN d.BedSlotID IS NOT NULL AND coalesce(k.RoomID <> d.RoomID, true) THEN 'bed_in_other_room'
          WHEN d.BedSlotID IS NOT NULL AND NOT k.open THEN 'bed_not_available'
          WHEN d.BedSlotID IS NULL AND w.total > 0 AND w.free < 1 THEN 'no_free_bed' END AS refusal
      FROM housing_decision d LEFT JOIN registration g ON g.ApplicationID = d.ApplicationID
      LEFT JOIN academic_semester m ON m.SemesterID = g.SemesterID LEFT JOIN student s ON s.StudentID = g.StudentID
      LEFT JOIN places w ON w.RoomID = d.RoomID LEFT JOIN beds k ON k.BedSlotID = d.BedSlotID),
    queue AS (SELECT *, row_number() OVER (ORDER BY (BedSlotID IS NULL), place, Priority, ApplicationDate, ApplicationID) AS i
      FROM judged WHERE refusal IS NULL),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS people, CAST([] AS BIGINT[]) AS rooms,
        CAST([] AS BIGINT[]) AS taken, CAST('' AS VARCHAR) AS verdict
      UNION ALL
      SELECT i, CASE WHEN verdict = 'ok' THEN list_append(people, StudentID) ELSE people END,
        CASE WHEN verdict = 'ok' THEN list_append(rooms, RoomID) ELSE rooms END,
        CASE WHEN verdict = 'ok' AND BedSlotID IS NOT NULL THEN list_append(taken, BedSlotID) ELSE taken END, verdict
      FROM (SELECT q.i, v.people, v.rooms, v.taken, q.StudentID, q.RoomID, q.BedSlotID,
          CASE WHEN list_contains(v.people, q.StudentID) THEN 'already_assigned_in_batch'
            WHEN len(list_filter(v.rooms, lambda x: x = q.RoomID)) >= q.seats THEN 'room_full'
            WHEN q.BedSlotID IS NOT NULL AND list_contains(v.taken, q.BedSlotID) THEN 'bed_not_available'
            WHEN q.BedSlotID IS NULL AND q.total > 0 AND len(list_filter(v.rooms, lambda x: x = q.RoomID)) >= q.free
              THEN 'no_free_bed' ELSE 'ok' END AS verdict
        FROM walk v JOIN queue q ON q.i = v.i + 1) z),
    served AS (SELECT q.*, v.verdict FROM queue q JOIN walk v USING (i)),
    left_over AS (SELECT RoomID, BedSlotID, row_number() OVER (PARTITION BY RoomID ORDER BY BedNumber, BedSlotID) AS n
      FROM beds WHERE open AND BedSlotID NOT IN (
        SELECT BedSlotID FROM served WHERE verdict = 'ok' AND BedSlotID IS NOT NULL)),
    unbedded AS (SELECT ApplicationID, RoomID, row_number() OVER (PARTITION BY RoomID ORDER BY i) AS n
      FROM served WHERE verdict = 'ok' AND BedSlotID IS NULL)
    SELECT s.ApplicationID, s.StudentID, s.RoomID, nullif(s.verdict, 'ok') AS Reason,
      CASE WHEN s.verdict = 'ok' THEN coalesce(s.BedSlotID, o.BedSlotID) END AS BedSlotID,
      CASE WHEN s.verdict = 'ok' THEN s.CheckInDate END AS CheckInDate,
      CASE WHEN s.verdict = 'ok' THEN s.MonthlyRent END AS MonthlyRent,
      CASE WHEN s.verdict = 'ok' THEN s.DepositAmount END AS DepositAmount
    FROM served s LEFT JOIN unbedded w ON w.ApplicationID = s.ApplicationID
    LEFT JOIN left_over o ON o.RoomID = w.RoomID AND o.n = w.n
    UNION ALL SELECT ApplicationID, StudentID, RoomID, refusal, NULL, NULL, NULL, NULL FROM judged WHERE refusal IS NOT NULL"""

# Candidates over the same repaired tables, walked one by one; edits do not count their own stored row.
CANDIDATES = APPROVALS[: APPROVALS.index(",\n    judged AS")] + """,
    judged AS (SELECT c.*, w.seats AS open_seats, w.Capacity - coalesce(w.occupied, 0) AS seats, w.total, w.free,
        coalesce(o.Status = 'Active' AND o.RoomID = c.RoomID, false) AS stays_put,
        coalesce(o.BedSlotID = c.BedSlotID, false) AS own_bed, c.Status = 'Active' AS wanted,
        CASE WHEN c.Status <> 'Active' THEN NULL
          WHEN (SELECT count(*) FROM room_assignment a WHERE a.StudentID = c.StudentID AND a.Status = 'Active'
            AND a.AssignmentID <> c.AssignmentID) > 0 THEN 'other_active_assignment'
          WHEN w.RoomID IS NULL THEN 'room_not_found' WHEN w.BuildingStatus <> 'Active' THEN 'building_not_active'
          WHEN w.RoomStatus NOT IN ('Available', 'Occupied') THEN 'room_not_assignable'
          WHEN greatest(w.occupied - CASE WHEN o.Status = 'Active' AND o.RoomID = c.RoomID THEN 1 ELSE 0 END, 0) >= w.Capacity
            THEN 'room_full'
          WHEN g.StudentID <> c.StudentID THEN 'application_student'
          WHEN c.BedSlotID IS NOT NULL AND k.BedSlotID IS NULL THEN 'bed_missing'
          WHEN k.RoomID <> c.RoomID THEN 'bed_in_other_room'
          WHEN k.IsReserved OR (k.used AND o.BedSlotID IS DISTINCT FROM c.BedSlotID) THEN 'bed_not_available'
          WHEN c.BedSlotID IS NULL AND w.total > 0 AND w.free < 1 THEN 'no_free_bed' END AS refusal
      FROM assignment_candidate c
      LEFT JOIN (SELECT a.* REPLACE (coalesce(a.BedSlotID, f.BedSlotID) AS BedSlotID) FROM room_assignment a
        LEFT JOIN fills f USING (AssignmentID)) o ON o.AssignmentID = c.AssignmentID
      LEFT JOIN (SELECT p.*, n.c AS occupied FROM places p JOIN counted n USING (RoomID)) w ON w.RoomID = c.RoomID
      LEFT JOIN (SELECT BedSlotID, RoomID, IsReserved, IsOccupied OR BedSlotID IN (SELECT BedSlotID FROM fills) AS used FROM h3) k
        ON k.BedSlotID = c.BedSlotID
      LEFT JOIN registration g ON g.ApplicationID = c.ApplicationID),
    queue AS (SELECT *, row_number() OVER (ORDER BY (BedSlotID IS NULL), LineNo) AS i FROM judged WHERE refusal IS NULL),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS edited, CAST([] AS VARCHAR[]) AS people,
        CAST([] AS BIGINT[]) AS rooms, CAST([] AS BIGINT[]) AS taken, CAST('' AS VARCHAR) AS verdict
      UNION ALL
      SELECT i, CASE WHEN verdict = 'ok' THEN list_append(edited, AssignmentID) ELSE edited END,
        CASE WHEN verdict = 'ok' AND wanted THEN list_append(people, StudentID) ELSE people END,
        CASE WHEN verdict = 'ok' AND wanted AND NOT stays_put THEN list_append(rooms, RoomID) ELSE rooms END,
        CASE WHEN verdict = 'ok' AND wanted AND NOT own_bed AND BedSlotID IS NOT NULL THEN list_append(taken, BedSlotID)
          ELSE taken END, verdict
      FROM (SELECT q.*, v.edited, v.people, v.rooms, v.taken,
          CASE WHEN list_contains(v.edited, q.AssignmentID) THEN 'row_edited_in_batch'
            WHEN NOT q.wanted THEN 'ok'
            WHEN list_contains(v.people, q.StudentID) THEN 'other_active_assignment'
            WHEN NOT q.stays_put AND len(list_filter(v.rooms, lambda x: x = q.RoomID)) >= q.seats THEN 'room_full'
            WHEN q.BedSlotID IS NOT NULL AND NOT q.own_bed AND list_contains(v.taken, q.BedSlotID) THEN 'bed_not_available'
            WHEN NOT q.stays_put AND q.BedSlotID IS NULL AND q.total > 0
              AND len(list_filter(v.rooms, lambda x: x = q.RoomID)) >= q.free THEN 'no_free_bed' ELSE 'ok' END AS verdict
        FROM walk v JOIN queue q ON q.i = v.i + 1) z)
    SELECT q.LineNo, q.AssignmentID, q.StudentID, q.RoomID, nullif(v.verdict, 'ok') AS rule FROM queue q JOIN walk v USING (i)
    UNION ALL SELECT LineNo, AssignmentID, StudentID, RoomID, refusal FROM judged WHERE refusal IS NOT NULL"""

VISITORS = f"""
    asked AS (SELECT * EXCLUDE (NationalID), nullif(NationalID, '') AS NationalID FROM visitor_intake
              WHERE EndDate >= StartDate),
    known AS (SELECT NationalID, min(VisitorID) AS KnownID FROM visitor WHERE NationalID IS NOT NULL GROUP BY 1),
    founder AS (SELECT NationalID, min(RequestID) AS FounderID FROM asked
                WHERE NationalID IS NOT NULL AND NationalID NOT IN (SELECT NationalID FROM known) GROUP BY 1),
    served AS (SELECT a.*, k.KnownID, coalesce(f.FounderID, a.RequestID) AS MakerID,
        (SELECT max(VisitorID) FROM visitor) + 1 + coalesce(f.FounderID, a.RequestID) AS NewID
      FROM asked a LEFT JOIN known k ON k.NationalID = a.NationalID LEFT JOIN founder f ON f.NationalID = a.NationalID)
"""

GONE = """
    s AS (SELECT StudentID FROM student WHERE Status = 'Graduated'),
    d_registration AS (SELECT * FROM registration WHERE StudentID IN (FROM s)),
    d_room_assignment AS (SELECT * FROM room_assignment WHERE StudentID IN (FROM s)
      OR ApplicationID IN (SELECT ApplicationID FROM d_registration)),
    d_occupancy_log AS (SELECT * FROM occupancy_log WHERE StudentID IN (FROM s)
      OR AssignmentID IN (SELECT AssignmentID FROM d_room_assignment)),
    d_invoice AS (SELECT * FROM invoice WHERE StudentID IN (FROM s)
      OR AssignmentID IN (SELECT AssignmentID FROM d_room_assignment)),
    d_payment_transaction AS (SELECT * FROM payment_transaction WHERE StudentID IN (FROM s)
      OR InvoiceID IN (SELECT InvoiceID FROM d_invoice)),
    d_maintenance_request AS (SELECT * FROM maintenance_request WHERE ReportedByStudentID IN (FROM s)),
    d_maintenance_log AS (SELECT * FROM maintenance_log WHERE RequestID IN (SELECT RequestID FROM d_maintenance_request)),
    d_meal_subscription AS (SELECT * FROM meal_subscription WHERE StudentID IN (FROM s)),
    d_meal_attendance AS (SELECT * FROM meal_attendance WHERE StudentID IN (FROM s)
      OR SubscriptionID IN (SELECT SubscriptionID FROM d_meal_subscription))
"""
GONE_KEYS = {
    "student": ("s", "StudentID"),
    "registration": ("d_registration", "ApplicationID"),
    "room_assignment": ("d_room_assignment", "AssignmentID"),
    "occupancy_log": ("d_occupancy_log", "LogID"),
    "invoice": ("d_invoice", "InvoiceID"),
    "payment_transaction": ("d_payment_transaction", "TransactionID"),
    "maintenance_request": ("d_maintenance_request", "RequestID"),
    "maintenance_log": ("d_maintenance_log", "LogID"),
    "meal_subscription": ("d_meal_subscription", "SubscriptionID"),
    "meal_attendance": ("d_meal_attendance", "AttendanceID"),
    "access_log": ("access_log WHERE StudentID IN (FROM s)", "LogID"),
    "blacklist": ("blacklist WHERE StudentID IN (FROM s)", "BlacklistID"),
    "complaint": ("complaint WHERE StudentID IN (FROM s)", "ComplaintID"),
    "incident_report": ("incident_report WHERE StudentID IN (FROM s)", "ReportID"),
    "laundry_usage": ("laundry_usage WHERE StudentID IN (FROM s)", "UsageID"),
    "leave_permission": ("leave_permission WHERE StudentID IN (FROM s)", "PermissionID"),
    "lost_and_found_item": ("lost_and_found_item WHERE ReportedBy IN (FROM s)", "ItemID"),
    "notification": ("notification WHERE StudentID IN (FROM s)", "NotificationID"),
    "penalty": ("penalty WHERE StudentID IN (FROM s)", "PenaltyID"),
    "room_transfer": ("room_transfer WHERE StudentID IN (FROM s)", "TransferID"),
    "student_announcement": (
        "student_announcement WHERE StudentID IN (FROM s)",
        "StudentID || '/' || CAST(AnnouncementID AS VARCHAR)",
    ),
    "system_user": ("system_user WHERE StudentID IN (FROM s)", "UserID"),
    "visitor_permission": ("visitor_permission WHERE StudentID IN (FROM s)", "PermissionID"),
}


def notice(source: str, key: str, table: str, title: str, message: str, kind: str, priority: str = "'Normal'",
           student: str = "StudentID", room: str = "CAST(NULL AS BIGINT)", reach: str = "CAST(1 AS BIGINT)") -> str:
    return f"""SELECT {student} AS StudentID, {room} AS RoomID, {reach} AS Recipients, '{title}' AS Title,
        {message} AS Message, '{kind}' AS Type, {priority} AS PriorityLevel, '{table}' AS table_name,
        CAST({key} AS VARCHAR) AS row_key FROM {source}"""  # fmt: skip


def notices() -> str:
    cancelled = rule_oracles()["cancel_requests"]
    parts = [
        notice(
            f"""penalty JOIN ({OPERATIONAL['overdue_penalties']}) c ON c.row_key = CAST(PenaltyID AS VARCHAR)""",
            "PenaltyID", "penalty", "Penalty updated",
            "'Your ' || Type || ' record is now Overdue with amount EGP ' || CAST(Amount AS VARCHAR) || '.'",
            "Penalty", "'High'",
        ),
        notice(
            "blacklist", "BlacklistID", "blacklist", "Blacklist record added",
            "'A blacklist record was added to your profile with status ' || Status || '.'", "Conduct", "'Urgent'",
        ),
        notice(
            "incident_report WHERE StudentID IS NOT NULL", "ReportID", "incident_report", "Incident report linked",
            "'An incident report was linked to your student record: ' || Title || '.'", "Incident", "SeverityLevel",
        ),
        notice(
            """(SELECT g.*, e.NewStatus FROM registration g JOIN status_edit e
                ON e.Entity = 'registration' AND e.RowKey = g.ApplicationID WHERE e.NewStatus <> g.Status) g""",
            "ApplicationID", "registration", "Application status updated",
            """'Your dorm application is now ' || NewStatus || '.' || CASE WHEN NewStatus = 'Approved' AND NOT EXISTS (
                 SELECT 1 FROM room_assignment a WHERE a.ApplicationID = g.ApplicationID)
               THEN ' Room assignment is still pending.' ELSE '' END""",
            "Housing", "CASE WHEN NewStatus = 'Approved' THEN 'High' ELSE 'Normal' END",
        ),
        notice(
            "room_assignment", "AssignmentID", "room_assignment", "Room assignment created",
            "'A room assignment was added to your student record.'", "Housing", "'High'",
        ),
        notice(
            """(SELECT x.*, e.NewStatus FROM room_transfer x JOIN status_edit e
                ON e.Entity = 'room_transfer' AND e.RowKey = x.TransferID WHERE e.NewStatus <> x.Status) x""",
            "TransferID", "room_transfer", "Room transfer updated",
            "'Your room transfer request is now ' || NewStatus || '.'", "Housing",
            "CASE WHEN NewStatus IN ('Approved', 'Completed') THEN 'High' ELSE 'Normal' END",
        ),
        notice(
            f"""visitor_permission JOIN ({OPERATIONAL['expired_visitor_permissions']}) c
                ON c.row_key = CAST(PermissionID AS VARCHAR)""",
            "PermissionID", "visitor_permission", "Visitor request updated", "'Your visitor request is now Expired.'",
            "Permission",
        ),
        notice(
            f"({cancelled}) q WHERE q.Entity = 'leave_permission' AND q.Outcome = 'cancelled'",
            "RowKey", "leave_permission", "Leave request updated", "'Your leave request is now Cancelled.'", "Permission",
        ),
        notice(
            f"""({cancelled}) q JOIN maintenance_request m ON m.RequestID = q.RowKey
                WHERE q.Entity = 'maintenance_request' AND q.Outcome = 'cancelled'""",
            "RowKey", "maintenance_request", "Maintenance request updated",
            "'Maintenance request ''' || m.Title || ''' is now Cancelled.'", "Maintenance",
        ),
        notice(
            f"""({cancelled}) q JOIN complaint m ON m.ComplaintID = q.RowKey
                WHERE q.Entity = 'complaint' AND q.Outcome = 'cancelled'""",
            "RowKey", "complaint", "Complaint updated", "'Complaint ''' || m.Subject || ''' is now Cancelled.'",
            "Complaint", student="m.StudentID",
        ),
        notice(
            "maintenance_log l JOIN maintenance_request m USING (RequestID) WHERE m.ReportedByStudentID IS NOT NULL",
            "l.LogID", "maintenance_log", "Maintenance progress added",
            "'A new maintenance work-log update was added to your request.'", "Maintenance",
            student="m.ReportedByStudentID",
        ),
        notice(
            """room_inspection i JOIN (SELECT RoomID, count(*) AS n FROM room_assignment WHERE Status = 'Active'
               GROUP BY RoomID) a ON a.RoomID = i.RoomID""",
            "i.InspectionID", "room_inspection", "Room inspection recorded",
            "'A room inspection record was added for your current room.'", "Housing",
            student="CAST(NULL AS VARCHAR)", room="i.RoomID", reach="a.n",
        ),
        notice(
            f"invoice JOIN ({OPERATIONAL['invoice_statuses']}) c ON c.row_key = CAST(InvoiceID AS VARCHAR)",
            "InvoiceID", "invoice", "Invoice status updated", "'Your invoice is now ' || c.new_value || '.'", "Finance",
        ),
        notice(
            "payment_transaction", "TransactionID", "payment_transaction", "Payment recorded",
            "'A payment of EGP ' || CAST(PaymentAmount AS VARCHAR) || ' was recorded with status ' || PaymentStatus || '.'",
            "Finance",
        ),
        notice(
            "student WHERE DisciplinaryStatus = 'Warning'", "StudentID", "student", "Student record updated",
            "'Student status: ' || Status || '; disciplinary status: Probation.'", "Student Record", "'High'",
        ),
    ]
    return "\nUNION ALL ".join(parts)


def accounts(body: str) -> str:
    """Over the candidates no rule rejects; their ids and emails are all different in the test data."""
    broken = rule_oracles()["rules_portal_registration"]
    candidates, rules = broken.removeprefix("WITH ").split(") SELECT CandidateID, 'StudentID'", 1)
    return f"""WITH {candidates}), broken AS (SELECT CandidateID, 'StudentID'{rules}),
        clean AS (SELECT * FROM c WHERE CandidateID NOT IN (SELECT CandidateID FROM broken)) {body}"""


def inventory() -> str:
    parts, position = [], 0
    for module, names in MODULES.items():
        for name in names:
            position += 1
            words = "".join(" " + c if c.isupper() else c for c in model_name(name)).strip()
            parts.append(
                f"""SELECT '{module}' AS module, {position} AS position, '{name}' AS table_name,
                    '{words}' AS label, count(*) AS rows FROM {name}"""
            )
    return " UNION ALL ".join(parts)


def oracles() -> dict[str, str]:
    order = [name for name in delete_order(["student"]) if name in GONE_KEYS]
    text = "coalesce(CAST({} AS VARCHAR), '')"
    return {
        "visitor_intake_permissions": f"""WITH {VISITORS}
            SELECT RequestID, coalesce(KnownID, NewID) AS VisitorID, StudentID, {AS_OF} AS RequestDate, StartDate, EndDate,
              'Pending' AS Status FROM served""",
        "visitor_intake_visitors": f"""WITH {VISITORS}
            SELECT NewID AS VisitorID, FirstName, LastName, NationalID, true AS IsActive FROM served
            WHERE KnownID IS NULL AND MakerID = RequestID""",
        "approve_applications": APPROVALS,
        "stays_from_approvals": f"""SELECT (SELECT max(AssignmentID) FROM room_assignment) + 1 + ApplicationID AS AssignmentID,
              StudentID, RoomID, BedSlotID, ApplicationID, CheckInDate, 'Active' AS Status, MonthlyRent, DepositAmount
            FROM ({APPROVALS}) z WHERE Reason IS NULL""",
        "notices_from_approvals": f"""SELECT (SELECT max(NotificationID) FROM notification) + 1 + ApplicationID AS NotificationID,
              StudentID, 'Dorm application approved' AS Title,
              'Your dorm application was approved and a room assignment is now active.' AS Message, 'In-App' AS Channel,
              'Housing' AS Type, false AS IsRead, 'High' AS PriorityLevel, TIMESTAMP '2024-01-15 12:00:00' AS PublishDate,
              'Sent' AS Status
            FROM ({APPROVALS}) z WHERE Reason IS NULL""",
        "rules_assignment_candidates": CANDIDATES,
        "new_account_students": accounts(
            """SELECT sid AS StudentID, FirstName, LastName, mail AS Email, NationalIDOrPassport, DateOfBirth, Gender,
              FacultyID, ProgramID, 'Clear' AS DisciplinaryStatus, 'Active' AS Status FROM clean WHERE fs IS NULL"""
        ),
        "new_account_users": accounts(
            """SELECT (SELECT max(UserID) FROM system_user) + 1 + CandidateID AS UserID,
              (SELECT RoleID FROM role WHERE lower(RoleName) LIKE '%student%' ORDER BY
                CASE lower(RoleName) WHEN 'student resident' THEN 1 WHEN 'student' THEN 2 ELSE 3 END, RoleID LIMIT 1)
                AS RoleID, sid AS StudentID, mail AS Email, FirstName, LastName, 'Active' AS Status FROM clean"""
        ),
        "table_scan_rooms": "SELECT RoomID, RoomNumber, Capacity FROM room",
        "row_count_active_students": "SELECT 'student' AS table_name, count(*) AS rows FROM student WHERE Status = 'Active'",
        "table_inventory": inventory(),
        "search_students": """SELECT * FROM student WHERE lower(concat_ws('|', StudentID, FirstName, LastName, Email, Gender,
              Status, PhoneNumber, City, Country, NationalIDOrPassport, CAST(DateOfBirth AS VARCHAR), DisciplinaryStatus))
              LIKE '%customer#0000000%' ORDER BY StudentID DESC LIMIT 300""",
        "matching_transfers": """SELECT * FROM room_transfer WHERE lower(StudentID) LIKE '%1998%'
            OR CAST(RequestDate AS VARCHAR) LIKE '%1998%' OR CAST(EffectiveMoveDate AS VARCHAR) LIKE '%1998%'
            OR CAST(ApprovalDate AS VARCHAR) LIKE '%1998%' OR CAST(TransferID AS VARCHAR) LIKE '%1998%'
            OR Status LIKE '%1998%' OR PriorityLevel LIKE '%1998%' OR Reason LIKE '%1998%'""",
        "labels_students": """SELECT StudentID AS row_key, FirstName || ' ' || LastName AS label FROM student
            UNION ALL SELECT CAST(UserID AS VARCHAR),
              CASE WHEN FirstName IS NULL THEN LastName ELSE FirstName || ' ' || LastName END FROM system_user""",
        "labels_buildings": "SELECT CAST(BuildingID AS VARCHAR) AS row_key, BuildingName || ' / ' || BuildingCode AS label FROM building",
        "export_invoices": "SELECT "
        + ", ".join(
            f"{text.format(c)} AS {c}"
            for c in (
                "InvoiceID", "StudentID", "TotalAmount", "TaxAmount", "DiscountAmount", "LateFee", "DueDate",
                "PaymentStatus", "AssignmentID", "InvoiceType",
            )
        )
        + " FROM invoice",
        "enum_literals": """SELECT BuildingID, BuildingName || '|it''s ' || GenderAllowed AS enum_values FROM building""",
        "status_texts": """SELECT RequestID, CASE WHEN length(Title) > 11 THEN substring(Title, 1, 10) || '…' ELSE Title END
              AS ShortTitle, replace(lower(Status), ' ', '-') AS StatusSlug, coalesce(Category, 'General') AS CategoryText
            FROM maintenance_request""",
        "student_initials": "SELECT StudentID, upper(left(FirstName, 1) || left(LastName, 1)) AS Initials FROM student",
        "view_scan_available_beds": """SELECT r.BuildingID, count(*) AS Beds FROM bed_slot d JOIN room r USING (RoomID)
            JOIN building b USING (BuildingID) WHERE NOT d.IsOccupied AND NOT d.IsReserved
              AND r.Status IN ('Available', 'Occupied') AND b.Status = 'Active' GROUP BY r.BuildingID""",
        "cascade_delete_graduates": f"WITH {GONE} "
        + " UNION ALL ".join(
            f"SELECT {i} AS position, '{name}' AS table_name, CAST({GONE_KEYS[name][1]} AS VARCHAR) AS row_key "
            f"FROM {GONE_KEYS[name][0]}"
            for i, name in enumerate(order, start=1)
        ),
        "logs_closed_by_delete": f"""SELECT l.* EXCLUDE (EndDate), CASE WHEN EXISTS (SELECT 1 FROM room_assignment a
              WHERE a.AssignmentID = l.AssignmentID AND a.Status = 'Cancelled') THEN coalesce(l.EndDate, {AS_OF})
              ELSE l.EndDate END AS EndDate FROM occupancy_log l""",
        "changed_columns": " UNION ALL ".join(
            f"SELECT table_name, 'update' AS operation, row_key, column_name AS columns FROM ({OPERATIONAL[step]}) c"
            for step in ("overdue_penalties", "expired_visitor_permissions", "invoice_statuses")
        ),
        "streamed_changes": " UNION ALL ".join(
            f"""SELECT table_name, 'update' AS operation, row_key, column_name AS columns FROM ({OPERATIONAL[step]}) c
              WHERE CAST(row_key AS BIGINT) % 50 > 1
            UNION ALL SELECT '{table}', CASE {key} % 50 WHEN 0 THEN 'delete' ELSE 'insert' END, CAST({key} AS VARCHAR), ''
              FROM {table} WHERE {key} % 50 <= 1"""
            for table, key, step in (
                ("penalty", "PenaltyID", "overdue_penalties"),
                ("visitor_permission", "PermissionID", "expired_visitor_permissions"),
                ("invoice", "InvoiceID", "invoice_statuses"),
            )
        ),
        "notifications_batch": notices(),
        "notifications_streaming": notices(),
    }
