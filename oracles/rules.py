"""Oracle SQL for the row-validation rules."""

from __future__ import annotations

from hallkeeper.schemas import VOCABULARIES
from oracles.listings import AS_OF, BEDS, CURRENT, DESTINATIONS, NOTICES


def broken(table: str, key: str, rule: str, source: str) -> str:
    return f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key, {rule} AS rule FROM {source}"


def period(table: str, key: str) -> str:
    return broken(table, key, "'end_before_start'", f"{table} WHERE EndDate < StartDate")


def imported(column: str, parse: str, required: bool, allowed: str = "") -> str:
    text = f"trim({column})"
    blank = f"coalesce({text} = '', true)"
    rule = f"CASE WHEN {blank} THEN {chr(39) + 'required' + chr(39) if required else 'NULL'} WHEN {parse} IS NULL THEN 'not_typed'"
    rule += f" WHEN {text} NOT IN ({allowed}) THEN 'value_not_allowed' END" if allowed else " END"
    return f"""SELECT 'invoice' AS table_name, CAST(LineNo AS VARCHAR) AS row_key, {rule} AS rule,
        '{column}' AS column_name FROM raw_invoice"""


IMPORTS = {
    "penalty": (
        ("PenaltyID", "BIGINT", True, ""), ("StudentID", "VARCHAR", False, ""), ("Amount", "DECIMAL(10,2)", False, ""),
        ("PenaltyDate", "DATE", False, ""), ("DueDate", "DATE", False, ""),
        ("Status", "VARCHAR", True, "'Pending', 'Paid', 'Waived', 'Overdue'"), ("Type", "VARCHAR", True, ""),
    ),
    "meal_subscription": (
        ("SubscriptionID", "BIGINT", True, ""), ("StudentID", "VARCHAR", False, ""), ("StartDate", "DATE", False, ""),
        ("EndDate", "DATE", False, ""), ("MealsPerDay", "INTEGER", False, ""),
        ("Status", "VARCHAR", True, "'Active', 'Paused', 'Cancelled', 'Expired'"),
    ),
    "complaint": (
        ("ComplaintID", "BIGINT", True, ""), ("StudentID", "VARCHAR", False, ""), ("Subject", "VARCHAR", False, ""),
        ("Status", "VARCHAR", True, "'Open', 'In Progress', 'Resolved', 'Closed', 'Rejected'"),
        ("SubmittedAt", "TIMESTAMP", False, ""), ("ClosedAt", "TIMESTAMP", False, ""), ("Category", "VARCHAR", False, ""),
        ("Priority", "VARCHAR", True, "'Low', 'Medium', 'High', 'Urgent'"),
    ),
}


def imported_lines(table: str) -> str:
    """Each field of each line with the rule it breaks, and the lines of a wrong number of fields."""
    columns = IMPORTS[table]
    source = f"(SELECT LineNo, line, string_split(line, ',') AS f FROM raw_line WHERE table_name = '{table}') z"
    right = f"len(f) = {len(columns)} AND trim(line) <> ''"
    parts = []
    for i, (column, kind, required, allowed) in enumerate(columns, start=1):
        blank = "'required'" if required else "NULL"
        wrong = f"WHEN trim(f[{i}]) NOT IN ({allowed}) THEN 'value_not_allowed'" if allowed else ""
        parts.append(
            f"""SELECT LineNo, CASE WHEN trim(f[{i}]) = '' THEN {blank}
                WHEN TRY_CAST(replace(trim(f[{i}]), 'T', CASE WHEN '{kind}' = 'TIMESTAMP' THEN ' ' ELSE 'T' END) AS {kind}) IS NULL
                THEN 'not_typed' {wrong} END AS rule, '{column}' AS column_name, CAST(NULL AS VARCHAR) AS line
                FROM {source} WHERE {right}"""
        )
    parts.append(f"SELECT LineNo, 'line_not_split', NULL, line FROM {source} WHERE NOT ({right})")
    return f"""SELECT '{table}' AS table_name, CAST(LineNo AS VARCHAR) AS row_key, rule, column_name, line
        FROM ({" UNION ALL ".join(parts)}) y WHERE rule IS NOT NULL"""


def candidate_rule(field: str, rule: str, where: str) -> str:
    return f"SELECT CandidateID, '{field}' AS field, '{rule}' AS rule FROM c WHERE {where}"


def cancel(entity: str, key: str, owner: str, allowed: str, column: str) -> str:
    return f"""SELECT q.Entity, q.RowKey, q.StudentID, e.Status AS OldStatus,
          CASE WHEN e.Status IS NULL THEN 'not_found' WHEN e.Status IN ({allowed}) THEN 'cancelled'
            ELSE 'status_not_cancellable' END AS Outcome,
          CASE WHEN e.Status IN ({allowed}) THEN {column} END AS DateColumn
        FROM cancel_request q LEFT JOIN {entity} e ON e.{key} = q.RowKey AND e.{owner} = q.StudentID
        WHERE q.Entity = '{entity}'"""


def oracles() -> dict[str, str]:
    year = "CASE WHEN TRY_CAST(trim(AcademicYear) AS INTEGER) BETWEEN 1901 AND 2155 THEN 1 END"
    statuses = ", ".join(f"'{v}'" for v in VOCABULARIES["invoice", "PaymentStatus"])
    return {
        "rules_finance_links": broken(
            "payment_transaction", "p.TransactionID", "'payment_student'",
            "payment_transaction p JOIN invoice i USING (InvoiceID) WHERE p.StudentID <> i.StudentID",
        )
        + " UNION ALL "
        + broken(
            "invoice", "i.InvoiceID", "'invoice_student'",
            "invoice i JOIN room_assignment a USING (AssignmentID) WHERE a.StudentID <> i.StudentID",
        ),
        "rules_transfers": f"""WITH {BEDS}, judged AS (
            SELECT x.TransferID, CASE WHEN x.FromRoomID = x.ToRoomID THEN 'same_room'
              WHEN x.Status IN ('Pending', 'Approved', 'Completed') AND NOT EXISTS (SELECT 1 FROM room_assignment a
                WHERE a.StudentID = x.StudentID AND a.RoomID = x.FromRoomID AND a.Status = 'Active') THEN 'no_active_source'
              WHEN x.Status IN ('Pending', 'Approved') AND w.BuildingStatus <> 'Active' THEN 'building_not_active'
              WHEN x.Status IN ('Pending', 'Approved') AND w.Status NOT IN ('Available', 'Occupied')
                THEN 'room_not_assignable'
              WHEN x.Status IN ('Pending', 'Approved') AND coalesce(w.CurrentOccupancy, 0) >= w.Capacity THEN 'room_full'
              WHEN x.Status IN ('Pending', 'Approved') AND w.total > 0 AND w.free = 0 THEN 'no_free_bed'
              WHEN x.EffectiveMoveDate < x.RequestDate THEN 'move_before_request' END AS rule
            FROM room_transfer x LEFT JOIN wide w ON w.RoomID = x.ToRoomID)
            {broken("room_transfer", "TransferID", "rule", "judged WHERE rule IS NOT NULL")}""",
        "rules_assignments": f"""WITH {BEDS}, judged AS (
            SELECT a.AssignmentID, CASE WHEN (SELECT count(*) FROM room_assignment o WHERE o.StudentID = a.StudentID
                AND o.Status = 'Active' AND o.AssignmentID <> a.AssignmentID) > 0 THEN 'other_active_assignment'
              WHEN w.BuildingStatus <> 'Active' THEN 'building_not_active'
              WHEN w.Status NOT IN ('Available', 'Occupied') THEN 'room_not_assignable'
              WHEN greatest(coalesce(w.CurrentOccupancy, 0) - 1, 0) >= w.Capacity THEN 'room_full'
              WHEN g.StudentID <> a.StudentID THEN 'application_student'
              WHEN a.BedSlotID IS NOT NULL AND d.BedSlotID IS NULL THEN 'bed_missing'
              WHEN d.RoomID <> a.RoomID THEN 'bed_in_other_room' WHEN d.IsReserved THEN 'bed_not_available'
              WHEN a.BedSlotID IS NULL AND w.total > 0 AND w.free = 0 THEN 'no_free_bed' END AS rule
            FROM room_assignment a LEFT JOIN wide w ON w.RoomID = a.RoomID
            LEFT JOIN registration g ON g.ApplicationID = a.ApplicationID
            LEFT JOIN bed_slot d ON d.BedSlotID = a.BedSlotID WHERE a.Status = 'Active')
            {broken("room_assignment", "AssignmentID", "rule", "judged WHERE rule IS NOT NULL")}""",
        "rules_dates": " UNION ALL ".join(
            [
                period("registration", "ApplicationID"),
                period("leave_permission", "PermissionID"),
                period("visitor_permission", "PermissionID"),
                period("meal_subscription", "SubscriptionID"),
                broken("room_assignment", "AssignmentID", "'checkout_not_after_checkin'",
                       "room_assignment WHERE CheckOutDate <= CheckInDate"),
                broken("room_assignment", "AssignmentID", "'actual_checkout_before_checkin'",
                       "room_assignment WHERE ActualCheckOutDate < CheckInDate"),
                broken("room_transfer", "TransferID", "'move_before_request'",
                       "room_transfer WHERE EffectiveMoveDate < RequestDate"),
            ]
        ),
        "vocabulary_counts": " UNION ALL ".join(
            f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, count(*) AS rows,
                coalesce({column} IN ({", ".join(f"'{v}'" for v in values)}), false) AS allowed
                FROM {table} GROUP BY {column}"""
            for (table, column), values in VOCABULARIES.items()
        ),
        "rules_import": "SELECT * FROM ("
        + " UNION ALL ".join(
            [
                imported("InvoiceID", "TRY_CAST(trim(InvoiceID) AS BIGINT)", True),
                imported("TotalAmount", "TRY_CAST(trim(TotalAmount) AS DECIMAL(10,2))", True),
                imported("DueDate", "TRY_CAST(trim(DueDate) AS DATE)", True),
                imported("CreatedAt", "TRY_CAST(replace(trim(CreatedAt), 'T', ' ') AS TIMESTAMP)", False),
                imported("AcademicYear", year, False),
                imported("PaymentStatus", "trim(PaymentStatus)", True, statuses),
            ]
        )
        + ") z WHERE rule IS NOT NULL",
        "imported_invoices": """SELECT LineNo, TRY_CAST(trim(InvoiceID) AS BIGINT) AS InvoiceID,
              TRY_CAST(trim(TotalAmount) AS DECIMAL(10,2)) AS TotalAmount, TRY_CAST(trim(DueDate) AS DATE) AS DueDate,
              TRY_CAST(replace(trim(CreatedAt), 'T', ' ') AS TIMESTAMP) AS CreatedAt,
              CASE WHEN TRY_CAST(trim(AcademicYear) AS INTEGER) BETWEEN 1901 AND 2155
                THEN TRY_CAST(trim(AcademicYear) AS INTEGER) END AS AcademicYear,
              nullif(trim(PaymentStatus), '') AS PaymentStatus FROM raw_invoice""",
        "rules_import_tables": " UNION ALL ".join(imported_lines(table) for table in IMPORTS),
        "imported_penalties": f"""WITH wrong AS ({imported_lines("penalty")}), lines AS (
              SELECT LineNo, string_split(line, ',') AS f FROM raw_line
              WHERE table_name = 'penalty' AND CAST(LineNo AS VARCHAR) NOT IN (SELECT row_key FROM wrong))
            SELECT {", ".join(f"CAST(nullif(trim(f[{i}]), '') AS {kind}) AS {column}"
                              for i, (column, kind, _, _) in enumerate(IMPORTS["penalty"], start=1))} FROM lines""",
        "rules_portal_registration": """WITH c AS (
            SELECT k.CandidateID, trim(k.StudentID) AS sid, lower(trim(k.Email)) AS mail, k.*, s.Status AS fs,
              lower(s.Email) AS fmail, s.FirstName AS ff, s.LastName AS fl, s.DateOfBirth AS fd, s.Gender AS fg
            FROM portal_candidate k LEFT JOIN student s ON s.StudentID = trim(k.StudentID)) """
        + " UNION ALL ".join(
            [
                candidate_rule("StudentID", "id_has_spaces", "sid LIKE '% %'"),
                candidate_rule("ProgramID", "program_not_in_faculty",
                               "EXISTS (SELECT 1 FROM academic_program p WHERE p.ProgramID = c.ProgramID AND p.FacultyID <> c.FacultyID)"),
                candidate_rule("Email", "email_has_account",
                               "EXISTS (SELECT 1 FROM system_user u WHERE lower(u.Email) = c.mail)"),
                candidate_rule("StudentID", "student_has_account",
                               "fs IS NOT NULL AND EXISTS (SELECT 1 FROM system_user u WHERE u.StudentID = c.sid)"),
                candidate_rule("StudentID", "student_not_active", "fs <> 'Active'"),
                candidate_rule("Email", "not_as_on_file", "fs IS NOT NULL AND mail IS DISTINCT FROM fmail"),
                candidate_rule("FirstName", "not_as_on_file", "fs IS NOT NULL AND FirstName IS DISTINCT FROM ff"),
                candidate_rule("LastName", "not_as_on_file", "fs IS NOT NULL AND LastName IS DISTINCT FROM fl"),
                candidate_rule("DateOfBirth", "not_as_on_file", "fs IS NOT NULL AND DateOfBirth IS DISTINCT FROM fd"),
                candidate_rule("Gender", "not_as_on_file", "fs IS NOT NULL AND Gender IS DISTINCT FROM fg"),
                candidate_rule("Email", "email_of_other_student",
                               "fs IS NULL AND EXISTS (SELECT 1 FROM student s WHERE lower(s.Email) = c.mail)"),
                candidate_rule("NationalIDOrPassport", "national_id_used",
                               "fs IS NULL AND EXISTS (SELECT 1 FROM student s WHERE s.NationalIDOrPassport = c.NationalIDOrPassport)"),
            ]
        ),
        "student_role": """SELECT RoleID, RoleName FROM role WHERE lower(RoleName) LIKE '%student%'
            ORDER BY CASE lower(RoleName) WHEN 'student resident' THEN 1 WHEN 'student' THEN 2 ELSE 3 END, RoleID LIMIT 1""",
        "application_checks": f"""WITH opened AS (SELECT * FROM academic_semester
              WHERE Status IN ('Upcoming', 'Active') AND EndDate >= {AS_OF} AND (Status = 'Active' OR (
                (RegistrationOpenDate IS NULL OR RegistrationOpenDate <= {AS_OF})
                AND (RegistrationCloseDate IS NULL OR RegistrationCloseDate >= {AS_OF}))))
            SELECT k.CandidateID, k.StudentID, k.SemesterID, coalesce(k.StartDate, m.StartDate) AS StartDate,
              coalesce(k.EndDate, m.EndDate) AS EndDate, k.GPA, {AS_OF} AS ApplicationDate, 'Pending' AS Status,
              5 AS Priority, CASE WHEN k.GPA < 0 OR k.GPA > 4 THEN 'gpa_out_of_range'
                WHEN k.SemesterID IS NOT NULL AND m.SemesterID IS NULL THEN 'semester_not_open'
                WHEN EXISTS (SELECT 1 FROM blacklist b WHERE b.StudentID = k.StudentID AND b.Status = 'Active'
                  AND (b.EndDate IS NULL OR b.EndDate > {AS_OF})) THEN 'blacklisted'
                WHEN k.EndDate < k.StartDate THEN 'end_before_start'
                WHEN k.SemesterID IS NULL AND (k.StartDate IS NULL OR k.EndDate IS NULL) THEN 'semester_or_dates'
                WHEN EXISTS (SELECT 1 FROM registration g WHERE g.StudentID = k.StudentID
                  AND g.SemesterID = k.SemesterID AND g.Status IN ('Pending', 'Approved', 'Waitlisted'))
                  THEN 'already_applied' END AS rule
            FROM application_candidate k LEFT JOIN opened m ON m.SemesterID = k.SemesterID""",
        "transfer_request_checks": f"""WITH {DESTINATIONS}, {CURRENT}
            SELECT k.CandidateID, k.StudentID, c.RoomID AS FromRoomID, k.ToRoomID, {AS_OF} AS RequestDate,
              'Pending' AS Status, CASE WHEN c.RoomID IS NULL THEN 'no_active_room'
                WHEN d.RoomID IS NULL OR k.ToRoomID = c.RoomID THEN 'not_a_destination'
                WHEN NOT (w.Status IN ('Available', 'Occupied') AND (CASE WHEN w.total > 0 THEN w.total - w.used
                  ELSE w.Capacity - coalesce(w.CurrentOccupancy, 0) END) > 0) THEN 'room_not_available'
                WHEN w.total > 0 AND w.free = 0 THEN 'no_free_bed'
                WHEN EXISTS (SELECT 1 FROM room_transfer x WHERE x.StudentID = k.StudentID AND x.FromRoomID = c.RoomID
                  AND x.ToRoomID = k.ToRoomID AND x.Status IN ('Pending', 'Approved')) THEN 'already_requested' END AS rule
            FROM transfer_candidate k LEFT JOIN stay c ON c.StudentID = k.StudentID
            LEFT JOIN student s ON s.StudentID = k.StudentID
            LEFT JOIN destinations d ON d.RoomID = k.ToRoomID AND d.Gender = s.Gender
            LEFT JOIN wide w ON w.RoomID = k.ToRoomID""",
        "cancel_requests": " UNION ALL ".join(
            [
                cancel("registration", "ApplicationID", "StudentID", "'Pending', 'Waitlisted'", "'ApprovalDate'"),
                cancel("room_transfer", "TransferID", "StudentID", "'Pending', 'Approved'", "'ApprovalDate'"),
                cancel("leave_permission", "PermissionID", "StudentID", "'Pending', 'Approved'", "'ApprovalDate'"),
                cancel("visitor_permission", "PermissionID", "StudentID", "'Pending', 'Approved'", "'ApprovalDate'"),
                cancel("lost_and_found_item", "ItemID", "ReportedBy", "'Open', 'Pending'", "NULL"),
                cancel("maintenance_request", "RequestID", "ReportedByStudentID", "'Open', 'In Progress'", "'ResolvedAt'"),
                cancel("complaint", "ComplaintID", "StudentID", "'Open', 'In Progress'", "'ClosedAt'"),
            ]
        ),
        "complaints_after_cancelling": """
            SELECT c.* EXCLUDE (Status, ClosedAt), CASE WHEN q.RowKey IS NOT NULL AND c.Status IN ('Open', 'In Progress')
                THEN 'Cancelled' ELSE c.Status END AS Status,
              CASE WHEN q.RowKey IS NOT NULL AND c.Status IN ('Open', 'In Progress')
                THEN TIMESTAMP '2024-01-15 12:00:00' ELSE c.ClosedAt END AS ClosedAt
            FROM complaint c LEFT JOIN cancel_request q
              ON q.Entity = 'complaint' AND q.RowKey = c.ComplaintID AND q.StudentID = c.StudentID""",
        "status_edits": f"""
            SELECT e.Entity, e.RowKey, e.NewStatus, CASE WHEN e.NewStatus = g.Status THEN 'unchanged'
              WHEN e.NewStatus = 'Approved' AND NOT EXISTS (SELECT 1 FROM room_assignment a
                WHERE a.ApplicationID = e.RowKey) THEN 'blocked_without_room' ELSE 'update' END AS Route
            FROM status_edit e JOIN registration g ON g.ApplicationID = e.RowKey WHERE e.Entity = 'registration'
            UNION ALL SELECT e.Entity, e.RowKey, e.NewStatus, CASE WHEN e.NewStatus = x.Status THEN 'unchanged'
              WHEN e.NewStatus = 'Completed' OR (e.NewStatus = 'Approved'
                AND (e.EffectiveMoveDate IS NULL OR e.EffectiveMoveDate <= {AS_OF})) THEN 'move_now' ELSE 'update' END
            FROM status_edit e JOIN room_transfer x ON x.TransferID = e.RowKey WHERE e.Entity = 'room_transfer'""",
        "announcement_marks": f"""WITH {NOTICES}, m AS (SELECT DISTINCT StudentID, AnnouncementID FROM read_mark)
            SELECT m.StudentID, m.AnnouncementID, CASE WHEN n.AnnouncementID IS NULL THEN 'not_active'
              WHEN r.IsRead IS NULL THEN 'created' WHEN r.IsRead THEN 'already_read' ELSE 'marked' END AS Outcome
            FROM m LEFT JOIN notices n ON n.AnnouncementID = m.AnnouncementID
            LEFT JOIN student_announcement r ON r.StudentID = m.StudentID AND r.AnnouncementID = m.AnnouncementID""",
        "receipts_after_marks": f"""WITH {NOTICES}, m AS (SELECT DISTINCT StudentID, AnnouncementID FROM read_mark
              WHERE AnnouncementID IN (SELECT AnnouncementID FROM notices))
            SELECT StudentID, AnnouncementID, bool_or(IsRead) AS IsRead FROM (
              SELECT StudentID, AnnouncementID, IsRead FROM student_announcement
              UNION ALL SELECT StudentID, AnnouncementID, true FROM m) v GROUP BY StudentID, AnnouncementID""",
        "notification_marks": """WITH m AS (SELECT DISTINCT StudentID, NotificationID FROM read_mark)
            SELECT m.StudentID, m.NotificationID, CASE WHEN n.IsRead IS NULL THEN 'not_found'
              WHEN n.IsRead THEN 'already_read' ELSE 'marked' END AS Outcome
            FROM m LEFT JOIN notification n ON n.NotificationID = m.NotificationID AND n.StudentID = m.StudentID""",
        "notifications_after_marks": """
            SELECT n.* EXCLUDE (IsRead, Status), n.IsRead OR EXISTS (SELECT 1 FROM read_mark m
                WHERE m.NotificationID = n.NotificationID AND m.StudentID = n.StudentID) AS IsRead,
              CASE WHEN NOT n.IsRead AND EXISTS (SELECT 1 FROM read_mark m
                WHERE m.NotificationID = n.NotificationID AND m.StudentID = n.StudentID) THEN 'Read' ELSE n.Status END AS Status
            FROM notification n""",
    }
