"""Oracle SQL for per-student snapshots, histories, nested lists and documents."""

from __future__ import annotations

from oracles.finance import BALANCES
from oracles.listings import CURRENT, NOTICES


def history(table: str, key: str, moment: str, row_id: str, ties: str = "", columns: str = "*") -> str:
    return f"""SELECT {columns}, row_number() OVER (PARTITION BY {key} ORDER BY {moment} DESC, {row_id} DESC{ties}) AS seq
        FROM {table} WHERE {key} IS NOT NULL"""


def top(table: str, key: str, order: str, k: int, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
        FROM {table} WHERE {where}) v WHERE rn <= {k}"""


def pages(parents: str, key: str, children: str, item: str) -> str:
    """Parents with pages of 100 child items; ``children`` numbers them as seq."""
    return f"""SELECT p.{key}, coalesce(c.Page, 0) AS Page, coalesce(c.Items, '[]') AS Items
        FROM (SELECT {key} FROM {parents}) p LEFT JOIN (
          SELECT {key}, (seq - 1) // 100 AS Page, CAST(to_json(list({item} ORDER BY seq)) AS VARCHAR) AS Items
          FROM ({children}) k GROUP BY 1, 2) c ON c.{key} = p.{key}"""


RECORDS = """
    firsts AS (SELECT StudentID, min(BlacklistID) AS ActiveBlacklistID FROM blacklist WHERE Status = 'Active' GROUP BY 1),
    incidents AS (SELECT StudentID, count(*) AS n FROM incident_report WHERE Status IN ('Open', 'Investigating')
                  AND StudentID IS NOT NULL GROUP BY 1),
    fines AS (SELECT StudentID, sum(Amount) AS amount, count(*) AS n FROM penalty
              WHERE Status IN ('Pending', 'Overdue') GROUP BY 1),
    records AS (SELECT s.StudentID, f.ActiveBlacklistID, coalesce(i.n, 0) AS OpenIncidents,
        CAST(coalesce(p.amount, 0) AS DECIMAL(20,2)) AS PendingPenaltyTotal, coalesce(p.n, 0) AS PendingPenaltyCount
      FROM student s LEFT JOIN firsts f ON f.StudentID = s.StudentID LEFT JOIN incidents i ON i.StudentID = s.StudentID
      LEFT JOIN fines p ON p.StudentID = s.StudentID)
"""


def oracles() -> dict[str, str]:
    ra = "SELECT ApplicationID, AssignmentID, RoomID, CheckInDate, Status FROM room_assignment"
    return {
        "records_snapshot": f"WITH {RECORDS} SELECT * FROM records",
        "dashboard_snapshot": f"""WITH {RECORDS}, {CURRENT}, {NOTICES}, {BALANCES},
            owed AS (SELECT StudentID, sum(BalanceDue) AS amount FROM balances GROUP BY 1),
            applied AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY StudentID
              ORDER BY ApplicationDate DESC, ApplicationID DESC) AS place FROM registration) v WHERE place = 1)
            SELECT d.StudentID, c.AssignmentID, c.RoomID,
              (SELECT count(*) FROM maintenance_request q WHERE q.ReportedByStudentID = d.StudentID
                AND q.Status IN ('Open', 'In Progress')) AS ActiveMaintenance,
              (SELECT count(*) FROM complaint q WHERE q.StudentID = d.StudentID
                AND q.Status IN ('Open', 'In Progress')) AS OpenComplaints,
              CAST(coalesce(o.amount, 0) AS DECIMAL(20,2)) AS UnpaidTotal,
              (SELECT count(*) FROM notices) - (SELECT count(*) FROM seen z WHERE z.StudentID = d.StudentID)
                AS UnreadAnnouncements,
              (SELECT count(*) FROM notes z WHERE z.StudentID = d.StudentID AND NOT z.IsRead) AS UnreadNotifications,
              g.ApplicationID AS LatestApplicationID, g.Status AS LatestApplicationStatus, d.ActiveBlacklistID,
              d.OpenIncidents, d.PendingPenaltyTotal, d.PendingPenaltyCount
            FROM records d LEFT JOIN stay c ON c.StudentID = d.StudentID LEFT JOIN owed o ON o.StudentID = d.StudentID
            LEFT JOIN applied g ON g.StudentID = d.StudentID""",
        "room_roster": """
            SELECT DISTINCT a.RoomID, a.StudentID, s.FirstName, s.LastName, f.Name AS FacultyName, p.Name AS ProgramName
            FROM room_assignment a JOIN student s USING (StudentID) LEFT JOIN faculty f USING (FacultyID)
            LEFT JOIN academic_program p ON p.ProgramID = s.ProgramID WHERE a.Status = 'Active'""",
        "roommate_counts": f"""WITH {CURRENT}
            SELECT c.StudentID, c.RoomID, count(DISTINCT o.StudentID) AS Roommates
            FROM stay c JOIN student me ON me.StudentID = c.StudentID
            LEFT JOIN (SELECT a.RoomID, a.StudentID FROM room_assignment a JOIN student USING (StudentID)
                       WHERE a.Status = 'Active') o
              ON o.RoomID = c.RoomID AND o.StudentID <> c.StudentID
            GROUP BY c.StudentID, c.RoomID""",
        "accommodation_accepted": """
            SELECT s.StudentID, EXISTS (SELECT 1 FROM room_assignment a WHERE a.StudentID = s.StudentID
              AND a.Status = 'Active') AS IsAccepted FROM student s""",
        "active_portal_accounts": """
            SELECT u.UserID, u.StudentID, u.Email, o.RoleName FROM system_user u JOIN role o USING (RoleID)
            JOIN student s ON s.StudentID = u.StudentID
            WHERE u.Status = 'Active' AND s.Status = 'Active' AND lower(o.RoleName) LIKE '%student%'""",
        "latest_application": top("registration", "StudentID", "ApplicationDate DESC, ApplicationID DESC", 1).replace(
            "SELECT * FROM (", "SELECT * EXCLUDE (rn) FROM (", 1
        ),
        "student_profiles": """
            SELECT s.StudentID, CAST(to_json({'student_id': s.StudentID, 'first_name': s.FirstName,
              'last_name': s.LastName, 'email': s.Email, 'gpa': CAST(s.GPA AS VARCHAR), 'status': s.Status,
              'faculty': f.Name, 'program': p.Name}) AS VARCHAR) AS Document
            FROM student s LEFT JOIN faculty f USING (FacultyID) LEFT JOIN academic_program p ON p.ProgramID = s.ProgramID""",
        "room_documents": f"""WITH {CURRENT}, housed AS (
              SELECT c.StudentID, {{'room': r.RoomNumber, 'building': b.BuildingName, 'floor': r.FloorNumber,
                'bed': d.BedNumber, 'status': c.Status, 'check_in_date': CAST(c.CheckInDate AS VARCHAR)}} AS assignment
              FROM stay c JOIN room r ON r.RoomID = c.RoomID JOIN building b ON b.BuildingID = r.BuildingID
              LEFT JOIN bed_slot d ON d.BedSlotID = c.BedSlotID)
            SELECT s.StudentID, CAST(to_json({{'assignment': h.assignment}}) AS VARCHAR) AS Document
            FROM student s LEFT JOIN housed h USING (StudentID)""",
        "request_documents": "SELECT StudentID, 'maintenance' AS Kind, Page, Items FROM ("
        + pages(
            "student",
            "StudentID",
            "SELECT ReportedByStudentID AS StudentID, * FROM ("
            + history("maintenance_request", "ReportedByStudentID", "ReportedAt", "RequestID")
            + ") m",
            """{'request_id': RequestID, 'title': Title, 'category': Category, 'priority': Priority, 'status': Status,
                'reported_at': strftime(ReportedAt, '%Y-%m-%d %H:%M:%S')}""",
        )
        + ") x UNION ALL SELECT StudentID, 'complaints' AS Kind, Page, Items FROM ("
        + pages(
            "student",
            "StudentID",
            history("complaint", "StudentID", "SubmittedAt", "ComplaintID"),
            """{'complaint_id': ComplaintID, 'subject': Subject, 'category': Category, 'priority': Priority,
                'status': Status, 'submitted_at': strftime(SubmittedAt, '%Y-%m-%d %H:%M:%S')}""",
        )
        + ") y",
        "announcement_documents": f"""WITH {NOTICES}
            SELECT n.AnnouncementID, CAST(to_json({{'announcement_id': n.AnnouncementID, 'title': n.Title, 'type': n.Type,
              'priority_level': n.PriorityLevel, 'publish_date': strftime(n.PublishDate, '%Y-%m-%dT%H:%M:%S')}})
              AS VARCHAR) AS Document,
              (SELECT count(*) FROM seen z WHERE z.AnnouncementID = n.AnnouncementID) AS Readers FROM notices n""",
        "top_announcements": f"""WITH {NOTICES}
            SELECT AnnouncementID, Title, PublishDate, PriorityLevel FROM notices
            ORDER BY PublishDate DESC, AnnouncementID DESC LIMIT 3""",
        "service_activity": f"""WITH {CURRENT},
            homes AS (SELECT c.StudentID, c.RoomID, r.BuildingID FROM stay c LEFT JOIN room r USING (RoomID)),
            shown AS (SELECT s.StudentID, count(v.ServiceID) AS n FROM student s LEFT JOIN homes h USING (StudentID)
              LEFT JOIN (SELECT * FROM dorm_service WHERE Status = 'Active') v
                ON h.RoomID IS NULL OR v.BuildingID IS NULL OR v.BuildingID = h.BuildingID GROUP BY 1),
            m1 AS (SELECT StudentID, count(*) AS n FROM meal_subscription GROUP BY 1),
            m2 AS (SELECT StudentID, count(*) AS n FROM meal_attendance GROUP BY 1),
            m3 AS (SELECT StudentID, count(*) AS n FROM laundry_usage GROUP BY 1),
            m4 AS (SELECT StudentID, count(*) AS n FROM access_log GROUP BY 1),
            m5 AS (SELECT ReportedBy AS StudentID, count(*) AS n FROM lost_and_found_item GROUP BY 1)
            SELECT s.StudentID, w.n AS Services, coalesce(m1.n, 0) AS MealSubscriptions,
              coalesce(m2.n, 0) AS RecentMeals, coalesce(m3.n, 0) AS RecentLaundry,
              coalesce(m4.n, 0) AS RecentAccess, coalesce(m5.n, 0) AS LostAndFound
            FROM student s LEFT JOIN shown w ON w.StudentID = s.StudentID LEFT JOIN m1 ON m1.StudentID = s.StudentID
            LEFT JOIN m2 ON m2.StudentID = s.StudentID LEFT JOIN m3 ON m3.StudentID = s.StudentID
            LEFT JOIN m4 ON m4.StudentID = s.StudentID LEFT JOIN m5 ON m5.StudentID = s.StudentID""",
        "history_payments": history(
            "payment_transaction", "StudentID", "PaymentDate", "TransactionID",
            ", PaymentAmount, PaymentStatus, InvoiceID",
            "TransactionID, InvoiceID, StudentID, PaymentAmount, PaymentDate, PaymentStatus",
        ),
        "history_penalties": history("penalty", "StudentID", "PenaltyDate", "PenaltyID"),
        "history_incidents": history("incident_report", "StudentID", "IncidentDate", "ReportID"),
        "history_leave": history("leave_permission", "StudentID", "RequestDate", "PermissionID"),
        "history_visitors": history(
            "(SELECT p.*, v.VisitorName FROM visitor_permission p LEFT JOIN "
            "(SELECT VisitorID, concat_ws(' ', FirstName, LastName) AS VisitorName FROM visitor) v USING (VisitorID)) z",
            "StudentID", "RequestDate", "PermissionID",
        ),
        "history_transfers": history("room_transfer", "StudentID", "RequestDate", "TransferID"),
        "history_applications": history("registration", "StudentID", "ApplicationDate", "ApplicationID"),
        "history_lost_and_found": history("lost_and_found_item", "ReportedBy", "ReportDate", "ItemID"),
        "history_meal_subscriptions": history("meal_subscription", "StudentID", "StartDate", "SubscriptionID"),
        "history_maintenance": history("maintenance_request", "ReportedByStudentID", "ReportedAt", "RequestID"),
        "history_complaints": history("complaint", "StudentID", "SubmittedAt", "ComplaintID"),
        "recent_meals": top("meal_attendance", "StudentID", "MealDate DESC, CheckInDateTime DESC, AttendanceID DESC", 10),
        "recent_laundry": f"""SELECT u.StudentID, u.rn, u.UsageID, u.UsageDate, u.Duration, b.BuildingName,
              v.Name AS ServiceName
            FROM ({top("laundry_usage", "StudentID", "UsageDate DESC, UsageID DESC", 10)}) u
            LEFT JOIN laundry l ON l.LaundryID = u.LaundryID LEFT JOIN building b ON b.BuildingID = l.BuildingID
            LEFT JOIN dorm_service v ON v.ServiceID = l.ServiceID""",
        "recent_access": f"""SELECT u.*, b.BuildingName
            FROM ({top("access_log", "StudentID", "LogTime DESC, LogID DESC", 10)}) u
            LEFT JOIN building b ON b.BuildingID = u.BuildingID""",
        "recent_inspections": top(
            "room_inspection", "RoomID",
            "InspectionDate DESC, InspectionID DESC, Status, FurnitureCondition, FollowUpRequired", 5,
        ),
        "latest_requests": top(
            "maintenance_request", "ReportedByStudentID", "ReportedAt DESC, RequestID DESC", 3,
            "ReportedByStudentID IS NOT NULL",
        ),
        "maintenance_logs_nested": pages(
            "maintenance_request", "RequestID", history("maintenance_log", "RequestID", "LoggedAt", "LogID"),
            "{'LogID': LogID, 'ActionTaken': ActionTaken, 'Cost': CAST(Cost AS VARCHAR)}",
        ),
        "application_assignments_nested": pages(
            "registration", "ApplicationID",
            f"""SELECT h.*, r.RoomNumber, b.BuildingName FROM (
                {history(f"({ra}) q", "ApplicationID", "CheckInDate", "AssignmentID")}) h
                LEFT JOIN room r ON r.RoomID = h.RoomID LEFT JOIN building b ON b.BuildingID = r.BuildingID""",
            """{'AssignmentID': AssignmentID, 'RoomNumber': RoomNumber, 'BuildingName': BuildingName,
                'CheckInDate': CAST(CheckInDate AS VARCHAR), 'Status': Status}""",
        ),
        "invoice_payments_nested": pages(
            "invoice", "InvoiceID",
            history("(SELECT * FROM payment_transaction WHERE PaymentStatus = 'Completed') q", "InvoiceID",
                    "PaymentDate", "TransactionID", ", PaymentAmount, StudentID"),
            """{'TransactionID': TransactionID, 'PaymentDate': CAST(PaymentDate AS VARCHAR),
                'PaymentAmount': CAST(PaymentAmount AS VARCHAR)}""",
        ),
        "programs_by_faculty": pages(
            "(SELECT DISTINCT FacultyID FROM academic_program WHERE Status = 'Active') f", "FacultyID",
            """SELECT FacultyID, ProgramID, Name, row_number() OVER (PARTITION BY FacultyID ORDER BY Name, ProgramID) AS seq
               FROM academic_program WHERE Status = 'Active'""",
            "{'id': CAST(ProgramID AS VARCHAR), 'name': Name}",
        ),
    }
