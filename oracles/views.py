"""Oracle SQL for dashboard metrics and reporting views."""

from __future__ import annotations

from oracles.checks import KEYS
from oracles.listings import AS_OF, ASSIGNABLE, BEDS

DAY = "DATE '2024-01-15'"


def metrics(pairs: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{name}' AS metric, ({body}) AS n" for name, body in pairs.items())


def oracles() -> dict[str, str]:
    return {
        "dashboard_kpis": f"""WITH {ASSIGNABLE}
            SELECT 'Active Students' AS metric, CAST((SELECT count(*) FROM student WHERE Status = 'Active') AS VARCHAR) AS value
            UNION ALL SELECT 'Available Rooms', CAST((SELECT count(DISTINCT RoomID) FROM assignable) AS VARCHAR)
            UNION ALL SELECT 'Open Maintenance', CAST((SELECT count(*) FROM maintenance_request
              WHERE Status IN ('Open', 'In Progress')) AS VARCHAR)
            UNION ALL SELECT 'Occupancy', CAST(CAST(round_even(100.0 * (SELECT count(*) FROM room_assignment
              WHERE Status = 'Active') / (SELECT count(*) FROM bed_slot), 0) AS BIGINT) AS VARCHAR) || '%'""",
        "capacity": """SELECT (SELECT count(*) FROM room_assignment WHERE Status = 'Active') AS ActiveAssignments,
              (SELECT count(*) FROM bed_slot) AS TotalCapacity,
              (SELECT count(*) FROM bed_slot WHERE NOT IsOccupied AND NOT IsReserved) AS AvailableBeds,
              'physical bed slots' AS CapacityKind""",
        "priority_queues": metrics(
            {
                "Pending housing applications": "SELECT count(*) FROM registration WHERE Status IN ('Pending', 'Waitlisted')",
                "Approved applications awaiting assignment": f"SELECT count(*) FROM ({KEYS['approved_without_assignment']}) v",
                "Overdue invoices": "SELECT count(*) FROM invoice WHERE PaymentStatus = 'Overdue'",
                "Critical maintenance": """SELECT count(*) FROM maintenance_request
                    WHERE Priority = 'Critical' AND Status NOT IN ('Closed', 'Cancelled')""",
                "Open complaints": "SELECT count(*) FROM complaint WHERE Status IN ('Open', 'In Progress')",
                "Pending leave permissions": "SELECT count(*) FROM leave_permission WHERE Status = 'Pending'",
                "Pending visitor approvals": "SELECT count(*) FROM visitor_permission WHERE Status = 'Pending'",
                "Active students without portal account": f"""SELECT count(*)
                    FROM ({KEYS['active_students_without_portal_account']}) v""",
            }
        ),
        "activity_metrics": metrics(
            {
                "Available bed slots": "SELECT count(*) FROM bed_slot WHERE NOT IsOccupied AND NOT IsReserved",
                "Actionable inspections": "SELECT count(*) FROM room_inspection WHERE Status = 'Failed' OR FollowUpRequired",
                "Expiring contracts": f"""SELECT count(*) FROM room_assignment WHERE Status = 'Active'
                    AND CheckOutDate BETWEEN {AS_OF} AND {AS_OF} + 30""",
                "Active blacklist": f"""SELECT count(*) FROM blacklist WHERE Status = 'Active'
                    AND (EndDate IS NULL OR EndDate >= {AS_OF})""",
                "Recent payments": f"SELECT count(*) FROM payment_transaction WHERE PaymentDate >= {AS_OF} - 30",
                "Meal check-ins": f"SELECT count(*) FROM meal_attendance WHERE MealDate = {AS_OF}",
            }
        ),
        "activity_metrics_on_a_meal_day": metrics(
            {
                "Available bed slots": "SELECT count(*) FROM bed_slot WHERE NOT IsOccupied AND NOT IsReserved",
                "Actionable inspections": "SELECT count(*) FROM room_inspection WHERE Status = 'Failed' OR FollowUpRequired",
                "Expiring contracts": """SELECT count(*) FROM room_assignment WHERE Status = 'Active'
                    AND CheckOutDate BETWEEN DATE '2024-01-15' AND DATE '2024-01-15' + 30""",
                "Active blacklist": """SELECT count(*) FROM blacklist WHERE Status = 'Active'
                    AND (EndDate IS NULL OR EndDate >= DATE '2024-01-15')""",
                "Recent payments": "SELECT count(*) FROM payment_transaction WHERE PaymentDate >= DATE '2024-01-15' - 30",
                "Meal check-ins": "SELECT count(*) FROM meal_attendance WHERE MealDate = DATE '2024-01-15'",
            }
        ),
        "view_student_directory": """
            SELECT s.StudentID, s.FirstName || ' ' || s.LastName AS StudentName, s.Email, s.Status,
              f.Name AS FacultyName, p.Name AS ProgramName
            FROM student s LEFT JOIN faculty f USING (FacultyID) LEFT JOIN academic_program p ON p.ProgramID = s.ProgramID""",
        "view_room_occupancy": f"""WITH {BEDS}
            SELECT RoomID, BuildingName, RoomNumber, Capacity, CurrentOccupancy, total AS TotalBeds,
              CAST(CASE WHEN total > 0 THEN total - used ELSE greatest(Capacity - coalesce(CurrentOccupancy, 0), 0) END
                AS BIGINT) AS AvailableBeds FROM wide""",
        "view_building_capacity": """
            SELECT b.BuildingID, b.BuildingName, count(r.RoomID) AS Rooms,
              CAST(coalesce(sum(r.Capacity), 0) AS BIGINT) AS ConfiguredCapacity,
              CAST(coalesce(sum(d.n), 0) AS BIGINT) AS Beds, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS ActiveAssignments,
              CAST(coalesce(sum(greatest(r.Capacity - coalesce(a.n, 0), 0)), 0) AS BIGINT) AS FreeCapacity
            FROM building b LEFT JOIN room r USING (BuildingID)
            LEFT JOIN (SELECT RoomID, count(*) AS n FROM bed_slot GROUP BY 1) d ON d.RoomID = r.RoomID
            LEFT JOIN (SELECT RoomID, count(*) AS n FROM room_assignment WHERE Status = 'Active' GROUP BY 1) a
              ON a.RoomID = r.RoomID
            GROUP BY b.BuildingID, b.BuildingName""",
        "view_available_beds": """
            SELECT d.BedSlotID, d.RoomID, r.BuildingID, d.BedNumber FROM bed_slot d JOIN room r USING (RoomID)
            JOIN building b USING (BuildingID) WHERE NOT d.IsOccupied AND NOT d.IsReserved
              AND r.Status IN ('Available', 'Occupied') AND b.Status = 'Active'""",
        "view_actionable_inspections": """SELECT InspectionID, RoomID, InspectionDate, Status, FollowUpRequired
            FROM room_inspection WHERE Status = 'Failed' OR FollowUpRequired""",
        "view_active_maintenance": """
            SELECT q.RequestID, q.Title, q.Priority, q.Status, q.ReportedAt, r.RoomNumber, b.BuildingName,
              q.ReportedByStudentID, s.FirstName || ' ' || s.LastName AS ReporterName
            FROM maintenance_request q LEFT JOIN room r USING (RoomID) LEFT JOIN building b USING (BuildingID)
            LEFT JOIN student s ON s.StudentID = q.ReportedByStudentID
            WHERE q.Status IN ('Open', 'In Progress')""",
        "view_expiring_contracts": f"""
            SELECT AssignmentID, StudentID, RoomID, CheckOutDate,
              CAST(date_diff('day', {AS_OF}, CheckOutDate) AS BIGINT) AS DaysLeft
            FROM room_assignment WHERE Status = 'Active' AND CheckOutDate BETWEEN {AS_OF} AND {AS_OF} + 30""",
        "view_active_blacklist": f"""
            SELECT k.BlacklistID, k.StudentID, s.FirstName || ' ' || s.LastName AS StudentName, k.StartDate, k.EndDate
            FROM blacklist k LEFT JOIN student s USING (StudentID)
            WHERE k.Status = 'Active' AND (k.EndDate IS NULL OR k.EndDate >= {AS_OF})""",
        "view_daily_meals": f"""
            SELECT MealDate, MealType, count(*) FILTER (WHERE AttendanceStatus = 'Present') AS Present,
              count(*) FILTER (WHERE AttendanceStatus = 'Absent') AS Absent,
              count(*) FILTER (WHERE AttendanceStatus = 'Late') AS Late, count(*) AS Total
            FROM meal_attendance WHERE MealDate = {DAY} GROUP BY MealDate, MealType""",
        "view_active_leave": f"""SELECT PermissionID, StudentID, StartDate, EndDate FROM leave_permission
            WHERE Status = 'Approved' AND StartDate <= {AS_OF} AND EndDate >= {AS_OF}""",
        "view_maintenance_kpis": """
            SELECT CAST(date_trunc('month', ReportedAt) AS DATE) AS Month, count(*) AS Requests, count(ResolvedAt) AS Resolved,
              count(*) FILTER (WHERE Status IN ('Open', 'In Progress')) AS OpenNow,
              round(avg(epoch(ResolvedAt - ReportedAt) / 3600.0), 2) AS AvgResolutionHours
            FROM maintenance_request GROUP BY 1""",
    }
