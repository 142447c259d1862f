"""Oracle SQL for facts, queues, room listings and notices."""

from __future__ import annotations

from oracles.checks import KEYS as CHECKS

AS_OF = "DATE '1998-06-30'"
NOW = "TIMESTAMP '2024-01-15 12:00:00'"

CURRENT = """
    stays AS (SELECT *, row_number() OVER (PARTITION BY StudentID ORDER BY CheckInDate DESC, AssignmentID DESC) AS place
              FROM room_assignment WHERE Status = 'Active'),
    stay AS (SELECT * FROM stays WHERE place = 1)
"""
BEDS = """
    beds AS (SELECT RoomID, count(*) AS total, count(*) FILTER (WHERE NOT IsOccupied AND NOT IsReserved) AS free,
               count(*) FILTER (WHERE IsOccupied) AS used FROM bed_slot GROUP BY RoomID),
    wide AS (SELECT r.*, b.BuildingName, b.BuildingCode, b.Status AS BuildingStatus, b.GenderAllowed,
               y.Name AS RoomTypeName, y.BasePrice AS MonthlyRent, y.SecurityDeposit AS DepositAmount,
               coalesce(d.total, 0) AS total, coalesce(d.free, 0) AS free, coalesce(d.used, 0) AS used
             FROM room r JOIN building b USING (BuildingID) LEFT JOIN room_type y USING (RoomTypeID)
             LEFT JOIN beds d ON d.RoomID = r.RoomID),
    sexes AS (SELECT * FROM (VALUES ('Male'), ('Female')) AS x(Gender)),
    opened AS (SELECT x.Gender, w.* FROM wide w JOIN sexes x ON w.GenderAllowed IN ('Mixed', x.Gender)
               WHERE w.BuildingStatus = 'Active' AND w.Status IN ('Available', 'Occupied'))
"""
ASSIGNABLE = f"""{BEDS}, assignable AS (SELECT * FROM opened
    WHERE coalesce(CurrentOccupancy, 0) < Capacity AND (total = 0 OR free > 0))"""
AVAILABLE = f"""{BEDS}, available AS (SELECT * FROM opened
    WHERE (total = 0 AND (CurrentOccupancy IS NULL OR CurrentOccupancy < Capacity)) OR free > 0)"""
DESTINATIONS = f"""{BEDS}, destinations AS (SELECT * FROM opened
    WHERE (CurrentOccupancy IS NULL OR CurrentOccupancy < Capacity) AND (total = 0 OR free > 0))"""
NOTICES = f"""
    notices AS (SELECT * FROM announcement WHERE Status = 'Published' AND PublishDate <= {NOW}
                AND (ExpiryDate IS NULL OR ExpiryDate >= {NOW})),
    seen AS (SELECT StudentID, AnnouncementID FROM student_announcement
             WHERE IsRead AND AnnouncementID IN (SELECT AnnouncementID FROM notices)),
    notes AS (SELECT * FROM notification WHERE PublishDate <= {NOW} AND (ExpiryDate IS NULL OR ExpiryDate >= {NOW})
              AND Status <> 'Failed')
"""


def oracles() -> dict[str, str]:
    return {
        "current_assignment": f"WITH {CURRENT} SELECT * EXCLUDE (place) FROM stay",
        "active_per_room": "SELECT RoomID, count(*) AS ActiveCount FROM room_assignment WHERE Status = 'Active' GROUP BY RoomID",
        "active_per_bed": """SELECT BedSlotID, count(*) AS ActiveCount FROM room_assignment
            WHERE Status = 'Active' AND BedSlotID IS NOT NULL GROUP BY BedSlotID""",
        "bed_counts": """SELECT RoomID, count(*) AS TotalBeds,
              count(DISTINCT CASE WHEN NOT IsOccupied AND NOT IsReserved THEN BedSlotID END) AS FreeBeds,
              count(DISTINCT CASE WHEN IsOccupied THEN BedSlotID END) AS OccupiedBeds
            FROM bed_slot GROUP BY RoomID""",
        "latest_inspection": """
            SELECT RoomID, InspectionID, InspectionDate, FurnitureCondition FROM (
              SELECT *, row_number() OVER (PARTITION BY RoomID
                ORDER BY InspectionDate DESC, InspectionID DESC, FurnitureCondition) AS place
              FROM room_inspection WHERE Status = 'Completed') v WHERE place = 1""",
        "last_maintenance": """
            SELECT r.BuildingID, max(CAST(q.ResolvedAt AS DATE)) AS LastMaintenanceDate
            FROM maintenance_request q JOIN room r USING (RoomID)
            WHERE q.Status IN ('Resolved', 'Closed') AND q.ResolvedAt IS NOT NULL GROUP BY r.BuildingID""",
        "application_queue": """
            SELECT g.ApplicationID, g.StudentID, s.FirstName || ' ' || s.LastName AS StudentName, s.Gender, s.Email,
              g.Status, g.ApplicationDate, g.StartDate, g.EndDate, m.Name AS SemesterName, m.AcademicYear,
              s.PhoneNumber, s.City, s.Country, g.Priority, s.GPA,
              coalesce(nullif(concat_ws(' / ', m.Name, m.AcademicYear), ''), '—') AS SemesterText,
              coalesce(nullif(concat_ws(' → ', CAST(g.StartDate AS VARCHAR), CAST(g.EndDate AS VARCHAR)), ''), '—')
                AS RequestedDates,
              coalesce(nullif(concat_ws(', ', s.PhoneNumber, s.City, s.Country), ''), s.Email, '—') AS Contact
            FROM registration g JOIN student s USING (StudentID) LEFT JOIN academic_semester m USING (SemesterID)
            LEFT JOIN room_assignment a ON a.ApplicationID = g.ApplicationID
            WHERE g.Status IN ('Pending', 'Waitlisted', 'Approved') AND a.AssignmentID IS NULL""",
        "transfer_queue": """
            SELECT x.TransferID, x.StudentID, s.FirstName || ' ' || s.LastName AS StudentName, x.FromRoomID,
              f.RoomNumber AS FromRoomNumber, fb.BuildingName AS FromBuildingName, x.ToRoomID,
              o.RoomNumber AS ToRoomNumber, ob.BuildingName AS ToBuildingName, x.RequestDate, x.EffectiveMoveDate,
              x.Status, x.PriorityLevel, x.Reason,
              concat_ws(' / ', CAST(x.RequestDate AS VARCHAR), CAST(x.EffectiveMoveDate AS VARCHAR)) AS MoveText
            FROM room_transfer x JOIN student s USING (StudentID)
            JOIN room f ON f.RoomID = x.FromRoomID JOIN building fb ON fb.BuildingID = f.BuildingID
            JOIN room o ON o.RoomID = x.ToRoomID JOIN building ob ON ob.BuildingID = o.BuildingID
            WHERE x.Status IN ('Pending', 'Approved')""",
        "assignable_rooms": f"""WITH {ASSIGNABLE}
            SELECT Gender, RoomID, RoomNumber, FloorNumber, Capacity, coalesce(CurrentOccupancy, 0) AS CurrentOccupancy,
              MonthlyRent, DepositAmount, BuildingName, BuildingCode, RoomTypeName FROM assignable""",
        "assignable_room_counts": f"""WITH {ASSIGNABLE}
            SELECT s.StudentID, count(a.RoomID) AS AssignableRooms
            FROM student s LEFT JOIN (SELECT Gender, RoomID FROM assignable) a USING (Gender) GROUP BY s.StudentID""",
        "available_rooms": f"""WITH {AVAILABLE}
            SELECT Gender, RoomID, BuildingName, RoomNumber, RoomTypeName, total AS TotalBeds, free AS FreeBeds
            FROM available""",
        "available_room_counts": f"""WITH {AVAILABLE}
            SELECT s.StudentID, count(a.RoomID) AS AvailableRooms
            FROM student s LEFT JOIN (SELECT Gender, RoomID FROM available) a USING (Gender) GROUP BY s.StudentID""",
        "transfer_destinations": f"""WITH {DESTINATIONS}
            SELECT Gender, RoomID, BuildingName, RoomNumber, RoomTypeName FROM destinations""",
        "transfer_destination_counts": f"""WITH {DESTINATIONS}, {CURRENT},
            per AS (SELECT Gender, count(*) AS n FROM destinations GROUP BY Gender)
            SELECT c.StudentID, c.RoomID AS FromRoomID, coalesce(p.n, 0)
              - (CASE WHEN d.RoomID IS NULL THEN 0 ELSE 1 END) AS Destinations
            FROM stay c JOIN student s USING (StudentID) LEFT JOIN per p ON p.Gender = s.Gender
            LEFT JOIN destinations d ON d.RoomID = c.RoomID AND d.Gender = s.Gender""",
        "room_catalog": f"""WITH {BEDS}, seats AS (SELECT x.Gender, w.*,
              CASE WHEN total > 0 THEN greatest(total - used, 0)
                ELSE greatest(Capacity - coalesce(CurrentOccupancy, 0), 0) END AS left_over
              FROM wide w CROSS JOIN sexes x),
            labelled AS (SELECT *, CASE WHEN BuildingStatus <> 'Active' THEN 'Building unavailable'
              WHEN GenderAllowed NOT IN ('Mixed', Gender) THEN 'Building restricted'
              WHEN Status NOT IN ('Available', 'Occupied') THEN 'Unavailable' WHEN left_over < 1 THEN 'Full'
              WHEN total > 0 AND free = 0 THEN 'No free bed slot' ELSE 'Can request' END AS PortalLabel FROM seats)
            SELECT Gender, RoomID, BuildingName, RoomNumber, RoomTypeName, CAST(left_over AS BIGINT) AS AvailableBeds,
              PortalLabel, PortalLabel = 'Can request' AS CanRequest FROM labelled""",
        "available_beds": """SELECT RoomID, BedSlotID, BedNumber, BedPosition, BedType FROM bed_slot
            WHERE NOT IsOccupied AND NOT IsReserved""",
        "due_transfers": f"""
            SELECT TransferID, StudentID, FromRoomID, ToRoomID, ApprovalDate, EffectiveMoveDate FROM room_transfer
            WHERE TransferID IN ({CHECKS["approved_transfers_due_without_move"]})""",
        "active_announcements": f"WITH {NOTICES} SELECT * FROM notices",
        "read_announcements": f"WITH {NOTICES} SELECT * FROM seen",
        "active_notifications": f"""WITH {NOTICES}
            SELECT StudentID, NotificationID, Title, IsRead, PublishDate, ExpiryDate, Status FROM notes""",
        "unread_counts": f"""WITH {NOTICES},
            unread AS (SELECT StudentID, count(*) AS n FROM notes WHERE NOT IsRead GROUP BY StudentID),
            done AS (SELECT StudentID, count(*) AS n FROM seen GROUP BY StudentID)
            SELECT s.StudentID, (SELECT count(*) FROM notices) - coalesce(d.n, 0) AS UnreadAnnouncements,
              coalesce(u.n, 0) AS UnreadNotifications,
              (SELECT count(*) FROM notices) - coalesce(d.n, 0) + coalesce(u.n, 0) AS UnreadTotal
            FROM student s LEFT JOIN unread u USING (StudentID) LEFT JOIN done d ON d.StudentID = s.StudentID""",
        "open_semesters": f"""SELECT * FROM academic_semester
            WHERE Status IN ('Upcoming', 'Active') AND EndDate >= {AS_OF} AND (Status = 'Active' OR (
              (RegistrationOpenDate IS NULL OR RegistrationOpenDate <= {AS_OF})
              AND (RegistrationCloseDate IS NULL OR RegistrationCloseDate >= {AS_OF})))""",
        "service_audience": f"""WITH {CURRENT}, homes AS (
              SELECT c.StudentID, r.BuildingID FROM stay c LEFT JOIN room r USING (RoomID))
            SELECT v.ServiceID, v.Name, v.BuildingID,
              (SELECT count(*) FROM homes h WHERE v.BuildingID IS NULL OR h.BuildingID = v.BuildingID) AS Residents
            FROM dorm_service v WHERE v.Status = 'Active'""",
        "visible_service_counts": f"""WITH {CURRENT}, homes AS (
              SELECT c.StudentID, c.RoomID, r.BuildingID FROM stay c LEFT JOIN room r USING (RoomID))
            SELECT s.StudentID, any_value(h.BuildingID) AS BuildingID, count(v.ServiceID) AS VisibleServices
            FROM student s LEFT JOIN homes h USING (StudentID)
            LEFT JOIN (SELECT * FROM dorm_service WHERE Status = 'Active') v
              ON h.RoomID IS NULL OR v.BuildingID IS NULL OR v.BuildingID = h.BuildingID
            GROUP BY s.StudentID""",
    }
