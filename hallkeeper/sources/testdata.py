"""The housing tables as projections of the star-schema test data.

Each projection is one deterministic SELECT in the SQL that Spark and the
oracle engine share. Placeholders in braces name the base tables; ``{ts}`` is
the zone-free timestamp literal keyword and ``{beds}`` the row generator that
gives each room ``1 + p_size % 4`` beds.
"""

from __future__ import annotations

import datetime as dt
import functools
import zlib

from pyspark.sql import DataFrame, SparkSession

from hallkeeper.tables import Tables

AS_OF = dt.date(1998, 6, 30)
"""Reference date for housing and finance data."""

NOW = dt.datetime(2024, 1, 15, 12, 0, 0)
"""Reference moment for event-based data."""

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SPARK_WORDS = {
    "ts": "TIMESTAMP_NTZ",
    "beds": "LATERAL VIEW explode(sequence(1, 1 + p_size % 4)) v AS i",
}

PROJECTIONS: dict[str, str] = {
    "building": """
SELECT CAST(n_nationkey AS INT) AS BuildingID, concat('B', CAST(n_nationkey AS STRING)) AS BuildingCode, n_name AS BuildingName
  , CASE WHEN n_nationkey % 8 = 7 THEN 'Under Maintenance' ELSE 'Active' END AS Status, CASE n_nationkey % 3 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'Male' ELSE 'Female' END AS GenderAllowed
  , CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE DATE '2024-01-15' END AS LastMaintenanceDate
FROM {nation}
""",
    "room_type": """
SELECT CAST(r_regionkey AS INT) AS RoomTypeID, r_name AS Name, CAST(1000 + 500 * r_regionkey AS DECIMAL(10,2)) AS BasePrice
  , CASE WHEN r_regionkey = 4 THEN NULL ELSE CAST(500 + 100 * r_regionkey AS DECIMAL(10,2)) END AS SecurityDeposit
  , CAST(1 + r_regionkey % 4 AS INT) AS Capacity
FROM {region}
""",
    "room": """
SELECT p_partkey AS RoomID, CAST(p_partkey % 25 AS INT) AS BuildingID, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS RoomTypeID, concat('R'
  , CAST(p_partkey AS STRING)) AS RoomNumber, CAST(p_partkey % 6 AS INT) AS FloorNumber, CAST(1 + p_size % 4 AS INT) AS Capacity
  , CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size % 5 AS INT) END AS CurrentOccupancy, CASE WHEN p_partkey % 10 = 9 THEN 'Maintenance' WHEN p_partkey % 10 = 8 THEN 'Reserved' WHEN p_size % 2 = 0 THEN 'Available' ELSE 'Occupied' END AS Status
  , CASE p_size % 4 WHEN 0 THEN 'Excellent' WHEN 1 THEN 'Good' WHEN 2 THEN 'Fair' ELSE 'Poor' END AS FurnitureCondition,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE DATE '2001-06-01' END AS LastInspectionDate
FROM {part}
""",
    "bed_slot": """
SELECT p_partkey * 10 + v.i AS BedSlotID, CASE WHEN p_partkey % 97 = 5 THEN -p_partkey ELSE p_partkey END AS RoomID, CAST(v.i AS STRING) AS BedNumber, (p_partkey + v.i) % 3 = 0 AS IsOccupied, (p_partkey + v.i) % 7 = 0 AS IsReserved
  , CASE WHEN v.i % 2 = 0 THEN 'Upper' END AS BedPosition, 'Single' AS BedType
FROM {part} {beds}
WHERE p_partkey % 3 <> 0
""",
    "student": """
SELECT CAST(c_custkey AS STRING) AS StudentID, 'Student' AS FirstName, c_name AS LastName, concat('s', CAST(c_custkey AS STRING), '@example.org') AS Email
  , CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Inactive' WHEN 'AUTOMOBILE' THEN 'Graduated' ELSE 'Active' END AS Status
  , CAST((c_custkey % 400) / 100.0 AS DECIMAL(4,2)) AS GPA, CAST(c_nationkey AS INT) AS ProgramID
  , CAST(c_nationkey % 5 AS INT) AS FacultyID
  , CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('+20', CAST(c_custkey AS STRING)) END AS PhoneNumber
  , CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS City, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE 'Egypt' END AS Country
  , CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('N', CAST(c_custkey AS STRING)) END AS NationalIDOrPassport
  , DATE '1980-01-01' + CAST(c_custkey % 3650 AS INT) AS DateOfBirth
  , CASE WHEN c_acctbal < -500 THEN 'Warning' ELSE 'Clear' END AS DisciplinaryStatus
FROM {customer}
""",
    "registration": """
SELECT o_orderkey AS ApplicationID, CAST(o_custkey AS STRING) AS StudentID, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS SemesterID
  , CAST(substring(o_orderpriority, 1, 1) AS INT) AS Priority, CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Waitlisted' WHEN 2 THEN 'Approved' WHEN 3 THEN 'Rejected' ELSE 'Cancelled' END AS Status
  , CAST(o_orderdate AS DATE) AS ApplicationDate, CASE WHEN o_orderkey % 5 >= 2 AND o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 10 END AS ApprovalDate
  , CAST(o_orderdate AS DATE) + 30 AS StartDate, CAST(o_orderdate AS DATE) + 150 AS EndDate
FROM {orders}
""",
    "room_assignment": """
SELECT o_orderkey AS AssignmentID, CAST(CASE WHEN o_orderkey % 50 = 3 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS StudentID
  , CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) AS RoomID, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) * 10 + 1 END AS BedSlotID
  , CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS ApplicationID, CAST(o_orderdate AS DATE) AS CheckInDate
  , CAST(o_orderdate AS DATE) + 120 AS CheckOutDate, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 9 = 0 THEN -5 ELSE 90 END END AS ActualCheckOutDate
  , CASE o_orderkey % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'Completed' WHEN 2 THEN 'Cancelled' ELSE 'Pending' END AS Status
  , CASE WHEN o_orderkey % 2 = 0 THEN 'Semester' ELSE 'Year' END AS ContractDuration
FROM {orders}
UNION ALL SELECT 10000000 + o_orderkey, CAST(o_custkey AS STRING), (CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) + 1) % (SELECT count(*)
FROM {part}), NULL, NULL, CASE WHEN o_orderkey % 32 = 1 THEN CAST(o_orderdate AS DATE) - 14 ELSE CAST(o_orderdate AS DATE) + 14 END
  , CAST(o_orderdate AS DATE) + 150, NULL, 'Active', 'Semester'
FROM {orders}
WHERE o_orderkey % 16 = 9 OR o_orderkey % 32 = 8 OR o_orderkey % 32 = 1
""",
    "occupancy_log": """
SELECT o_orderkey AS LogID, CAST(o_custkey AS STRING) AS StudentID, CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) AS RoomID, o_orderkey AS AssignmentID
  , CAST(o_orderdate AS DATE) AS StartDate, CASE WHEN o_orderkey % 8 = 1 THEN CAST(o_orderdate AS DATE) + 90 END AS EndDate
FROM {orders}
WHERE o_orderkey % 12 <> 0
""",
    "room_transfer": """
SELECT o_orderkey AS TransferID, CAST(o_custkey AS STRING) AS StudentID, CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) AS FromRoomID, (CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) + 1) % (SELECT count(*)
FROM {part}) AS ToRoomID, CAST(o_orderdate AS DATE) AS RequestDate, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 16 = 1 THEN CAST(o_orderdate AS DATE) - 14 ELSE CAST(o_orderdate AS DATE) + 14 END AS EffectiveMoveDate
  , CASE o_orderkey % 8 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Completed' WHEN 4 THEN 'Pending' ELSE 'Rejected' END AS Status
  , CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 7 END AS ApprovalDate, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Normal' ELSE 'Low' END AS PriorityLevel
  , CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Closer to campus' END AS Reason
FROM {orders}
WHERE o_orderkey % 2 = 0 OR o_orderkey % 8 = 1
""",
    "invoice": """
SELECT o_orderkey AS InvoiceID, CAST(o_custkey AS STRING) AS StudentID, CAST(o_totalprice AS DECIMAL(10,2)) AS TotalAmount
  , CAST(o_orderkey % 50 AS DECIMAL(10,2)) AS TaxAmount, CAST(o_orderkey % 20 AS DECIMAL(10,2)) AS DiscountAmount, CAST(o_orderkey % 10 AS DECIMAL(10,2)) AS LateFee
  , CAST(o_orderdate AS DATE) + 30 AS DueDate, CASE WHEN o_orderkey % 17 = 0 THEN 'Cancelled' WHEN o_orderstatus = 'F' THEN 'Paid' WHEN o_orderstatus = 'P' THEN 'Partial' WHEN o_orderkey % 2 = 0 THEN 'Overdue' ELSE 'Unpaid' END AS PaymentStatus
  , CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 100 = 53 THEN o_orderkey + 1 ELSE o_orderkey END AS AssignmentID
  , CASE o_orderkey % 3 WHEN 0 THEN 'Rent' WHEN 1 THEN 'Deposit' ELSE 'Service' END AS InvoiceType
FROM {orders}
""",
    "payment_transaction": """
SELECT l_orderkey * 10 + l_linenumber AS TransactionID, l_orderkey AS InvoiceID, CAST(CASE WHEN l_orderkey % 40 = 7 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS StudentID
  , CAST(l_extendedprice AS DECIMAL(10,2)) AS PaymentAmount, CAST(l_shipdate AS DATE) AS PaymentDate, CASE l_returnflag WHEN 'A' THEN 'Completed' WHEN 'N' THEN 'Pending' ELSE 'Refunded' END AS PaymentStatus
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
""",
    "room_inspection": """
SELECT l_orderkey * 10 + l_linenumber AS InspectionID, l_partkey AS RoomID, CAST(l_shipdate AS DATE) AS InspectionDate, CASE WHEN l_linestatus = 'F' THEN 'Completed' WHEN l_returnflag = 'R' THEN 'Failed' ELSE 'Scheduled' END AS Status
  , CASE l_returnflag WHEN 'A' THEN 'Good' WHEN 'N' THEN 'Fair' ELSE 'Poor' END AS FurnitureCondition, l_quantity > 45 AS FollowUpRequired
FROM {lineitem}
""",
    "maintenance_request": """
SELECT event_id AS RequestID, event_id % (SELECT count(*)
FROM {part}) AS RoomID, CAST(user_id AS STRING) AS ReportedByStudentID, concat('Request ', CAST(event_id AS STRING)) AS Title
  , CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS Priority, CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' WHEN 3 THEN 'Closed' ELSE 'Cancelled' END AS Status, ts AS ReportedAt
  , CASE WHEN event_id % 5 IN (2, 3) AND event_id % 7 <> 0 THEN ts + INTERVAL 36 HOUR END AS ResolvedAt
  , CASE event_id % 3 WHEN 0 THEN 'Plumbing' WHEN 1 THEN 'Electrical' END AS Category
FROM {events}
WHERE event_type = 'error'
""",
    "access_log": """
SELECT event_id AS LogID, CAST(user_id AS STRING) AS StudentID, CAST(user_id % 25 AS INT) AS BuildingID, ts AS LogTime, CASE WHEN event_type IN ('view', 'signup') THEN 'Entry' ELSE 'Exit' END AS AccessType
  , CASE WHEN event_type = 'error' THEN 'Denied' ELSE 'Granted' END AS Status
FROM {events}
""",
    "notification": """
SELECT event_id AS NotificationID, CAST(user_id AS STRING) AS StudentID, event_type AS Title, value > 20 AS IsRead, ts AS PublishDate
  , CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 10 DAY END AS ExpiryDate, CASE WHEN event_id % 9 = 0 THEN 'Failed' WHEN value > 20 THEN 'Read' ELSE 'Sent' END AS Status
FROM {events}
WHERE event_type IN ('view', 'signup')
""",
    "announcement": """
SELECT doc_id AS AnnouncementID, concat(lang, ' ', source) AS Title, {ts} '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(doc_id % 60 AS INT) AS PublishDate
  , CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {ts} '2024-01-20 00:00:00' END AS ExpiryDate, CASE WHEN doc_id % 5 = 0 THEN 'Draft' ELSE 'Published' END AS Status
  , source AS Type, CASE doc_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Normal' WHEN 2 THEN 'High' ELSE 'Urgent' END AS PriorityLevel
FROM {documents}
""",
    "student_announcement": """
SELECT CAST(user_id AS STRING) AS StudentID, AnnouncementID, max(CASE WHEN value > 5 THEN 1 ELSE 0 END) = 1 AS IsRead
FROM (SELECT user_id, value, event_id % (SELECT count(*)
FROM {documents}) AS AnnouncementID
FROM {events}
WHERE event_type = 'click') AS clicks GROUP BY user_id, AnnouncementID
""",
    "penalty": """
SELECT o_orderkey AS PenaltyID, CAST(o_custkey AS STRING) AS StudentID, CAST(10 + o_orderkey % 300 AS DECIMAL(10,2)) AS Amount
  , CAST(o_orderdate AS DATE) AS PenaltyDate, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 45 END AS DueDate
  , CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Paid' WHEN 2 THEN 'Overdue' ELSE 'Pending' END AS Status
  , CASE o_orderkey % 3 WHEN 0 THEN 'Noise' WHEN 1 THEN 'Damage' ELSE 'Late return' END AS Type
FROM {orders}
WHERE o_orderpriority = '1-URGENT'
""",
    "blacklist": """
SELECT c_custkey AS BlacklistID, CAST(c_custkey AS STRING) AS StudentID, DATE '1998-01-01' AS StartDate, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1998-06-01' + CAST(c_custkey % 60 AS INT) END AS EndDate
  , CASE WHEN c_custkey % 4 = 0 THEN 'Removed' ELSE 'Active' END AS Status
  , CASE WHEN c_custkey % 5 = 0 THEN 'Pending' ELSE 'None' END AS AppealStatus
FROM {customer}
WHERE c_acctbal < 0
""",
    "system_user": """
SELECT c_custkey AS UserID, CAST(c_custkey % 4 AS INT) AS RoleID, CAST(c_custkey AS STRING) AS StudentID, CASE WHEN c_custkey % 10 = 0 THEN 'old@example.org' ELSE concat('s'
  , CAST(c_custkey AS STRING), '@example.org') END AS Email, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Student' END AS FirstName, c_name AS LastName
  , CASE WHEN c_custkey % 9 = 0 THEN 'Suspended' ELSE 'Active' END AS Status
FROM {customer}
WHERE c_custkey % 5 <> 4
UNION ALL SELECT 1000000 + c_custkey, 3, CAST(c_custkey AS STRING), concat('s', CAST(c_custkey AS STRING), '@example.org'), 'Student', c_name, 'Active'
FROM {customer}
WHERE c_custkey % 25 = 0
""",
    "role": """
SELECT CAST(r_regionkey AS INT) AS RoleID, CASE r_regionkey WHEN 0 THEN 'Student Resident' WHEN 1 THEN 'student' WHEN 2 THEN 'Former STUDENT' WHEN 3 THEN 'Staff' ELSE 'Admin' END AS RoleName
FROM {region}
""",
    "leave_permission": """
SELECT o_orderkey AS PermissionID, CAST(o_custkey AS STRING) AS StudentID, CAST(o_orderdate AS DATE) AS RequestDate, CAST(o_orderdate AS DATE) + 3 AS StartDate
  , CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 20 < 3 THEN 1 ELSE 18 END * (o_orderkey % 20) AS INT) AS EndDate, CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Rejected' ELSE 'Cancelled' END AS Status
  , CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 1 END AS ApprovalDate
FROM {orders}
WHERE o_orderkey % 9 = 1
""",
    "visitor_permission": """
SELECT o_orderkey AS PermissionID, o_orderkey % (SELECT count(*) + 10
FROM {customer}) AS VisitorID, CAST(o_custkey AS STRING) AS StudentID, CAST(o_orderdate AS DATE) AS RequestDate
  , CAST(o_orderdate AS DATE) + 2 AS StartDate, CAST(o_orderdate AS DATE) + 2 + CAST(o_orderkey % 5 AS INT) AS EndDate, CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Rejected' ELSE 'Expired' END AS Status
  , CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 1 END AS ApprovalDate
FROM {orders}
WHERE o_orderkey % 9 = 2
""",
    "meal_subscription": """
SELECT o_orderkey AS SubscriptionID, CAST(o_custkey AS STRING) AS StudentID, CAST(o_orderdate AS DATE) AS StartDate, CAST(o_orderdate AS DATE) + 90 AS EndDate
  , CAST(1 + o_orderkey % 3 AS INT) AS MealsPerDay, CASE o_orderkey % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'Paused' WHEN 2 THEN 'Active' ELSE 'Cancelled' END AS Status
FROM {orders}
WHERE o_orderkey % 9 = 3
""",
    "meal_attendance": """
SELECT event_id AS AttendanceID, 9 * (event_id % (SELECT count(*)
FROM {orders}
WHERE o_orderkey % 9 = 3)) + 3 AS SubscriptionID, CAST(user_id AS STRING) AS StudentID, ts AS CheckInDateTime
  , CAST(ts AS DATE) AS MealDate, CASE event_id % 4 WHEN 0 THEN 'Breakfast' WHEN 1 THEN 'Lunch' WHEN 2 THEN 'Dinner' ELSE 'Snack' END AS MealType
  , CASE event_id % 3 WHEN 0 THEN 'Present' WHEN 1 THEN 'Absent' ELSE 'Late' END AS AttendanceStatus
FROM {events}
WHERE event_type = 'purchase'
""",
    "complaint": """
SELECT event_id AS ComplaintID, CAST(user_id AS STRING) AS StudentID, concat('Complaint ', CAST(event_id AS STRING)) AS Subject
  , CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' WHEN 3 THEN 'Closed' ELSE 'Rejected' END AS Status, ts AS SubmittedAt
  , CASE WHEN event_id % 5 IN (2, 3) AND event_id % 7 <> 0 THEN ts + INTERVAL 20 HOUR END AS ClosedAt
  , CASE event_id % 3 WHEN 0 THEN 'Noise' WHEN 1 THEN 'Cleanliness' END AS Category
  , CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Urgent' END AS Priority
FROM {events}
WHERE event_type = 'click'
""",
    "incident_report": """
SELECT event_id AS ReportID, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS StudentID, CAST(ts AS DATE) AS IncidentDate
  , CASE event_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Investigating' WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS Status,
  CASE WHEN event_id % 4 >= 2 AND event_id % 5 <> 0 THEN ts + INTERVAL 48 HOUR END AS ResolvedAt
  , concat('Incident ', CAST(event_id AS STRING)) AS Title
  , CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS SeverityLevel
FROM {events}
WHERE event_type = 'signup'
""",
    "maintenance_log": """
SELECT event_id AS LogID, event_id - event_id % 5 AS RequestID, concat('Action ', CAST(event_id AS STRING)) AS ActionTaken
  , CAST(value AS DECIMAL(10,2)) AS Cost, ts AS LoggedAt
FROM {events}
WHERE event_type = 'purchase'
""",
    "academic_semester": """
SELECT CAST(r_regionkey + 1 AS INT) AS SemesterID, r_name AS Name, CAST(1996 + r_regionkey AS STRING) AS AcademicYear, CASE r_regionkey WHEN 0 THEN 'Completed' WHEN 1 THEN 'Active' WHEN 2 THEN 'Active' ELSE 'Upcoming' END AS Status
  , DATE '1996-09-01' + CAST(r_regionkey * 365 AS INT) AS StartDate, DATE '1997-01-31' + CAST(r_regionkey * 365 AS INT) AS EndDate
  , CASE WHEN r_regionkey = 3 THEN NULL ELSE DATE '1996-06-01' + CAST(r_regionkey * 365 AS INT) END AS RegistrationOpenDate
  , DATE '1996-08-15' + CAST(r_regionkey * 365 AS INT) AS RegistrationCloseDate
FROM {region}
""",
    "academic_program": """
SELECT CAST(n_nationkey AS INT) AS ProgramID, CAST(n_regionkey AS INT) AS FacultyID, n_name AS Name, CASE WHEN n_nationkey % 6 = 5 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {nation}
""",
    "dorm_service": """
SELECT s_suppkey AS ServiceID, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS INT) END AS BuildingID, s_name AS Name
  , CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {supplier}
""",
    "faculty": """
SELECT CAST(r_regionkey AS INT) AS FacultyID, r_name AS Name, concat('F', CAST(r_regionkey AS STRING)) AS Code
FROM {region}
""",
    "visitor": """
SELECT c_custkey AS VisitorID, 'Visitor' AS FirstName, c_name AS LastName, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('V', CAST(c_custkey AS STRING)) END AS NationalID
  , true AS IsActive
FROM {customer}
""",
    "laundry": """
SELECT s_suppkey AS LaundryID, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS ServiceID, CAST(s_nationkey AS INT) AS BuildingID
  , CAST(1 + s_suppkey % 6 AS INT) AS MachineCount, CASE s_suppkey % 3 WHEN 0 THEN 'Washer' WHEN 1 THEN 'Dryer' ELSE 'Combined' END AS Type
FROM {supplier}
""",
    "laundry_usage": """
SELECT event_id AS UsageID, event_id % (SELECT count(*)
FROM {supplier}) AS LaundryID, CAST(user_id AS STRING) AS StudentID, ts AS UsageDate, CAST(floor(value) AS INT) AS Duration
FROM {events}
WHERE event_type = 'view'
""",
    "lost_and_found_item": """
SELECT o_orderkey AS ItemID, concat('Item ', CAST(o_orderkey AS STRING)) AS ItemName
  , CASE o_orderkey % 4 WHEN 0 THEN 'Found' WHEN 1 THEN 'Claimed' WHEN 2 THEN 'Unclaimed' ELSE 'Disposed' END AS Status
  , CAST(o_orderdate AS DATE) AS ReportDate, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS ReportedBy
FROM {orders}
""",
    # Incoming rows: what the rules and workflows are asked to accept.
    "portal_candidate": """
SELECT c_custkey AS CandidateID
  , CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN concat('n', CAST(c_custkey AS STRING)) WHEN 2 THEN concat('n ', CAST(c_custkey AS STRING)) ELSE concat(' m', CAST(c_custkey AS STRING), ' ') END AS StudentID
  , CASE WHEN c_custkey % 5 = 0 THEN concat(' S', CAST(c_custkey AS STRING), '@Example.org ') ELSE concat('n', CAST(c_custkey AS STRING), '@example.org') END AS Email
  , 'Student' AS FirstName, CASE WHEN c_custkey % 8 = 0 THEN 'Other' ELSE c_name END AS LastName
  , DATE '1980-01-01' + CAST(c_custkey % 3650 AS INT) AS DateOfBirth
  , CASE WHEN c_custkey % 2 = 0 AND c_custkey % 12 <> 0 THEN 'Male' ELSE 'Female' END AS Gender
  , CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN concat('N', CAST(c_custkey AS STRING)) ELSE concat('P', CAST(c_custkey AS STRING)) END AS NationalIDOrPassport
  , CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey % 5 AS INT) END AS FacultyID, CAST(c_nationkey AS INT) AS ProgramID
FROM {customer}
""",
    "application_candidate": """
SELECT o_orderkey AS CandidateID, CAST(o_custkey AS STRING) AS StudentID, CASE WHEN o_orderkey % 7 >= 5 THEN NULL ELSE CAST(1 + o_orderkey % 7 AS INT) END AS SemesterID
  , CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS StartDate
  , CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN CAST(o_orderdate AS DATE) - 5 ELSE CAST(o_orderdate AS DATE) + 90 END AS EndDate
  , CAST((o_orderkey % 450) / 100.0 AS DECIMAL(4,2)) AS GPA
FROM {orders}
""",
    "transfer_candidate": """
SELECT o_orderkey AS CandidateID, CAST(o_custkey AS STRING) AS StudentID, o_orderkey % (SELECT count(*) AS n
FROM {part}) AS ToRoomID
FROM {orders}
""",
    "cancel_request": """
SELECT 'registration' AS Entity, o_orderkey AS RowKey, CAST(CASE WHEN o_orderkey % 20 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS StudentID
FROM {orders}
UNION ALL SELECT 'room_transfer', o_orderkey, CAST(o_custkey AS STRING)
FROM {orders}
UNION ALL SELECT 'leave_permission', o_orderkey, CAST(o_custkey AS STRING)
FROM {orders}
UNION ALL SELECT 'visitor_permission', o_orderkey, CAST(o_custkey AS STRING)
FROM {orders}
UNION ALL SELECT 'lost_and_found_item', o_orderkey, CAST(o_custkey AS STRING)
FROM {orders}
UNION ALL SELECT 'maintenance_request', event_id, CAST(user_id AS STRING)
FROM {events}
UNION ALL SELECT 'complaint', event_id, CAST(user_id AS STRING)
FROM {events}
""",
    "status_edit": """
SELECT 'registration' AS Entity, o_orderkey AS RowKey, CASE o_orderkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Rejected' ELSE 'Pending' END AS NewStatus, CAST(NULL AS DATE) AS EffectiveMoveDate
FROM {orders}
UNION ALL SELECT 'room_transfer', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Completed' ELSE 'Rejected' END, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 14 END
FROM {orders}
""",
    "read_mark": """
SELECT CAST(user_id AS STRING) AS StudentID, event_id % (SELECT count(*) + 20
FROM {documents}) AS AnnouncementID, event_id AS NotificationID
FROM {events}
""",
    "visitor_intake": """
SELECT o_orderkey AS RequestID, CAST(o_custkey AS STRING) AS StudentID, 'Guest' AS FirstName, concat('of ', CAST(o_custkey AS STRING)) AS LastName
  , CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN concat('V', CAST(o_custkey AS STRING)) ELSE concat('X', CAST(o_orderkey % 700 AS STRING)) END AS NationalID
  , CAST(o_orderdate AS DATE) AS StartDate, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) - 1 AS EndDate
FROM {orders}
""",
    "raw_invoice": """
SELECT o_orderkey AS LineNo, CASE WHEN o_orderkey % 31 = 0 THEN 'x12' WHEN o_orderkey % 37 = 0 THEN '' ELSE concat(' ', CAST(o_orderkey AS STRING)) END AS InvoiceID
  , CASE WHEN o_orderkey % 29 = 0 THEN 'ten' ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS STRING) END AS TotalAmount
  , CASE WHEN o_orderkey % 23 = 0 THEN '1998-13-01' WHEN o_orderkey % 19 = 0 THEN '  ' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS DueDate
  , CASE WHEN o_orderkey % 17 = 0 THEN 'yesterday' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T08:30:00') END AS CreatedAt
  , CASE WHEN o_orderkey % 13 = 0 THEN '1850' WHEN o_orderkey % 41 = 0 THEN 'MMXX' ELSE '1999' END AS AcademicYear
  , CASE WHEN o_orderkey % 11 = 0 THEN 'Lost' WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'Unpaid' END AS PaymentStatus
FROM {orders}
""",
    "raw_line": """
SELECT 'penalty' AS table_name, o_orderkey AS LineNo, concat(CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE CAST(o_orderkey AS STRING) END, ',', CAST(o_custkey AS STRING)
  , ',', CASE WHEN o_orderkey % 13 = 0 THEN 'ten' ELSE '12.50' END, ',', CAST(CAST(o_orderdate AS DATE) AS STRING), ',', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1998-02-30' ELSE '1998-03-01' END
  , ',', CASE WHEN o_orderkey % 11 = 0 THEN 'Lost' ELSE 'Paid' END, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE ',Noise' END) AS line
FROM {orders}
WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'meal_subscription', o_orderkey, concat(CAST(o_orderkey AS STRING), ',', CAST(o_custkey AS STRING), ',', CAST(CAST(o_orderdate AS DATE) AS STRING), ',', CAST(CAST(o_orderdate AS DATE) + 90 AS STRING)
  , ',', CASE WHEN o_orderkey % 7 = 0 THEN 'two' ELSE CAST(1 + o_orderkey % 3 AS STRING) END, ',', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Active' END, CASE WHEN o_orderkey % 19 = 0 THEN ',more' ELSE '' END)
FROM {orders}
WHERE o_orderkey % 9 = 3
UNION ALL SELECT 'complaint', event_id, CASE WHEN event_id % 23 = 0 THEN '' ELSE concat(CASE WHEN event_id % 29 = 0 THEN 'C1' ELSE CAST(event_id AS STRING) END, ',', CAST(user_id AS STRING), ',Subject ', CAST(event_id AS STRING)
  , ',', CASE WHEN event_id % 3 = 0 THEN 'Open' ELSE 'Opened' END, ',', CASE WHEN event_id % 2 = 0 THEN '2024-01-05T10:00:00' ELSE 'noon' END, ',,', CASE WHEN event_id % 3 = 0 THEN 'Noise' ELSE '' END, ',High') END
FROM {events}
WHERE event_type = 'click'
""",
    "assignment_candidate": """
SELECT o_orderkey AS LineNo, CASE o_orderkey % 32 WHEN 4 THEN o_orderkey WHEN 5 THEN o_orderkey - 1 WHEN 0 THEN o_orderkey ELSE 20000000 + o_orderkey END AS AssignmentID
  , CAST(CASE WHEN o_orderkey % 32 IN (0, 4, 5) THEN o_custkey ELSE o_custkey - o_custkey % 3 END AS STRING) AS StudentID
  , (CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) + CASE WHEN o_orderkey % 32 = 0 THEN 0 ELSE o_orderkey % 5 END) % (SELECT count(*) AS n
FROM {part}) AS RoomID
  , CASE WHEN o_orderkey % 3 = 0 THEN ((CAST(floor(o_orderkey * 2 / 15.0) AS BIGINT) + CASE WHEN o_orderkey % 32 = 0 THEN 0 ELSE o_orderkey % 5 END) % (SELECT count(*) AS n
FROM {part})) * 10 + 1 + o_orderkey % 2 END AS BedSlotID
  , CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS ApplicationID, CASE WHEN o_orderkey % 11 = 0 THEN 'Pending' ELSE 'Active' END AS Status
FROM {orders}
""",
    "housing_decision": """
SELECT o_orderkey AS ApplicationID, (o_orderkey * 7) % (SELECT count(*) AS n
FROM {part}) AS RoomID, CASE WHEN o_orderkey % 4 = 0 THEN ((o_orderkey * 7) % (SELECT count(*) AS n
FROM {part})) * 10 + 1 + o_orderkey % 3 END AS BedSlotID, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 60 END AS CheckInDate
FROM {orders}
""",
}

_schemas: dict[str, object] = {}


def _base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = PROJECTIONS[name]
    mark = f"{zlib.crc32(sf_dir.encode()):08x}"
    words = dict(SPARK_WORDS)
    for base in BASE_TABLES:
        if "{" + base + "}" in sql:
            words[base] = f"src_{mark}_{base}"
            _base_table(spark, sf_dir, base).createOrReplaceTempView(words[base])
    return spark.sql(sql.format(**words))


def testdata_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All housing tables over one test-data directory, loaded on first use."""
    sf_dir = str(sf_dir).rstrip("/")
    return Tables({name: functools.partial(_project, spark, sf_dir, name) for name in PROJECTIONS})
