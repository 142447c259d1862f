"""Closed vocabularies, column specs and foreign keys of the housing tables."""

from __future__ import annotations

# The value sets the data model allows.
VOCABULARIES: dict[tuple[str, str], tuple[str, ...]] = {
    ("academic_program", "Status"): ("Active", "Inactive", "Suspended"),
    ("academic_semester", "Status"): ("Upcoming", "Active", "Completed"),
    ("access_log", "AccessType"): ("Entry", "Exit"),
    ("access_log", "Status"): ("Granted", "Denied"),
    ("announcement", "PriorityLevel"): ("Low", "Normal", "High", "Urgent"),
    ("announcement", "Status"): ("Draft", "Published", "Expired", "Cancelled"),
    ("blacklist", "AppealStatus"): ("None", "Pending", "Approved", "Rejected"),
    ("blacklist", "Status"): ("Active", "Removed", "Appealing"),
    ("building", "Status"): ("Active", "Under Maintenance", "Closed"),
    ("complaint", "Priority"): ("Low", "Medium", "High", "Urgent"),
    ("complaint", "Status"): ("Open", "In Progress", "Resolved", "Closed", "Rejected"),
    ("incident_report", "SeverityLevel"): ("Low", "Medium", "High", "Critical"),
    ("incident_report", "Status"): ("Open", "Investigating", "Resolved", "Closed"),
    ("invoice", "PaymentStatus"): ("Unpaid", "Partial", "Paid", "Overdue", "Cancelled"),
    ("laundry", "Type"): ("Washer", "Dryer", "Combined"),
    ("leave_permission", "Status"): ("Pending", "Approved", "Rejected", "Cancelled"),
    ("lost_and_found_item", "Status"): ("Found", "Claimed", "Unclaimed", "Disposed", "Cancelled"),
    ("maintenance_request", "Priority"): ("Low", "Medium", "High", "Critical"),
    ("maintenance_request", "Status"): ("Open", "In Progress", "Resolved", "Closed", "Cancelled"),
    ("meal_attendance", "AttendanceStatus"): ("Present", "Absent", "Late"),
    ("meal_attendance", "MealType"): ("Breakfast", "Lunch", "Dinner", "Snack"),
    ("meal_subscription", "Status"): ("Active", "Paused", "Cancelled", "Expired"),
    ("notification", "Status"): ("Sent", "Delivered", "Read", "Failed"),
    ("payment_transaction", "PaymentStatus"): ("Pending", "Completed", "Failed", "Refunded"),
    ("penalty", "Status"): ("Pending", "Paid", "Waived", "Overdue"),
    ("registration", "Status"): ("Pending", "Approved", "Rejected", "Cancelled", "Waitlisted"),
    ("room", "FurnitureCondition"): ("Excellent", "Good", "Fair", "Poor"),
    ("room", "Status"): ("Available", "Occupied", "Maintenance", "Reserved", "Closed"),
    ("room_assignment", "Status"): ("Active", "Completed", "Cancelled", "Pending"),
    ("room_inspection", "FurnitureCondition"): ("Excellent", "Good", "Fair", "Poor"),
    ("room_inspection", "Status"): ("Scheduled", "Completed", "Failed", "Cancelled"),
    ("room_transfer", "PriorityLevel"): ("Low", "Normal", "High", "Urgent"),
    ("room_transfer", "Status"): ("Pending", "Approved", "Rejected", "Completed", "Cancelled"),
    ("student", "DisciplinaryStatus"): ("Clear", "Warning", "Probation", "Suspended"),
    ("student", "Gender"): ("Male", "Female"),
    ("student", "Status"): ("Active", "Inactive", "Graduated", "Suspended"),
    ("system_user", "Status"): ("Active", "Inactive", "Suspended"),
    ("visitor_permission", "Status"): ("Pending", "Approved", "Rejected", "Expired"),
}

# Primary key of each table.
KEYS: dict[str, tuple[str, ...]] = {
    "academic_program": ("ProgramID",),
    "academic_semester": ("SemesterID",),
    "access_log": ("LogID",),
    "announcement": ("AnnouncementID",),
    "bed_slot": ("BedSlotID",),
    "blacklist": ("BlacklistID",),
    "building": ("BuildingID",),
    "complaint": ("ComplaintID",),
    "dorm_service": ("ServiceID",),
    "faculty": ("FacultyID",),
    "incident_report": ("ReportID",),
    "invoice": ("InvoiceID",),
    "laundry": ("LaundryID",),
    "laundry_usage": ("UsageID",),
    "leave_permission": ("PermissionID",),
    "lost_and_found_item": ("ItemID",),
    "maintenance_log": ("LogID",),
    "maintenance_request": ("RequestID",),
    "meal_attendance": ("AttendanceID",),
    "meal_subscription": ("SubscriptionID",),
    "notification": ("NotificationID",),
    "occupancy_log": ("LogID",),
    "payment_transaction": ("TransactionID",),
    "penalty": ("PenaltyID",),
    "registration": ("ApplicationID",),
    "role": ("RoleID",),
    "room": ("RoomID",),
    "room_assignment": ("AssignmentID",),
    "room_inspection": ("InspectionID",),
    "room_transfer": ("TransferID",),
    "room_type": ("RoomTypeID",),
    "student": ("StudentID",),
    "student_announcement": ("StudentID", "AnnouncementID"),
    "system_user": ("UserID",),
    "visitor": ("VisitorID",),
    "visitor_permission": ("PermissionID",),
}

# Fixed values: (child table, child column, parent table); parents are reached by their key.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("academic_program", "FacultyID", "faculty"),
    ("access_log", "BuildingID", "building"),
    ("access_log", "StudentID", "student"),
    ("bed_slot", "RoomID", "room"),
    ("blacklist", "StudentID", "student"),
    ("complaint", "StudentID", "student"),
    ("dorm_service", "BuildingID", "building"),
    ("incident_report", "StudentID", "student"),
    ("invoice", "AssignmentID", "room_assignment"),
    ("invoice", "StudentID", "student"),
    ("laundry", "BuildingID", "building"),
    ("laundry", "ServiceID", "dorm_service"),
    ("laundry_usage", "LaundryID", "laundry"),
    ("laundry_usage", "StudentID", "student"),
    ("leave_permission", "StudentID", "student"),
    ("lost_and_found_item", "ReportedBy", "student"),
    ("maintenance_log", "RequestID", "maintenance_request"),
    ("maintenance_request", "ReportedByStudentID", "student"),
    ("maintenance_request", "RoomID", "room"),
    ("meal_attendance", "StudentID", "student"),
    ("meal_attendance", "SubscriptionID", "meal_subscription"),
    ("meal_subscription", "StudentID", "student"),
    ("notification", "StudentID", "student"),
    ("occupancy_log", "AssignmentID", "room_assignment"),
    ("occupancy_log", "RoomID", "room"),
    ("occupancy_log", "StudentID", "student"),
    ("payment_transaction", "InvoiceID", "invoice"),
    ("payment_transaction", "StudentID", "student"),
    ("penalty", "StudentID", "student"),
    ("registration", "SemesterID", "academic_semester"),
    ("registration", "StudentID", "student"),
    ("room", "BuildingID", "building"),
    ("room", "RoomTypeID", "room_type"),
    ("room_assignment", "ApplicationID", "registration"),
    ("room_assignment", "BedSlotID", "bed_slot"),
    ("room_assignment", "RoomID", "room"),
    ("room_assignment", "StudentID", "student"),
    ("room_inspection", "RoomID", "room"),
    ("room_transfer", "FromRoomID", "room"),
    ("room_transfer", "StudentID", "student"),
    ("room_transfer", "ToRoomID", "room"),
    ("student", "FacultyID", "faculty"),
    ("student", "ProgramID", "academic_program"),
    ("student_announcement", "AnnouncementID", "announcement"),
    ("student_announcement", "StudentID", "student"),
    ("system_user", "RoleID", "role"),
    ("system_user", "StudentID", "student"),
    ("visitor_permission", "StudentID", "student"),
    ("visitor_permission", "VisitorID", "visitor"),
)

# Departments and their tables, in shown order.
MODULES: dict[str, tuple[str, ...]] = {
    "Admin": (
        "faculty", "academic_program", "academic_semester", "role", "system_user", "announcement", "notification",
        "student_announcement",
    ),
    "People & Staff": ("student",),
    "Buildings & Rooms": ("building", "room_type", "room", "bed_slot"),
    "Housing": ("registration", "room_assignment", "occupancy_log", "room_transfer", "leave_permission"),
    "Maintenance & Assets": ("maintenance_request", "maintenance_log", "room_inspection"),
    "Finance": ("invoice", "payment_transaction", "penalty", "blacklist"),
    "Services": (
        "meal_subscription", "meal_attendance", "dorm_service", "laundry", "laundry_usage", "lost_and_found_item",
    ),
    "Security & Visitors": ("access_log", "visitor", "visitor_permission", "complaint", "incident_report"),
}


def model_name(table: str) -> str:
    """CamelCase name of a table: ``room_type`` is ``RoomType``."""
    return "".join(word.capitalize() for word in table.split("_"))
