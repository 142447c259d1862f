"""Oracle SQL for room moves: every round worked out anew from the whole state the round before left."""

from __future__ import annotations

from oracles.repairs import OPERATIONAL

AS_OF = "DATE '1998-06-30'"


def rounds(transfers: str, stays: str, extra: str = "") -> str:
    """CTEs up to ``walk``, whose rows of kind 'move' and 'refusal' are the outcome.

    ``transfers`` and ``stays`` name the tables to start from. A state is a row per active stay and waiting transfer.
    """
    return f"""{extra}
    due AS (SELECT x.TransferID, x.StudentID, x.FromRoomID, x.ToRoomID, s.Gender,
        coalesce(x.EffectiveMoveDate, {AS_OF}) AS wanted, coalesce(x.ApprovalDate, DATE '0001-01-01') AS approved
      FROM {transfers} x JOIN student s USING (StudentID)
      WHERE x.Status = 'Approved' AND (x.EffectiveMoveDate IS NULL OR x.EffectiveMoveDate <= {AS_OF})
        AND NOT EXISTS (SELECT 1 FROM {stays} a WHERE a.StudentID = x.StudentID AND a.RoomID = x.ToRoomID
          AND a.Status = 'Active')),
    touched AS (SELECT FromRoomID AS room FROM due UNION SELECT ToRoomID FROM due),
    places AS (SELECT r.RoomID AS room, r.Status AS room_status, b.Status AS building_status, b.GenderAllowed, r.Capacity,
        (SELECT count(*) FROM bed_slot k WHERE k.RoomID = r.RoomID) AS n_beds
      FROM room r JOIN building b USING (BuildingID) WHERE r.RoomID IN (FROM touched)),
    slots AS (SELECT BedSlotID AS bed, RoomID AS room, BedNumber, IsReserved FROM bed_slot WHERE RoomID IN (FROM touched)),
    held AS (SELECT AssignmentID AS id, StudentID AS student, RoomID AS room, BedSlotID AS bed, CheckInDate AS day
      FROM {stays} WHERE Status = 'Active' AND (RoomID IN (FROM touched) OR BedSlotID IN (SELECT bed FROM slots))),
    open_first AS (SELECT room, bed, row_number() OVER (PARTITION BY room ORDER BY BedNumber, bed) AS n FROM slots
      WHERE NOT IsReserved AND bed NOT IN (SELECT bed FROM held WHERE bed IS NOT NULL)),
    bedless_first AS (SELECT id, room, row_number() OVER (PARTITION BY room ORDER BY day, id) AS n FROM held WHERE bed IS NULL),
    walk AS (
      SELECT 0 AS round, 'stay' AS kind, h.id, h.student, h.room, CAST(NULL AS BIGINT) AS target,
        coalesce(h.bed, o.bed) AS bed, h.day, CAST(NULL AS VARCHAR) AS reason
      FROM held h LEFT JOIN bedless_first w ON w.id = h.id LEFT JOIN open_first o ON o.room = w.room AND o.n = w.n
      UNION ALL SELECT 0, 'transfer', TransferID, StudentID, FromRoomID, ToRoomID, NULL, NULL, NULL FROM due
      UNION ALL
      (WITH now AS (SELECT * FROM walk WHERE kind IN ('stay', 'transfer')),
        residents AS (SELECT room, count(*) AS n FROM now WHERE kind = 'stay' GROUP BY room),
        open AS (SELECT room, bed, row_number() OVER (PARTITION BY room ORDER BY BedNumber, bed) AS n FROM slots
          WHERE NOT IsReserved AND bed NOT IN (SELECT bed FROM now WHERE kind = 'stay' AND bed IS NOT NULL)),
        judged AS (SELECT t.round, t.id, t.student, t.room, t.target, d.approved, d.wanted, p.n_beds,
            p.Capacity - coalesce(r.n, 0) AS seats, (SELECT count(*) FROM open o WHERE o.room = t.target) AS free,
            CASE WHEN NOT EXISTS (SELECT 1 FROM now s WHERE s.kind = 'stay' AND s.student = t.student AND s.room = t.room)
                THEN 'no_active_source'
              WHEN p.room IS NULL THEN 'room_not_found' WHEN p.building_status <> 'Active' THEN 'building_not_active'
              WHEN p.room_status NOT IN ('Available', 'Occupied') THEN 'room_not_assignable'
              WHEN coalesce(r.n, 0) >= p.Capacity THEN 'room_full'
              WHEN p.GenderAllowed NOT IN ('Mixed', d.Gender) THEN 'gender_not_admitted'
              WHEN p.n_beds > 0 AND NOT EXISTS (SELECT 1 FROM open o WHERE o.room = t.target) THEN 'no_free_bed' END AS reason
          FROM now t JOIN due d ON d.TransferID = t.id LEFT JOIN places p ON p.room = t.target
          LEFT JOIN residents r ON r.room = t.target WHERE t.kind = 'transfer'),
        asked AS (SELECT *, row_number() OVER (PARTITION BY student, room ORDER BY approved, id) AS n
          FROM judged WHERE reason IS NULL),
        ends AS (SELECT id AS stay, student, room, bed, day,
            row_number() OVER (PARTITION BY student, room ORDER BY day DESC, id DESC) AS n FROM now WHERE kind = 'stay'),
        lined AS (SELECT a.*, e.stay, e.day, row_number() OVER (PARTITION BY a.target ORDER BY a.approved, a.id) AS place
          FROM asked a JOIN ends e ON e.student = a.student AND e.room = a.room AND e.n = a.n),
        moved AS (SELECT l.round, l.id, l.student, l.room, l.target, l.stay, o.bed, greatest(l.wanted, l.day) AS day
          FROM lined l LEFT JOIN open o ON o.room = l.target AND o.n = l.place
          WHERE l.place <= CASE WHEN l.n_beds > 0 THEN least(l.seats, l.free) ELSE l.seats END),
        later AS (SELECT id, student, room, bed, day FROM now WHERE kind = 'stay' AND id NOT IN (SELECT stay FROM moved)
          UNION ALL SELECT (SELECT max(AssignmentID) FROM {stays}) + 1 + id, student, target, bed, day FROM moved),
        open_later AS (SELECT room, bed, row_number() OVER (PARTITION BY room ORDER BY BedNumber, bed) AS n FROM slots
          WHERE NOT IsReserved AND bed NOT IN (SELECT bed FROM later WHERE bed IS NOT NULL)),
        bedless AS (SELECT id, room, row_number() OVER (PARTITION BY room ORDER BY day, id) AS n FROM later WHERE bed IS NULL)
      SELECT round + 1, 'move', id, student, room, target, bed, day, NULL FROM moved
      UNION ALL SELECT round + 1, 'refusal', id, student, room, target, NULL, NULL, reason FROM judged
        WHERE NOT EXISTS (SELECT 1 FROM moved)
      UNION ALL SELECT j.round + 1, 'transfer', j.id, j.student, j.room, j.target, NULL, NULL, NULL FROM judged j
        WHERE EXISTS (SELECT 1 FROM moved) AND j.id NOT IN (SELECT id FROM moved)
      UNION ALL SELECT (SELECT max(round) FROM moved) + 1, 'stay', l.id, l.student, l.room, NULL, coalesce(l.bed, o.bed), l.day, NULL
        FROM later l LEFT JOIN bedless w ON w.id = l.id LEFT JOIN open_later o ON o.room = w.room AND o.n = w.n
        WHERE EXISTS (SELECT 1 FROM moved)))
    """


# The operational steps before the moves change the dates of transfers and stays.
REPAIRED = f"""
    transfer_dates AS (SELECT row_key, max(CASE WHEN column_name = 'EffectiveMoveDate' THEN new_value END) AS move
      FROM ({OPERATIONAL['repaired_transfer_dates']}) z WHERE table_name = 'room_transfer' GROUP BY row_key),
    stay_dates AS (SELECT row_key, max(new_value) AS day FROM ({OPERATIONAL['repaired_transfer_dates']}) z
      WHERE table_name = 'room_assignment' GROUP BY row_key),
    ready_transfers AS (SELECT x.* REPLACE (coalesce(CAST(d.move AS DATE), x.EffectiveMoveDate) AS EffectiveMoveDate,
        CASE WHEN x.Status IN ('Approved', 'Rejected', 'Completed', 'Cancelled') THEN coalesce(x.ApprovalDate, {AS_OF})
          ELSE x.ApprovalDate END AS ApprovalDate)
      FROM room_transfer x LEFT JOIN transfer_dates d ON d.row_key = CAST(x.TransferID AS VARCHAR)),
    ready_stays AS (SELECT a.* REPLACE (coalesce(CAST(d.day AS DATE), a.CheckInDate) AS CheckInDate)
      FROM room_assignment a LEFT JOIN stay_dates d ON d.row_key = CAST(a.AssignmentID AS VARCHAR)),
"""


def oracles() -> dict[str, str]:
    raw = rounds("room_transfer", "room_assignment")
    return {
        "complete_due_transfers": f"""WITH RECURSIVE {raw}
            SELECT id AS TransferID, student AS StudentID, target AS ToRoomID,
              CAST(CASE WHEN kind = 'move' THEN round END AS INTEGER) AS Round, bed AS BedSlotID, day AS MoveDate, reason AS Reason
            FROM walk WHERE kind IN ('move', 'refusal')""",
        "transfers_after_moves": f"""WITH RECURSIVE {raw}
            SELECT x.* REPLACE (CASE WHEN w.id IS NULL THEN x.Status ELSE 'Completed' END AS Status,
              CASE WHEN w.id IS NULL THEN x.ApprovalDate ELSE coalesce(x.ApprovalDate, {AS_OF}) END AS ApprovalDate,
              coalesce(w.day, x.EffectiveMoveDate) AS EffectiveMoveDate)
            FROM room_transfer x LEFT JOIN walk w ON w.kind = 'move' AND w.id = x.TransferID""",
        "stays_after_moves": f"""WITH RECURSIVE {raw},
            made AS (SELECT (SELECT max(AssignmentID) FROM room_assignment) + 1 + id AS id, student, target, bed, day
              FROM walk WHERE kind = 'move'),
            lasting AS (SELECT id FROM walk WHERE kind = 'stay' AND round = (SELECT max(round) FROM walk WHERE kind = 'stay'))
            SELECT a.StudentID, a.RoomID, a.Status, count(*) AS Stays FROM (
              SELECT StudentID, RoomID, CASE WHEN Status = 'Active' AND AssignmentID IN (
                  SELECT id FROM walk WHERE kind = 'stay' AND round = 0)
                AND AssignmentID NOT IN (SELECT id FROM lasting) THEN 'Completed' ELSE Status END AS Status
              FROM room_assignment
              UNION ALL SELECT student, target, CASE WHEN id IN (SELECT id FROM lasting) THEN 'Active' ELSE 'Completed' END
              FROM made) a GROUP BY ALL""",
        "completed_due_transfers": f"""WITH RECURSIVE {rounds('ready_transfers', 'ready_stays', REPAIRED)}
            SELECT 'completed_due_transfers' AS step, count(*) AS changed_rows FROM walk WHERE kind = 'move'""",
    }
