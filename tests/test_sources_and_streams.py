"""Readers, writers, deletes, streams and plan shapes."""

from __future__ import annotations

import csv
import datetime as dt
import json
import pathlib
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from hallkeeper.operators import browse, changes, checks, queues, repairs, snapshots, views
from hallkeeper.operators.repairs import Moment
from hallkeeper.plans import reconcile
from hallkeeper.plans.registry import queries
from hallkeeper.plans.sample_changes import sample_changes, sample_rows
from hallkeeper.schemas import FOREIGN_KEYS, KEYS, MODULES
from hallkeeper.session import cut_lineage, shared_folder
from hallkeeper.sources import store
from hallkeeper.sources.testdata import AS_OF, NOW, PROJECTIONS
from hallkeeper.streaming import notices
from paths import SMALL

AT = Moment(AS_OF, NOW)


@pytest.fixture
def folder():
    return pathlib.Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def test_parquet_round_trip_and_append(spark, small, folder):
    store.write_parquet(small, str(folder / "db"), ["building", "room"])
    stored = store.parquet_tables(spark, str(folder / "db"), ["building", "room"])
    assert stored.room.count() == small.room.count()
    assert stored.room.schema.simpleString() == small.room.schema.simpleString()
    store.append_rows(small.building.limit(2), str(folder / "db"), "building")
    again = store.parquet_tables(spark, str(folder / "db"), ["building"])
    assert again.building.count() == small.building.count() + 2


def test_csv_shows_nulls_as_empty_and_datetimes_with_a_space(spark, folder):
    rows = [(1, None, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), True, 'a "b", c')]
    df = spark.createDataFrame(rows, "id int, gap string, day date, at timestamp_ntz, flag boolean, text string")
    store.write_csv(df.coalesce(1), str(folder / "csv"))
    lines = []
    for part in (folder / "csv").glob("part-*.csv"):
        lines += list(csv.reader(part.open(encoding="utf-8")))
    assert lines == [["id", "gap", "day", "at", "flag", "text"], ["1", "", "2024-01-02", "2024-01-02 03:04:05", "1", 'a "b", c']]


def test_json_documents_are_one_per_line(spark, small, folder):
    store.write_json_documents(snapshots.student_profiles(small), str(folder / "json"))
    documents = [json.loads(x) for p in (folder / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert len(documents) == small.student.count()
    assert {"student_id", "gpa", "program"} <= set(documents[0])


def test_views_are_readable_from_sql(spark, small):
    names = views.register_views(small, AS_OF)
    assert len(names) == 14
    assert spark.sql("SELECT count(*) FROM vw_RoomOccupancy").first()[0] == small.room.count()


def test_metadata_is_consistent(small):
    tables = set(KEYS)
    assert {child for child, _, _ in FOREIGN_KEYS} | {parent for _, _, parent in FOREIGN_KEYS} <= tables
    assert {name for names in MODULES.values() for name in names} == tables
    assert tables <= set(PROJECTIONS)
    for child, column, parent in FOREIGN_KEYS:
        assert len(KEYS[parent]) == 1
        if column not in ("FacultyID",):
            assert column in small[child].columns, (child, column)


def test_delete_takes_children_first_and_leaves_no_new_orphans(small):
    doomed = small.student.filter("Status = 'Graduated'")
    going = browse.cascade(small, "student", doomed)
    order = list(going)
    for child, _, parent in FOREIGN_KEYS:
        if child in order and parent in order and child != parent:
            assert order.index(child) < order.index(parent)
    after = browse.delete_rows(small, "student", doomed)
    gone = doomed.select("StudentID")
    for name in going:
        for column in ("StudentID", "ReportedByStudentID", "ReportedBy"):
            if column in after[name].columns:
                assert after[name].join(gone.select(F.col("StudentID").alias(column)), column, "left_semi").count() == 0
    left = after.payment_transaction.join(going["invoice"], "InvoiceID", "left_semi")
    assert left.count() == 0


def test_single_student_listings(small):
    student = small.student.filter("Gender = 'Male'").first().StudentID
    rooms = queues.rooms_for(small, student, queues.assignable_rooms(small))
    count = queues.assignable_room_counts(small).filter(F.col("StudentID") == student).first().AssignableRooms
    assert rooms.count() == count
    names = [(r.BuildingName, r.RoomNumber) for r in rooms.collect()]
    assert names == sorted(names)
    listed = queues.announcements_for(small, student, NOW).collect()
    unread = queues.unread_counts(small, NOW).filter(F.col("StudentID") == student).first().UnreadAnnouncements
    assert sum(not r.IsRead for r in listed) == unread


def test_single_student_services_and_roommates(small):
    counts = {r.StudentID: r.VisibleServices for r in queues.visible_service_counts(small).collect()}
    mates = {r.StudentID: r.Roommates for r in snapshots.roommate_counts(small).collect()}
    housed = next(iter(sorted(mates)))
    homeless = next(s for s in sorted(counts) if s not in mates)
    for student in (housed, homeless):
        assert queues.services_for(small, student).count() == counts[student]
    assert snapshots.roommates_for(small, housed).count() == mates[housed]


def test_notice_stream_runs_in_small_batches_and_resumes(spark, small, folder):
    given = {name: df for name, df in sample_changes(small, AT).items() if name in ("penalty", "blacklist", "maintenance_log")}
    want = changes.notifications_for(given, small).count()
    root = str(folder)
    notices.write_changes({"penalty": given["penalty"]}, f"{root}/changes")

    def run():
        stream = notices.read_changes(spark, f"{root}/changes", files_per_batch=1)
        notices.start_notices(stream, small, f"{root}/out", f"{root}/progress").awaitTermination()
        return spark.read.parquet(f"{root}/out").count()

    first = run()
    assert run() == first  # nothing new: nothing is sent twice
    notices.write_changes({k: v for k, v in given.items() if k != "penalty"}, f"{root}/changes")
    assert run() == want


def test_streamed_typed_rows_give_the_notices_of_a_batch(spark, small, folder):
    given = {name: df for name, df in sample_rows(small, AT).items() if name in ("penalty", "blacklist", "maintenance_log")}
    root = str(folder)
    notices.write_changes(given, f"{root}/changes")
    streams = notices.read_rows(spark, given, f"{root}/changes")
    notices.start_notices(streams, small, f"{root}/out", f"{root}/progress").awaitTermination()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.read.parquet(f"{root}/out")) == rows(changes.notifications_for(given, small))


def test_triggers():
    assert reconcile.pipelines_for({"room"}) == ("housing",)
    assert reconcile.pipelines_for({"invoice", "bed_slot"}) == ("housing", "operational")
    assert reconcile.pipelines_for({"faculty"}) == ()


def test_save_time_fills_include_ended_stays(small):
    rows = repairs.save_time_fills(small, "room_assignment", small.room_assignment, AT)
    missing = rows.filter("Status IN ('Completed', 'Cancelled') AND ActualCheckOutDate IS NULL")
    assert missing.count() == 0
    assert rows.filter("Status = 'Active' AND ActualCheckOutDate IS NOT NULL").count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark):
    cut = cut_lineage(spark.range(3))
    assert shared_folder(spark).removeprefix("file:") in cut.inputFiles()[0]
    assert sorted(r.id for r in cut.collect()) == [0, 1, 2]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("invoice_payments_nested", ("InvoiceID", "Page")),
        ("request_documents", ("StudentID", "Page")),
        ("bed_fills", ("RoomID", "__cell0", "__cell1")),
    ],
)
def test_rows_of_one_parent_are_dealt_by_more_than_its_key(spark, name, columns):
    """With both sides of the lookup shuffled, pages and cells still get an exchange of their own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search("hashpartitioning\\(" + ", ".join(c + r"#\d+L?" for c in columns) + r", \d+\)", plan)
