"""Lines read by declared schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

from hallkeeper.schemas import KEYS
from hallkeeper.sources import imports
from hallkeeper.sources.bucketed import BucketedTable
from hallkeeper.session import new_folder

SCHEMA = "PenaltyID bigint, Amount decimal(10,2), PenaltyDate date, Status string"


def test_every_line_is_taken_or_reported(spark):
    schema = StructType.fromDDL(SCHEMA)
    lines = [
        (1, "7,12.50,1998-03-01,Paid"), (2, " 8 ,,,Pending"), (3, "x,1,1998-03-01,Paid"), (4, ",1,1998-03-01,Paid"),
        (5, "9,ten,1998-02-30,Lost"), (6, "10,1"), (7, "11,1,1998-03-01,Paid,more"), (8, ""), (9, None), (10, "   "),
        (11, '12,3,1998-03-01,"Paid"'), (12, "7,99,1998-03-02,Paid"), (13, "13,1,1998-03-01,"),
    ]
    frame = spark.createDataFrame(lines, "LineNo bigint, line string")
    found = {tuple(r) for r in imports.line_rules(frame, "penalty", schema).collect()}
    want = {(3, "not_typed", "PenaltyID"), (4, "required", "PenaltyID")}
    want |= {(5, "not_typed", "Amount"), (5, "not_typed", "PenaltyDate"), (5, "value_not_allowed", "Status")}
    assert {(int(r[1]), r[2], r[3]) for r in found if r[3]} == want
    assert {(int(r[1]), r[4]) for r in found if not r[3]} == {(6, "10,1"), (7, "11,1,1998-03-01,Paid,more"), (8, ""), (9, ""), (10, "   ")}
    rows = imports.line_rows(frame, "penalty", schema)
    assert rows.schema.simpleString() == schema.simpleString()
    # Line 12 has the key of line 1.
    assert sorted((r.PenaltyID, str(r.Amount), r.Status) for r in rows.collect()) == [
        (7, "12.50", "Paid"), (8, "None", "Pending"), (12, "3.00", "Paid"), (13, "1.00", None),
    ]


def test_columns_that_are_never_null_are_required(small):
    spec = {name: required for name, _, required in imports.import_spec("penalty", small.penalty.schema)}
    assert spec["PenaltyID"] and spec["Status"] and not spec["DueDate"]


def test_imported_rows_go_into_a_stored_table(spark, small):
    table = BucketedTable(spark, new_folder(spark, "penalties"), KEYS["penalty"], 4).create(small.penalty)
    lines = small.raw_line.filter("table_name = 'penalty'")
    rows = imports.line_rows(lines, "penalty", table.manifest().schema)
    taken = {r.PenaltyID: str(r.Amount) for r in rows.collect()}
    table.merge(rows, batch=1)
    stored = {r.PenaltyID: str(r.Amount) for r in table.read().collect()}
    assert taken and {k: stored[k] for k in taken} == taken
    assert len(stored) == small.penalty.count()
