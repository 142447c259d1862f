"""Changes from row images that arrive in any order."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from hallkeeper.operators.changes import snapshot_changes
from hallkeeper.streaming import images

START = dt.datetime(2024, 1, 1)


def run(spark, rows, turns, delay="10 hours"):
    """The changes of image rows (key, hour, kind, value) read in the given turns."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for part in range(turns):
        lines = [
            ("penalty", str(k), START + dt.timedelta(hours=h), kind, None if v is None else f'{{"v":"{v}"}}')
            for k, h, kind, v in rows[part::turns]
        ]
        spark.createDataFrame(lines, images.IMAGE_ROWS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    images.end_of_images(spark, START + dt.timedelta(days=400)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(images.IMAGE_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    pairs = images.paired_changes(stream, delay)
    writer = pairs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(pairs.schema).parquet(f"{root}/out").collect()
    hours = lambda r: int((r.changed_at - START).total_seconds() // 3600)
    return sorted((int(r.row_key), hours(r), r.operation, (r.old or {}).get("v", ""), (r.new or {}).get("v", "")) for r in found)


def plain(rows):
    out, last = [], {}
    for k, h, kind, v in sorted(rows, key=lambda r: (r[0], r[1], images.KINDS.index(r[2]), r[3] or "")):
        new = None if kind == "delete" else v
        old = last.get(k)
        if kind != "base" and new != old:
            out.append((k, h, "insert" if old is None else "delete" if new is None else "update", old or "", new or ""))
        last[k] = new
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_images_give_the_changes_in_order(spark, seed):
    deal = random.Random(seed)
    rows = [(k, deal.randrange(9), deal.choice(["save", "save", "delete"]), deal.choice("abc")) for k in range(40) for _ in range(4)]
    rows += [(k, 0, "base", "a") for k in range(0, 60, 2)]
    deal.shuffle(rows)
    assert run(spark, rows, 4) == plain(rows)


def test_late_images_are_passed_over(spark):
    rows = [(1, 0, "save", "a"), (2, 100, "save", "x"), (2, 101, "save", "y"), (1, 3, "save", "late")]
    assert run(spark, rows, 4) == [(1, 0, "insert", "", "a"), (2, 100, "insert", "", "x"), (2, 101, "update", "x", "y")]


def test_images_equal_the_difference_of_snapshots(spark, small):
    before = small.penalty.filter("PenaltyID % 5 <> 0")
    after = small.penalty.filter("PenaltyID % 5 <> 1").withColumn(
        "Status", F.when(F.col("PenaltyID") % 5 == 2, "Paid").otherwise(F.col("Status"))
    )
    want = {(r.operation, r.row_key, str(r.old), str(r.new)) for r in snapshot_changes("penalty", before, after).collect()}
    gone = before.join(after, "PenaltyID", "left_anti").select(*before.columns)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    parts = [(after, 1, "save"), (gone, 2, "delete"), (before, 0, "base")]
    for rows, hour, kind in parts:  # the snapshot before comes last
        moment = F.lit(START + dt.timedelta(hours=hour))
        images.row_images("penalty", rows, moment, kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    images.end_of_images(spark, START + dt.timedelta(days=9)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(images.IMAGE_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    pairs = images.paired_changes(stream, "1 day")
    writer = pairs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(pairs.schema).parquet(f"{root}/out").collect()
    assert {(r.operation, r.row_key, str(r.old), str(r.new)) for r in found} == want
    assert len(found) == len(want) and {r.operation for r in found} == {"insert", "update", "delete"}


def test_state_is_held_by_buckets_and_turns_have_many_files(spark, monkeypatch):
    monkeypatch.setattr(images, "STATE_BUCKETS", 4)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [(k, h, "save", f"{h}") for k in range(60) for h in range(3)] + [(k, 5, "save", None) for k in range(9)]
    lines = [
        ("penalty", str(k), START + dt.timedelta(hours=h), kind, None if v is None else f'{{"v":"{v}"}}') for k, h, kind, v in rows
    ]
    found = spark.createDataFrame(lines, images.IMAGE_ROWS).repartition(3)
    files = images.write_in_turns(found, f"{root}/in", 2, F.xxhash64("row_key", "changed_at"))
    assert len(spark.read.parquet(f"{root}/in").inputFiles()) > 2
    images.write_in_turns(images.end_of_images(spark, START + dt.timedelta(days=9)), f"{root}/in", 1, F.lit(0))
    stream = spark.readStream.schema(images.IMAGE_ROWS).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    pairs = images.paired_changes(stream, "1 day")
    writer = pairs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(held) <= 4 + 1  # the end of the images has a bucket of its own
    operations = spark.read.schema(pairs.schema).parquet(f"{root}/out").groupBy("operation").count().collect()
    assert {r["operation"]: r["count"] for r in operations} == {"insert": 60, "update": 120, "delete": 9}
