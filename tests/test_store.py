"""Copy-on-write tables, and repairs of what changes can reach."""

from __future__ import annotations

import pathlib
import random
import tempfile

import pytest
from check_oracles import normalized
from pyspark.sql import functions as F

from hallkeeper.operators.repairs import Moment
from hallkeeper.plans import reach, reconcile
from hallkeeper.plans.sample_changes import sample_images
from hallkeeper.schemas import KEYS
from hallkeeper.session import cut_lineage
from hallkeeper.sources.bucketed import BucketedTable, Store
from hallkeeper.sources.testdata import AS_OF, NOW
from hallkeeper.streaming import notices

AT = Moment(AS_OF, NOW)


@pytest.fixture
def folder():
    return pathlib.Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def files(table):
    return set(table.read().inputFiles())


def plain(df):
    return normalized(df.columns, [tuple(r) for r in df.collect()])


def test_a_merge_writes_only_buckets_with_changed_rows(spark, folder):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.lit(None).cast("date").alias("d"))
    table = BucketedTable(spark, str(folder), ["k"], 16).create(rows)
    before = files(table)
    assert len(before) == 16
    changed = spark.createDataFrame([(5, "new", None), (1000, "added", None), (6, "6", None)], "k long, v string, d date")
    written = table.merge(changed, spark.createDataFrame([(7,), (2000,)], "k long"), batch=3)
    # Row 6 is as it was, and there is no row 2000.
    assert 1 <= len(written) <= 3
    want = {(r.k, r.v) for r in rows.collect() if r.k not in (5, 7)} | {(5, "new"), (1000, "added")}
    assert {(r.k, r.v) for r in table.read().collect()} == want
    assert len(before - files(table)) == len(written)
    now = files(table)
    assert table.merge(changed, batch=3) == [] and files(table) == now  # a repeated batch
    assert table.merge(changed.filter("k = 6")) == [] and files(table) == now  # nothing differs
    assert {r.k for r in table.rows_of(spark.createDataFrame([(5,), (7,)], "k long")).collect()} == {5}


def test_empty_and_emptied_tables(spark, folder):
    empty = spark.createDataFrame([], "k long, v string")
    table = BucketedTable(spark, str(folder / "a"), ["k"], 4).create(empty)
    assert table.read().collect() == [] and table.read().columns == ["k", "v"]
    assert table.merge(empty, empty) == []
    table.merge(spark.createDataFrame([(1, "x")], "k long, v string"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "x")]
    table.merge(empty, spark.createDataFrame([(1,)], "k long"))
    assert table.read().collect() == []


def test_data_without_a_manifest_is_not_seen(spark, folder):
    table = BucketedTable(spark, str(folder), ["k"], 4).create(spark.range(20).withColumnRenamed("id", "k"))
    table._write(spark.range(100, 120).withColumnRenamed("id", "k"), 1)  # a writer that died before its manifest
    assert {r.k for r in table.read().collect()} == set(range(20))
    table.merge(spark.createDataFrame([(50,)], "k long"))
    assert {r.k for r in table.read().collect()} == {*range(20), 50}


def reached_tables():
    return sorted({n for g in reach.GROUPS for r, called in g.steps for n in (r.table, *r.also, *called)})


@pytest.fixture(scope="module")
def settled(small):
    t = reconcile.reconcile_after(small, {"room", "invoice"}, AT, make_moves=False)
    # Changes are by key, and payments of the test data share theirs.
    payments = t.payment_transaction.dropDuplicates(["TransactionID"])
    t = t.replacing(payment_transaction=payments)
    t = reconcile.reconcile_after(t, {"room", "invoice"}, AT, make_moves=False)
    return t.replacing(**{n: cut_lineage(t[n]) for n in reached_tables()})


def edited(t, seed):
    """Changed rows of many tables: as they were and as they are, and the tables with them."""
    rng = random.Random(seed)
    edits = {
        "room_assignment": {
            "Status": F.when(F.col("Status") == "Active", "Completed").otherwise("Active"),
            "RoomID": F.col("RoomID") + 1,
            "BedSlotID": F.when(F.col("AssignmentID") % 2 == 0, F.col("BedSlotID")),
        },
        "bed_slot": {"IsReserved": ~F.col("IsReserved")},
        "room": {"Capacity": F.col("Capacity") + 1, "LastInspectionDate": F.lit(None)},
        "occupancy_log": {"EndDate": F.lit(None)},
        "payment_transaction": {"PaymentStatus": F.lit("Completed")},
        "student": {"Email": F.lit("changed@example.org")},
        "room_inspection": {"Status": F.lit("Completed")},
        "maintenance_request": {"Status": F.lit("Resolved"), "ResolvedAt": F.lit(None)},
        "room_transfer": {"Status": F.lit("Completed"), "EffectiveMoveDate": F.date_sub("RequestDate", 900)},
        "penalty": {"Status": F.lit("Pending")},
        "building": {"LastMaintenanceDate": F.lit(None)},
    }
    touched, after = {}, {}
    for name, values in edits.items():
        key, part = KEYS[name][0], rng.randrange(23)
        kinds = dict(t[name].dtypes)
        hit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(23)) == part
        value = {c: v.cast(kinds[c]) for c, v in values.items()}
        new = t[name].select(*[F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in t[name].columns])
        after[name] = cut_lineage(new)
        touched[name] = cut_lineage(t[name].filter(hit).unionByName(after[name].filter(hit)))
    return touched, t.replacing(**after)


@pytest.mark.parametrize("seed", [1])
def test_repairs_of_what_changed_equal_the_whole_pipelines(settled, seed):
    touched, t = edited(settled, seed)
    whole = reconcile.reconcile_after(t, set(touched), AT, make_moves=False)
    reached = reach.reconcile_changed(t, touched, AT)
    assert set(reached.rows) >= {"room", "bed_slot", "room_assignment", "occupancy_log", "invoice", "system_user"}
    for name in reached_tables():
        rows = reached.rows.get(name)
        now = t[name] if rows is None else t[name].join(rows, KEYS[name][0], "left_anti").unionByName(rows)
        assert plain(now.select(*t[name].columns)) == plain(whole[name].select(*t[name].columns)), name


def test_untouched_rows_are_not_read_into_a_step(settled):
    one = settled.room_assignment.filter("Status = 'Active'").limit(1)
    scoped = reach._housing(settled, {"room_assignment": cut_lineage(one)})
    rooms = {r.RoomID for r in scoped.room.collect()}
    assert 1 <= len(rooms) <= 2
    assert scoped.room_assignment.count() < settled.room_assignment.count() / 10


def test_streamed_images_end_in_the_same_state_when_a_batch_is_repeated(spark, settled, folder):
    store = Store(spark, str(folder / "store"), {n: KEYS[n] for n in reached_tables()}, 4).create(settled)
    images = sample_images(settled, AT)
    notices.write_images(images, str(folder / "images"))
    stream = notices.read_images(spark, str(folder / "images"))
    notices.start_reconciling(stream, store, AT, str(folder / "batches"), str(folder / "progress")).awaitTermination()
    changed = {
        n: cut_lineage(settled[n].join(rows, KEYS[n][0], "left_anti").unionByName(rows)) for n, rows in images.items()
    }
    whole = reconcile.reconcile_after(settled.replacing(**changed), set(images), AT, make_moves=False)
    t = store.tables()
    for name in reached_tables():
        assert plain(t[name]) == plain(whole[name].select(*t[name].columns)), name
    # The same batch again, as after a failure before it was noted: another progress folder.
    versions = {n: store.table(n).manifest().version for n in store.keys}
    notices.start_reconciling(stream, store, AT, str(folder / "batches"), str(folder / "again")).awaitTermination()
    assert {n: store.table(n).manifest().version for n in store.keys} == versions


def test_a_bucket_is_written_by_many_tasks(spark, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = BucketedTable(spark, str(folder), ["k"], 2).create(spark.range(4000).select(F.col("id").alias("k")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files(table)) > 2
    assert sorted(r.k for r in table.read().collect()) == list(range(4000))
