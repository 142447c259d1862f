"""Ranking, skew joins and ordered claims against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hallkeeper.functions import ranking, skew
from hallkeeper.functions.claims import Claim, grant_in_order
from hallkeeper.functions.ranking import Cell, id_block, row_rank, running_totals, top_per_key
from hallkeeper.functions.skew import spread_join
from hallkeeper.session import cut_lineage


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "ID_BITS", 2)


def rows_with_hot_key(seed: int, n: int = 300):
    """(key, day, id, value): a third of the rows share one key."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(1 if i % 3 == 0 else rng.randrange(2, 9), rng.randrange(5), ids[i], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("known_rows", [None, 3, 10**9])
def test_row_rank_is_exact_with_a_hot_key(spark, tiny_blocks, descending, known_rows):
    rows = rows_with_hot_key(7)
    df = spark.createDataFrame(rows, "key int, day int, id bigint, value int").repartition(7)
    order = [F.desc("day"), F.desc("id")] if descending else [F.asc("day"), F.asc("id")]
    cells = [Cell(F.col("day"), descending), Cell(id_block("id"), descending)]
    got = {(r.key, r.id): r.rn for r in row_rank(df, ["key"], order, cells, known_rows=known_rows).collect()}
    want, per_key = {}, defaultdict(int)
    for key, day, row_id, _ in sorted(rows, key=lambda r: (r[1], r[2]), reverse=descending):
        per_key[key] += 1
        want[key, row_id] = per_key[key]
    assert got == want


def test_running_totals_sum_earlier_rows_only(spark, tiny_blocks):
    rows = rows_with_hot_key(11)
    df = spark.createDataFrame(rows, "key int, day int, id bigint, value int")
    cells = [Cell(F.col("day")), Cell(id_block("id"))]
    totals = running_totals(df, ["key"], [F.asc("day"), F.asc("id")], cells, {"before": F.col("value"), "n": F.lit(1)})
    got = {(r.key, r.id): (r.before, r.n) for r in totals.collect()}
    sums, want = defaultdict(lambda: (0, 0)), {}
    for key, _, row_id, value in sorted(rows, key=lambda r: (r[1], r[2])):
        want[key, row_id] = sums[key]
        sums[key] = (sums[key][0] + value, sums[key][1] + 1)
    assert got == want


def test_no_task_ranks_more_than_one_cell(spark, tiny_blocks):
    """Row windows are partitioned by key and cells, never by the key alone."""
    df = spark.createDataFrame(rows_with_hot_key(3), "key int, day int, id bigint, value int")
    ranked = row_rank(df, ["key"], [F.asc("day"), F.asc("id")], [Cell(F.col("day")), Cell(id_block("id"))])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [line for line in windows if "id#" in line]
    assert len(windows) == 3 and len(over_rows) == 1
    assert "__cell0" in over_rows[0] and "__cell1" in over_rows[0]


def test_rows_without_a_date_are_ranked_too(spark):
    rows = [(1, None, 1), (1, 5, 2), (1, None, 3), (1, 4, 4)]
    df = spark.createDataFrame(rows, "key int, day int, id bigint")
    cells = [Cell(F.col("day"), True), Cell(id_block("id"), True)]
    ranked = row_rank(df, ["key"], [F.desc("day"), F.desc("id")], cells)
    assert {r.id: r.rn for r in ranked.collect()} == {2: 1, 4: 2, 3: 3, 1: 4}


def test_id_blocks_are_exact_for_large_ids(spark):
    big = 2**62
    df = spark.createDataFrame([(big,), (big + 2**20 - 1,), (big + 2**20,), (-1,)], "id bigint")
    assert [r[0] for r in df.select(id_block("id")).collect()] == [2**42, 2**42, 2**42 + 1, -1]


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("key"), "id")
    top = top_per_key(df, ["key"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r.id for r in top.collect()) == [94, 95, 96, 97, 98, 99]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_a_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "SPREAD", 8)
    rows = rows_with_hot_key(5)
    left = spark.createDataFrame(rows, "key int, day int, id bigint, value int")
    left = left.unionByName(spark.createDataFrame([(None, 1, -1, 0)], left.schema))
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 6)], "key int, name int")
    assert skew.hot_keys(left, ["key"]).count() > 1
    got = sorted(map(tuple, spread_join(left, right, ["key"], how).select("id", "key", "name").collect()), key=str)
    want = sorted(map(tuple, left.join(right, "key", how).select("id", "key", "name").collect()), key=str)
    assert got == want


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_sparse_join_equals_a_plain_join_and_deals_null_keys_to_many_tasks(spark, how):
    rows = [(i, None if i % 4 else i % 6) for i in range(400)]
    left = spark.createDataFrame(rows, "id bigint, key int")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (None, "c")], "key bigint, name string").hint("merge")
    got = skew.sparse_join(left, right, ["key"], how)
    want = left.join(right, "key", how)
    assert sorted(map(tuple, got.select("id", *got.columns).collect()), key=str) == sorted(
        map(tuple, want.select("id", *want.columns).collect()), key=str
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = got.filter("key IS NULL").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert places > 1


def test_hot_rows_are_spread_over_slices(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    left = spark.range(1000).select(F.lit(1).alias("key"), "id")
    right = spark.createDataFrame([(1, "a")], "key int, name string")
    joined = spread_join(left, right, ["key"])
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__slice" in plan


@pytest.mark.parametrize("seed", range(3))
def test_grants_equal_one_by_one_service(spark, monkeypatch, tiny_blocks, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        room = 1 if i % 3 == 0 else rng.randrange(2, 12)
        bed = rng.choice([None, room * 10 + rng.randrange(3)])
        rows.append((i, rng.randrange(4), rng.randrange(25), room, 1 + room % 4, bed))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, day int, student int, room int, seats int, bed int")
    claims = [
        Claim("student", ("student",), F.lit(1)),
        Claim("room", ("room",), F.col("seats")),
        Claim("bed", ("bed",), F.lit(1)),
    ]
    cells = [Cell(F.col("day")), Cell(id_block("id"))]
    served = grant_in_order(df, "id", [F.asc("day"), F.asc("id")], cells, claims)
    got = {r.id for r in served.collect() if r.Granted}
    students, rooms, beds, want = set(), defaultdict(int), set(), set()
    for row_id, _, student, room, seats, bed in sorted(rows, key=lambda r: (r[1], r[0])):
        if student not in students and rooms[room] < seats and (bed is None or bed not in beds):
            want.add(row_id)
            students.add(student)
            rooms[room] += 1
            beds.add(bed)
    assert got == want


def test_later_rounds_rank_only_what_is_undecided(spark, monkeypatch):
    """A chain that is settled one by one next to many rows that are certain at once."""
    from hallkeeper.functions import claims as module

    # Each row of the chain shares one thing with the row before it and another with the row after it.
    chain = [(i, f"a{i // 2}", f"a{(i + 1) // 2}") for i in range(8)]
    rows = chain + [(100 + i, f"b{i}", None) for i in range(300)] + [(1000 + i, f"b{i}", None) for i in range(300)]
    df = cut_lineage(spark.createDataFrame(rows, "id bigint, x string, y string"))
    ranked = []
    real = module._with_totals
    monkeypatch.setattr(module, "_with_totals", lambda rows, *a: (ranked.append(rows.count()), real(rows, *a))[1])
    claims = [Claim("x", ("x",), F.lit(1)), Claim("y", ("y",), F.lit(1))]
    served = grant_in_order(df, "id", [F.asc("id")], [Cell(id_block("id"))], claims)
    granted = {r.id for r in served.collect() if r.Granted}
    taken, want = set(), set()
    for i, x, y in sorted(rows):
        things = {("x", x)} | ({("y", y)} if y else set())
        if not things & taken:
            want.add(i)
            taken |= things
    assert granted == want
    assert ranked[0] == ranked[-1] == len(rows) and len(ranked) >= 5
    assert all(n <= len(chain) for n in ranked[2:-1])
    assert sorted(ranked[:-1], reverse=True) == ranked[:-1]
