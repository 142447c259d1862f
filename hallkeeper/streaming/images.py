"""Row changes from a stream of row images: state holds the last image of each row, by buckets of row keys.

An image says what a row holds from a moment on. Images of a row may arrive in any order within a delay; they wait in
the row's state until the watermark has passed them and are then taken in order of their moment, each next to the one
before it. That gives the changes two snapshots would give, for every moment between them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from hallkeeper.functions.columns import display_sql
from hallkeeper.schemas import KEYS
from hallkeeper.session import new_folder

IMAGE_ROWS = "table_name string, row_key string, changed_at timestamp, kind string, image string"

KINDS = ("base", "save", "delete")
"""A row as it was found, which is no change; as it was saved; as it was when it was deleted. In order of equal moments."""

STATE_BUCKETS = 1024
"""Buckets a table's row keys are dealt to. Python is called once per bucket and batch, not once per row; a batch reads
and writes the state of the buckets it has rows for."""


def row_images(table: str, rows: DataFrame, changed_at: Column, kind: str) -> DataFrame:
    """Images of whole rows; values are shown text, nulls stay null."""
    pairs = ", ".join(f"'{c}', {display_sql(f'`{c}`', t)}" for c, t in rows.dtypes)
    return rows.select(
        F.lit(table).alias("table_name"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS[table]]).alias("row_key"),
        changed_at.cast("timestamp").alias("changed_at"),
        F.lit(kind).alias("kind"),
        F.to_json(F.expr(f"map({pairs})"), {"ignoreNullFields": "false"}).alias("image"),
    )


def paired_changes(images: DataFrame, delay: str) -> DataFrame:
    """Changes (table_name, operation, row_key, changed_at, old, new) from a stream of images; old and new are maps.

    Images that come more than ``delay`` after a later one of the stream are late: they are passed over, as what
    followed them has been given out. Images of one row and moment go by KINDS, then text. An image equal to the one
    before it is no change, nor is the deletion of an unknown row. State grows with the rows that exist, and holds as
    many images of a row as fall within the delay; rows that are gone leave nothing behind.
    """
    kinds = list(KINDS)

    def pair(key, frames, state):
        import pickle
        import zlib

        import pandas as pd

        # Per row key: the last image, and the images [moment, kind, image] that wait for the watermark.
        rows = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        if not state.hasTimedOut:
            for frame in frames:
                moments = frame["changed_at"].astype("datetime64[us]").astype("int64")
                for row, m, k, i in zip(frame["row_key"], moments, frame["kind"], frame["image"]):
                    rows.setdefault(row, [None, []])[1].append([int(m), kinds.index(k), i])
        passed = state.getCurrentWatermarkMs() * 1000
        out, gone, earliest = [], [], None
        for row, held in rows.items():
            last, waiting = held
            if waiting:
                waiting.sort(key=lambda w: (w[0], w[1], w[2] is not None, w[2]))
                ready = [w for w in waiting if w[0] <= passed]
                waiting = waiting[len(ready) :]
                for moment, kind, image in ready:
                    new = None if kinds[kind] == "delete" else image
                    if kinds[kind] != "base" and new != last:
                        operation = "insert" if last is None else "delete" if new is None else "update"
                        out.append((key[0], operation, row, moment, last, new))
                    last = new
                held[:] = last, waiting
            if waiting:
                earliest = waiting[0][0] if earliest is None else min(earliest, waiting[0][0])
            elif last is None:
                gone.append(row)
        for row in gone:
            del rows[row]
        if rows:
            state.update((zlib.compress(pickle.dumps(rows, protocol=5), 1),))
            if earliest is not None:
                state.setTimeoutTimestamp(earliest // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            columns = ["table_name", "operation", "row_key", "moment", "old", "new"]
            yield pd.DataFrame(out, columns=columns).astype({"moment": "int64"})

    bucket = F.pmod(F.xxhash64("row_key"), F.lit(STATE_BUCKETS)).cast("int")
    paired = (
        images.withWatermark("changed_at", delay)
        .withColumn("bucket", bucket)
        .groupBy("table_name", "bucket")
        .applyInPandasWithState(
            pair,
            "table_name string, operation string, row_key string, moment long, old string, new string",
            "rows binary",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    old, new = (F.from_json(c, "map<string,string>").alias(c) for c in ("old", "new"))
    return paired.select("table_name", "operation", "row_key", F.timestamp_micros("moment").alias("changed_at"), old, new)


def write_in_turns(images: DataFrame, path: str, turns: int, order: Column) -> int:
    """Write images as files that a stream reads one turn after the other; ``order`` deals the rows to the turns.

    Every task writes files of its own. Gives the most files of a turn, for the stream's ``maxFilesPerTrigger``.
    """
    # The images are worked out once and parted by turn, so that each turn reads its own part only.
    staged = new_folder(images.sparkSession, "turns")
    images.withColumn("turn", F.pmod(order, F.lit(turns)).cast("int")).write.partitionBy("turn").parquet(staged)
    read = images.sparkSession.read.schema(f"{IMAGE_ROWS}, turn int")
    most = 1
    for turn in range(turns):
        rows = read.parquet(staged).filter(F.col("turn") == turn).drop("turn")
        most = max(most, rows.rdd.getNumPartitions())
        rows.write.mode("append").parquet(path)
    return most


def end_of_images(spark, after: dt.datetime) -> DataFrame:
    """One image of no table, whose moment lets the watermark pass all before it; it is never paired itself."""
    return spark.createDataFrame([("", "", after, "base", None)], IMAGE_ROWS)
