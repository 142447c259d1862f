"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution already splits skewed partitions when both sides of a join
come straight from a shuffle. It cannot when one side was aggregated on the join
key, because the aggregate sits between the shuffle and the join. For that case
``spread_join`` salts the hot keys only.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key is hot when it holds more than one thousandth of the rows, so there are fewer than 1000."""

HOT_ROWS = 200_000
"""Keys below this many rows fit a task whatever their share."""

SPREAD = 256
"""Slices a hot key is cut into."""


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys holding more than 1/HOT_SHARE of all rows: at most HOT_SHARE rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("__n") > HOT_ROWS) & (F.col("__n") * HOT_SHARE > total)).select(*keys)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_in: DataFrame | None = None,
    hot_on: Sequence[str] | None = None,
    known_rows: int | None = None,
    shuffled: bool = False,
) -> DataFrame:
    """Join many-rowed ``left`` to ``right``, which has one row per key.

    Hot keys of ``left`` are cut into SPREAD slices by a hash of the row and the
    matching row of ``right`` is repeated for each slice. The hot-key list is
    broadcast: it cannot exceed HOT_SHARE rows.

    ``hot_in`` names the rows to look for hot keys in when ``left`` is a join
    result, so that it is not worked out twice; ``hot_on`` a subset of the keys.
    A caller that has counted the rows and found too few for a hot key gets a
    plain join. ``shuffled`` keeps ``right`` from being broadcast.
    """
    if known_rows is not None and known_rows <= HOT_ROWS:
        return left.join(right.hint("merge") if shuffled else right, list(keys), how)
    keys, hot_on = list(keys), list(hot_on or keys)
    hot = F.broadcast(hot_keys(left if hot_in is None else hot_in, hot_on).withColumn("__hot", F.lit(True)))
    is_hot = F.coalesce(F.col("__hot"), F.lit(False))
    # Rows with a null key meet nothing wherever they go, so they needn't go to one place.
    no_key = functools.reduce(operator.or_, [F.col(c).isNull() for c in keys])
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    sliced = (
        left.join(hot, hot_on, "left")
        .withColumn("__slice", F.when(is_hot | no_key, F.pmod(row_hash, F.lit(SPREAD))).otherwise(0).cast("int"))
        .drop("__hot")
    )
    repeated = (
        right.join(hot, hot_on, "left")
        .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.when(is_hot, SPREAD - 1).otherwise(0))))
        .drop("__hot")
    )
    return sliced.join(repeated.hint("merge") if shuffled else repeated, [*keys, "__slice"], how).drop("__slice")


def sparse_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left``, many of whose keys may be null, by "left" or "left_anti".

    Rows without a key meet nothing, so a hash of the row deals them to all tasks; a plain join sends them to one.
    """
    keys = list(keys)
    no_key = functools.reduce(operator.or_, [F.col(c).isNull() for c in keys])
    # Equal keys of two integer types have equal text.
    key_hash = F.xxhash64(*[F.col(c).cast("string") for c in keys])
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    spread = left.withColumn("__spread", F.when(no_key, row_hash).otherwise(key_hash))
    return spread.join(right.withColumn("__spread", key_hash), [*keys, "__spread"], how).drop("__spread")
