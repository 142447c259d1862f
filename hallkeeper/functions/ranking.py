"""Ranks and running totals that never gather a hot key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Where
one room or student may hold a third of all rows that task is the job. Here the
rows of a key are first cut into *cells*: order-preserving prefixes of the sort
key (a month, a day, a block of ids). Cells are counted with partial
aggregation, a small window turns the counts into offsets, and only the rows of
one cell are ever sorted together. The result is exact.

``first_per_key`` and ``top_per_key`` need no cells: Spark limits each map task
to k rows per key before the shuffle (``WindowGroupLimit``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BITS = 20
"""Unique ids put at most 2**ID_BITS rows in one cell."""

LOWEST = {
    "date": "DATE '0001-01-01'",
    "string": "''",
    "bigint": "-9223372036854775808L",
    "int": "CAST(-2147483648 AS INT)",
}
"""What a null cell counts as: like null, it sorts before every other value."""


@dataclass(frozen=True)
class Cell:
    """An order-preserving prefix of the sort key: a date, text or integer."""

    value: Column
    descending: bool = False


def id_block(column: str) -> Column:
    """The block of consecutive ids a row falls in."""
    return F.shiftright(F.col(column).cast("bigint"), ID_BITS)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    cells: Sequence[Cell],
    values: dict[str, Column],
    known_rows: int | None = None,
) -> DataFrame:
    """Add, per key, the sum of each value over all *earlier* rows.

    ``order`` must be total within a key and agree with ``cells``; keys are
    non-null. ``values`` maps output names to bigint expressions. When the
    caller has counted the rows and all of them together fit one cell, a plain
    window is as safe and has fewer steps.
    """
    keys = list(keys)
    if known_rows is not None and known_rows <= 1 << ID_BITS:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        return df.select(
            "*", *[F.coalesce(F.sum(v.cast("bigint")).over(window), zero).alias(out) for out, v in values.items()]
        )
    cell_names = [f"__cell{i}" for i in range(len(cells))]
    value_names = {name: f"__value_{name}" for name in values}
    tagged = df.select(
        "*",
        *[cell.value.alias(name) for name, cell in zip(cell_names, cells)],
        *[expression.cast("bigint").alias(value_names[name]) for name, expression in values.items()],
    )

    kinds = dict(tagged.dtypes)
    tagged = tagged.withColumns({n: F.coalesce(F.col(n), F.expr(LOWEST[kinds[n]])) for n in cell_names})

    def before(partition: list[str], ordering: list[Column], column: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0).cast("bigint"))

    # Totals per cell, then per ever shorter prefix; each level is far smaller.
    levels = [
        tagged.groupBy(*keys, *cell_names).agg(*[F.sum(v).alias(v) for v in value_names.values()])
    ]
    for depth in range(len(cells) - 1, 0, -1):
        levels.insert(
            0,
            levels[0].groupBy(*keys, *cell_names[:depth]).agg(*[F.sum(v).alias(v) for v in value_names.values()]),
        )

    offsets: DataFrame | None = None
    for depth, level in enumerate(levels):
        name, cell = cell_names[depth], cells[depth]
        ordering = [F.col(name).desc() if cell.descending else F.col(name).asc()]
        prefix = keys + cell_names[:depth]
        local = level.select(
            *prefix,
            name,
            *[before(prefix, ordering, v).alias(f"__offset_{out}") for out, v in value_names.items()],
        )
        if offsets is None:
            offsets = local
        else:
            outer = offsets.select(*prefix, *[F.col(f"__offset_{out}").alias(f"__outer_{out}") for out in values])
            offsets = local.join(outer, prefix).select(
                *prefix,
                name,
                *[(F.col(f"__offset_{out}") + F.col(f"__outer_{out}")).alias(f"__offset_{out}") for out in values],
            )

    place = keys + cell_names
    # The input may lie by ``keys`` already, which would do for the window and leave a hot key in one task.
    within = tagged.repartition(*place).select(
        "*", *[before(place, list(order), v).alias(out) for out, v in value_names.items()]
    )
    return within.join(offsets, place).select(
        *df.columns, *[(F.col(out) + F.col(f"__offset_{out}")).alias(out) for out in values]
    )


def row_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    cells: Sequence[Cell],
    out: str = "rn",
    known_rows: int | None = None,
) -> DataFrame:
    """``row_number()`` per key, exact, with no key gathered in one task."""
    ranked = running_totals(df, keys, order, cells, {out: F.lit(1)}, known_rows)
    return ranked.withColumn(out, F.col(out) + 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first ``k`` rows of each key; at most k rows per key and map task are shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per_key(df, keys, order, 1, "__first").drop("__first")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """``UNION ALL`` by column name."""
    return reduce(lambda left, right: left.unionByName(right), frames)
