"""Grant limited things in order: seats, beds, ids, one place per student.

Rows are served one after the other in a total order; a row is granted when
every thing it claims still has room, otherwise it is passed over and takes
nothing. The outcome equals that one-by-one service, but rows are decided in a
few rounds over all rows at once: with the number of earlier granted and earlier
undecided rows per thing known, a row is certain to win when it fits even if all
earlier undecided rows win, and certain to lose when granted ones alone fill the
limit. The first undecided row is always certain, so every round makes progress.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.ranking import Cell, running_totals
from hallkeeper.session import Journal, cut_lineage


@dataclass(frozen=True)
class Claim:
    """What a row claims one unit of: key columns (null: nothing) and a limit column."""

    name: str
    keys: tuple[str, ...]
    limit: Column

    @property
    def granted(self) -> str:
        return f"__granted_{self.name}"

    @property
    def open(self) -> str:
        return f"__open_{self.name}"


_KEY = "__claimed"


def _claimed(claim: Claim, row_id: str) -> Column:
    """What a row claims as one text; a row that claims nothing is a key of its own, so such rows meet nowhere."""
    has_key = reduce(and_, [F.col(k).isNotNull() for k in claim.keys])
    if len(claim.keys) == 1:
        text = F.col(claim.keys[0]).cast("string")
    else:
        text = F.to_json(F.struct(*claim.keys))
    return F.when(has_key, F.concat(F.lit("k"), text)).otherwise(F.concat(F.lit("r"), F.col(row_id).cast("string")))


def _with_totals(
    rows: DataFrame,
    row_id: str,
    claims: Sequence[Claim],
    order: Sequence[Column],
    cells: Sequence[Cell],
    known_rows: int,
) -> DataFrame:
    """Add, per claim, the earlier granted and earlier undecided rows."""
    judged = rows
    for claim in claims:
        values = {claim.granted: F.col("__granted"), claim.open: F.col("__open")}
        keyed = judged.withColumn(_KEY, _claimed(claim, row_id))
        judged = running_totals(keyed, [_KEY], order, cells, values, known_rows).drop(_KEY)
    return judged


def _beside(granted: DataFrame, still_open: DataFrame, row_id: str, claims: Sequence[Claim]) -> DataFrame:
    """Granted rows that hold something an undecided row claims, once each."""
    parts = []
    for claim in claims:
        wanted = still_open.select(*claim.keys).distinct()
        parts.append(granted.join(wanted, list(claim.keys), "left_semi").select(*granted.columns))
    return reduce(DataFrame.unionByName, parts).dropDuplicates([row_id])


def grant_in_order(
    rows: DataFrame, row_id: str, order: Sequence[Column], cells: Sequence[Cell], claims: Sequence[Claim]
) -> DataFrame:
    """Add ``Granted`` and, per claim, ``__granted_<name>``: how many earlier rows hold it.

    ``rows`` should be cheap to read again (cut from its lineage). A round ranks the undecided rows and the granted
    ones that share a claim with them; rows that are certain to lose, and granted rows nobody undecided meets, are set
    aside. Granted rows go to a journal, the counts of all rows are taken once at the end.
    """
    columns = rows.columns
    spark = rows.sparkSession
    granted = Journal(spark, "granted", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
    still_open, work, number = rows, rows.withColumns({"__granted": F.lit(0), "__open": F.lit(1)}), 0
    total = rows.count()
    known_rows = total
    while known_rows:
        number += 1
        wins = reduce(and_, [F.col(c.granted) + F.col(c.open) < c.limit for c in claims])
        loses = reduce(or_, [F.col(c.granted) >= c.limit for c in claims])
        judged = _with_totals(work, row_id, claims, order, cells, known_rows).filter(F.col("__open") == 1)
        decided = cut_lineage(judged.filter(wins | ~loses).select(*columns, wins.alias("__wins")))
        granted.append(decided.filter("__wins"), number)
        still_open = decided.filter(~F.col("__wins")).select(*columns)
        if still_open.isEmpty():
            break
        near = _beside(granted.rows().select(*columns), still_open, row_id, claims)
        work = cut_lineage(
            still_open.withColumns({"__granted": F.lit(0), "__open": F.lit(1)}).unionByName(
                near.withColumns({"__granted": F.lit(1), "__open": F.lit(0)})
            )
        )
        known_rows = work.count()
    won = granted.rows().select(row_id, F.lit(1).alias("__granted"))
    state = rows.join(won, row_id, "left").withColumns(
        {"__granted": F.coalesce("__granted", F.lit(0)), "__open": F.lit(0)}
    )
    final = _with_totals(state, row_id, claims, order, cells, total)
    return final.select(*columns, (F.col("__granted") == 1).alias("Granted"), *[c.granted for c in claims])
