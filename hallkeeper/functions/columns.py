"""Reusable column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def date_value(value: dt.date | Column) -> Column:
    """A date parameter as a column."""
    return value if isinstance(value, Column) else F.lit(value)


def time_value(value: dt.datetime | Column) -> Column:
    """A zone-free timestamp parameter as a column."""
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def valid_at(start: Column, end: Column, moment: Column) -> Column:
    """Started, and either open-ended or not yet over."""
    return (start <= moment) & (end.isNull() | (end >= moment))


def nonneg(value: Column) -> Column:
    """Floor at zero, keeping null null (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0)))


def billed_total() -> Column:
    """Invoice total: amount plus tax plus late fee minus discount."""
    return F.col("TotalAmount") + F.col("TaxAmount") + F.col("LateFee") - F.col("DiscountAmount")


def money(value: Column) -> Column:
    """Sums of money with a stated width."""
    return value.cast(MONEY)


def zero_money() -> Column:
    return F.lit(0).cast(MONEY)


def full_name(first: str = "FirstName", last: str = "LastName") -> Column:
    """``first last``; null when either part is null."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def joined(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty; null when none is left."""
    kept = F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p.isNotNull() & (p != ""))
    text = F.array_join(kept, separator)
    return F.when(text != "", text)


def percent_text(part: Column, whole: Column) -> Column:
    """Half-even rounded percentage as text; a zero whole gives ``0%``."""
    share = F.bround(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 0).cast("bigint")
    return F.concat(F.coalesce(share, F.lit(0)).cast("string"), F.lit("%"))


def status_rank(column: str, order: Sequence[str]) -> Column:
    """Position of a status in ``order``, starting at 1; anything else comes last."""
    rank = F.when(F.col(column) == order[0], 1)
    for position, value in enumerate(order[1:], start=2):
        rank = rank.when(F.col(column) == value, position)
    return rank.otherwise(len(order) + 1)


def display_sql(reference: str, data_type: str) -> str:
    """SQL for the shown text of a quoted column: datetimes use a space, booleans are 1 and 0."""
    if data_type.startswith("timestamp"):
        micros = f"date_format({reference}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        return f"regexp_replace({micros}, '\\\\.000000$', '')"
    if data_type == "boolean":
        return f"CAST(CAST({reference} AS INT) AS STRING)"
    return f"CAST({reference} AS STRING)"


def display_text(column: str, data_type: str) -> Column:
    """Shown text of a cell; null is empty."""
    return F.expr(f"coalesce({display_sql(f'`{column}`', data_type)}, '')").alias(column)


def humanized(name: Column) -> Column:
    """CamelCase or snake_case identifiers as words."""
    spaced = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "(?<!^)(?=[A-Z])", " ")
    joined_acronyms = F.replace(F.replace(spaced, F.lit(" I D"), F.lit(" ID")), F.lit(" Z I P"), F.lit(" ZIP"))
    return F.trim(F.regexp_replace(joined_acronyms, "\\s+", " "))


def shortened(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, ending in an ellipsis when cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def initials(first: Column, last: Column) -> Column:
    return F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1)))


def status_slug(text: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")


def text_or(text: Column, default: str) -> Column:
    """The text, or ``default`` when null or blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def enum_literals(column_type: Column) -> Column:
    """Values of an ``enum('a','b')`` column type; empty for other types."""
    quoted = F.regexp_extract_all(column_type, F.lit("'((?:[^']|'')*)'"), F.lit(1))
    values = F.transform(quoted, lambda v: F.replace(v, F.lit("''"), F.lit("'")))
    return F.when(F.lower(column_type).startswith("enum("), values).otherwise(F.array().cast("array<string>"))


def normalized_email(text: Column) -> Column:
    return F.lower(F.trim(text))
