"""Text lines read into keyed tables: rules compiled from a table's declared schema.

A table's schema, key and closed vocabularies say what a line must hold: a value for the key and for each column that is
never null, text that parses as the column's type, one of the allowed values. Lines that don't split into the table's
columns are kept as they came and reported, not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hallkeeper.functions.ranking import first_per_key
from hallkeeper.operators import rules
from hallkeeper.schemas import KEYS

_WHOLE = "__whole_line"
_LINE_NO = "__line_no"


def import_spec(table: str, schema: StructType) -> tuple[tuple[str, str, bool], ...]:
    """(column, type, required) of each column of a keyed table."""
    kinds = {"timestamp_ntz": "timestamp"}
    return tuple(
        (f.name, kinds.get(f.dataType.simpleString(), f.dataType.simpleString()), f.name in KEYS[table] or not f.nullable)
        for f in schema.fields
    )


def split_lines(lines: DataFrame, schema: StructType, line_no: str = "LineNo", line: str = "line") -> DataFrame:
    """Comma-separated lines as text columns; ``__whole_line`` holds a line that doesn't split into them, else null."""
    text = ", ".join(f"`{name}` string" for name in (*schema.names, _WHOLE))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _WHOLE}
    split = lines.select(
        F.col(line_no).alias(_LINE_NO),
        F.coalesce(line, F.lit("")).alias("__line"),
        F.from_csv(F.coalesce(line, F.lit("")), text, options).alias("f"),
    )
    blank = F.trim("__line") == ""
    whole = F.when(blank | F.col("f").isNull(), F.col("__line")).otherwise(F.col(f"f.{_WHOLE}"))
    return split.select(_LINE_NO, *[F.col(f"f.{f.name}").alias(f.name) for f in schema.fields], whole.alias(_WHOLE))


def line_rules(lines: DataFrame, table: str, schema: StructType) -> DataFrame:
    """Every broken rule of lines (LineNo, line): (table_name, row_key, rule, column_name, line).

    ``line`` is given for lines that couldn't be split. Null and blank lines are such lines.
    """
    split = split_lines(lines, schema)
    apart = split.filter(F.col(_WHOLE).isNull())
    broken = rules.import_rules(apart, table, _LINE_NO, import_spec(table, schema))
    whole = split.filter(F.col(_WHOLE).isNotNull()).select(
        F.lit(table).alias("table_name"),
        F.col(_LINE_NO).cast("string").alias("row_key"),
        F.lit("line_not_split").alias("rule"),
        F.lit(None).cast("string").alias("column_name"),
        F.col(_WHOLE).alias("line"),
    )
    return broken.withColumn("line", F.lit(None).cast("string")).unionByName(whole)


def line_rows(lines: DataFrame, table: str, schema: StructType) -> DataFrame:
    """Typed rows of the lines that break no rule; of lines with one key the first by number."""
    split = split_lines(lines, schema)
    bad = line_rules(lines, table, schema).select(F.col("row_key").alias("__bad")).distinct()
    good = split.join(bad, split[_LINE_NO].cast("string") == F.col("__bad"), "left_anti")
    typed = [rules.typed_text(n, k).cast(schema[n].dataType).alias(n) for n, k, _ in import_spec(table, schema)]
    key = list(KEYS[table])
    first = first_per_key(good.select(_LINE_NO, *typed), key, [F.asc(_LINE_NO)])
    return first.select(*schema.names)
