"""Tables on shared storage: Parquet in, Parquet, CSV and JSON out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hallkeeper.operators.browse import display_rows
from hallkeeper.tables import Tables


def parquet_tables(spark: SparkSession, root: str, names: Iterable[str]) -> Tables:
    """One Parquet folder per table under ``root``, read on first use."""

    def loader(name: str):
        return lambda: spark.read.parquet(f"{root.rstrip('/')}/{name}")

    return Tables({name: loader(name) for name in names})


def write_parquet(t: Tables, root: str, names: Iterable[str]) -> None:
    """Write tables as Parquet folders under a new root; an existing one is an error."""
    for name in names:
        t[name].write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{name}")


def append_rows(rows: DataFrame, root: str, name: str) -> None:
    """Append rows to a stored table."""
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as shown text: header, empty for null, ISO dates, datetimes with a space.

    Each task writes its own file with the header.
    """
    display_rows(df).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_json_documents(documents: DataFrame, path: str, column: str = "Document") -> None:
    """One JSON document per line from a text column."""
    documents.select(F.col(column).alias("value")).write.text(path)
