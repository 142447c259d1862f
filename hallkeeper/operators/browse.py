"""Table browsing: scans, search, labels, inventory and cascading deletes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import date_value, display_text, humanized, joined
from hallkeeper.functions.ranking import union_all
from hallkeeper.schemas import FOREIGN_KEYS, KEYS, MODULES, model_name
from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables

ROW_LIMIT = 300
"""Rows a browse page shows."""

# Columns tried, in order, for a row's label.
LABEL_COLUMNS = (
    "Name", "Title", "Subject", "BuildingName", "BuildingCode", "RoomNumber", "Code", "FirstName", "LastName",
    "Email", "RoleName", "ItemName", "SerialNumber", "Type", "Status",
)


def scan(t: Tables, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Some or all columns of a table."""
    return t[table].select(*columns) if columns else t[table]


def row_count(t: Tables, table: str, condition: Column | None = None) -> DataFrame:
    """One row (table_name, rows)."""
    rows = t[table] if condition is None else t[table].filter(condition)
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table_name"), "rows")


def table_inventory(t: Tables) -> DataFrame:
    """Row counts of every table by module: (module, position, table_name, label, rows)."""
    parts = []
    position = 0
    for module, names in MODULES.items():
        for name in names:
            if name in t:
                position += 1
                parts.append(
                    row_count(t, name).select(
                        F.lit(module).alias("module"),
                        F.lit(position).alias("position"),
                        "table_name",
                        humanized(F.lit(model_name(name))).alias("label"),
                        "rows",
                    )
                )
    return union_all(parts)


def _searchable(df: DataFrame, table: str) -> list[str]:
    """Text, date and key columns."""
    types = dict(df.dtypes)
    text = [c for c in df.columns if types[c] in ("string", "date", "timestamp", "timestamp_ntz")]
    return text + [c for c in KEYS.get(table, ()) if c not in text]


def matching_rows(t: Tables, table: str, term: str) -> DataFrame:
    """Rows in which any searchable column holds the term, ignoring case."""
    rows = t[table]
    term = term.strip().lower()
    if not term:
        return rows
    hits = [F.lower(F.col(c).cast("string")).contains(term) for c in _searchable(rows, table)]
    return rows.filter(reduce(or_, hits))


def search(t: Tables, table: str, term: str, limit: int = ROW_LIMIT) -> DataFrame:
    """A browse page: matching rows, newest key first, at most ``limit``."""
    return matching_rows(t, table, term).orderBy(*[F.desc(c) for c in KEYS[table]]).limit(limit)


def row_labels(t: Tables, table: str) -> DataFrame:
    """(row_key, label) of every row: full name, else two telling columns, else the key."""
    rows = t[table]
    key = KEYS[table][0]
    types = dict(rows.dtypes)

    def shown(column: str) -> Column:
        return display_text(column, types[column])

    tried = [shown(c) for c in LABEL_COLUMNS if c in rows.columns and c != key]
    telling = F.filter(F.array(*tried) if tried else F.array().cast("array<string>"), lambda v: v != "")
    label = F.coalesce(F.nullif(F.array_join(F.slice(telling, 1, 2), " / "), F.lit("")), shown(key))
    if "FirstName" in rows.columns and "LastName" in rows.columns:
        label = F.coalesce(joined(" ", F.col("FirstName"), F.col("LastName")), label)
    return rows.select(shown(key).alias("row_key"), label.alias("label"))


def display_rows(df: DataFrame) -> DataFrame:
    """Every column as shown text: the rows a CSV export writes."""
    return df.select(*[display_text(c, data_type) for c, data_type in df.dtypes])


def _children(table: str) -> list[tuple[str, str]]:
    """(child table, child column) pairs that refer to a table, self-references left out."""
    return [(child, column) for child, column, parent in FOREIGN_KEYS if parent == table and child != table]


def delete_order(roots: Sequence[str]) -> list[str]:
    """Tables reachable from the roots, every table before the tables it refers to."""
    reached, waiting = set(roots), list(roots)
    while waiting:
        for child, _ in _children(waiting.pop()):
            if child not in reached:
                reached.add(child)
                waiting.append(child)
    ordered: list[str] = []
    while len(ordered) < len(reached):
        left = [x for x in sorted(reached) if x not in ordered]
        free = [x for x in left if all(child in ordered or child not in reached for child, _ in _children(x))]
        ordered.append(free[0])
    return ordered


def cascade(t: Tables, table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Rows to delete by table, children first, when ``doomed`` rows of a table go.

    Foreign keys form no cycle, so each table is visited once, after every table
    it refers to: its doomed rows are those that refer to a doomed parent. Keys
    of tables with children of their own are worked out once and kept.
    """
    order = delete_order([table])
    keys = {table: cut_lineage(doomed.select(*KEYS[table]))}
    found = {table: doomed}
    for name in reversed(order):
        if name == table or name not in t:
            continue
        links = [
            (column, parent)
            for child, column, parent in FOREIGN_KEYS
            if child == name and parent in keys and parent != name and column in t[name].columns
        ]
        hits, rest = [], t[name]
        for column, parent in sorted(links, key=lambda link: link[1] != table):
            parents = keys[parent].select(F.col(KEYS[parent][0]).alias(column))
            hits.append(rest.join(parents, column, "left_semi").select(*t[name].columns))
            rest = rest.join(parents, column, "left_anti").select(*t[name].columns)
        if not hits:
            continue
        found[name] = union_all(hits)
        if _children(name):
            keys[name] = cut_lineage(found[name].select(*KEYS[name]))
            found[name] = t[name].join(keys[name], list(KEYS[name]), "left_semi").select(*t[name].columns)
    return {name: found[name] for name in order if name in found}


def cascade_keys(t: Tables, table: str, doomed: DataFrame) -> DataFrame:
    """(position, table_name, row_key) of every row a delete takes along, in delete order."""
    parts = []
    for position, (name, rows) in enumerate(cascade(t, table, doomed).items(), start=1):
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in KEYS[name]])
        parts.append(
            rows.select(F.lit(position).alias("position"), F.lit(name).alias("table_name"), key.alias("row_key"))
        )
    return union_all(parts)


def logs_closed_by_delete(t: Tables, doomed: DataFrame, as_of: dt.date) -> DataFrame:
    """Occupancy logs with open entries of the doomed assignments closed, as a delete does first."""
    keys = doomed.select("AssignmentID", F.lit(True).alias("__doomed")).distinct()
    closed = F.when(F.col("__doomed"), F.coalesce("EndDate", date_value(as_of))).otherwise(F.col("EndDate"))
    logs = t.occupancy_log.join(keys, "AssignmentID", "left")
    return logs.select(*[closed.alias(c) if c == "EndDate" else F.col(c) for c in t.occupancy_log.columns])


def delete_rows(t: Tables, table: str, doomed: DataFrame) -> Tables:
    """The tables without the doomed rows and everything that refers to them."""
    going = cascade(t, table, doomed)
    kept = {
        name: t[name].join(rows.select(*KEYS[name]), list(KEYS[name]), "left_anti").select(*t[name].columns)
        for name, rows in going.items()
    }
    return t.replacing(**kept)
