"""Independent SQL for each registered query, written for the oracle engine."""

from __future__ import annotations

import re

from hallkeeper.sources.testdata import BASE_TABLES, PROJECTIONS

ORACLE_WORDS = {
    "ts": "TIMESTAMP",
    "beds": "JOIN (VALUES (1),(2),(3),(4)) AS v(i) ON v.i <= 1 + p_size % 4",
    **{name: name for name in BASE_TABLES},
}


def with_projections(body: str) -> str:
    """Prefix a query with the table projections its text refers to."""
    used = [name for name in PROJECTIONS if re.search(rf"\b{name}\b", body)]
    ctes = ",\n".join(f"{name} AS ({PROJECTIONS[name].format(**ORACLE_WORDS)})" for name in used)
    body = body.strip()
    if not used:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle_sql() -> dict[str, str]:
    from oracles import allocation, checks, finance, listings, moves, repairs, rules, snapshots, views

    bodies: dict[str, str] = {}
    for module in (allocation, checks, finance, listings, moves, repairs, rules, snapshots, views):
        bodies.update(module.oracles())
    return {name: with_projections(body) for name, body in bodies.items()}
