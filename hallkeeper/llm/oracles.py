"""SQL for the queries that SQL can express."""

from __future__ import annotations

from hallkeeper.llm import lexical_search, licenses, spelling


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(),
        "op11_lexical_search": lexical_search.ORACLE,
        "op12_spelling_variants": spelling.ORACLE,
    }
