from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, row_key string, ids string"


@pytest.fixture
def documents(spark):
    """Documents from texts, numbered from 0, with nulls in other columns and columns whose names clash."""

    def build(texts, repeat=0):
        rows = [(i, t, None if i % 2 else "en", None if i % 3 else "src0", None, "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows + rows[:repeat], SCHEMA)

    return build
