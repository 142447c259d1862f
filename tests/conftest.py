from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from paths import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from hallkeeper.session import local_session

    session = local_session(4, "hallkeeper-tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small(spark):
    """Housing tables over the smallest test data."""
    from hallkeeper.sources.testdata import testdata_tables

    return testdata_tables(spark, SMALL)


@pytest.fixture
def table(spark):
    """Build a DataFrame from dicts; missing columns are null."""

    def build(schema: str, *rows: dict):
        from pyspark.sql.types import StructType

        names = [f.name for f in StructType.fromDDL(schema).fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return build
