import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyhouse.session import build_session  # noqa: E402
from tallyhouse.sources.tables import RetailTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small(spark):
    return RetailTables(spark, SMALL, store_facts=True)


@pytest.fixture
def tables(spark):
    """Tables made of the given DataFrames only."""
    return lambda **frames: RetailTables(spark, SMALL, frames)


def rows(df, *order):
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=repr) if not order else found
