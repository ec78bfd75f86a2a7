import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from eventtally.plans.oracles import ORACLES
from eventtally.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


CORE = [query.__name__ for query in QUERIES]


def test_every_query_has_its_sql():
    assert set(CORE) == set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket", "total_count", "unique_user_count"] and df.count() > 0
