"""Every registered query against its SQL on the smallest data, in a session whose
time zone has daylight saving."""

import pytest
from harness import compare, connect

import __spark_entry__ as entry
from kerbside.plans import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
MODELS = [name for name in QUERIES if name not in ORACLES]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", MODELS)
def test_model_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns
    assert {"demand", "prediction", "hour_sin", "Latitude"} <= set(df.columns)


def test_names_say_what_they_do():
    assert set(ORACLES) <= set(entry.queries())
