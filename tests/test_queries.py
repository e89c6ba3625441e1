"""Every query with a SQL twin gives the twin's values; plans of the expression operators hold no Python."""

from pathlib import Path

import pytest
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harvestlens.operators import correlation, windows
from workloads import bases as b

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, con, name):
    assert difference(spark_rows(entry.queries()[name](spark, FOLDER)), duck_rows(con, entry.oracle_sql()[name])) is None


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm(spark):
    rows = b.yields(spark, FOLDER)
    keys = ["fips", "commodity_name"]
    frames = [
        windows.group_zscore(rows, keys, "yield_bu_ac", "z"), windows.leave_one_out_z(rows, keys, "yield_bu_ac", "z"),
        windows.fill_gaps(rows, keys, [F.col("day"), F.col("obs_id")], ["gappy_yield"]),
        windows.tie_ranks(rows, keys, "yield_bu_ac", "r"),
        correlation.pearson(b.merged(spark, FOLDER), "commodity_name", "yield_bu_ac", b.ACTIVE),
    ]
    for df in frames:
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text


def test_scans_are_pruned(spark):
    text = plan(b.daily(spark, FOLDER).groupBy("fips").agg(F.sum("tmax_c")))
    assert "l_extendedprice" not in text and "l_tax" not in text
