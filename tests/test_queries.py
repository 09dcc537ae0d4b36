"""Every query against its SQL, as the driver does."""

import pytest

import __spark_entry__ as contract
from check import compare, open_tables
from segrisk.plans import catalog, oracles

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# At the small scale no crash is near a fanned-out segment, so the count modes differ only at the next one.
BOTH_SCALES = ["crash_count_rows", "crash_count_segments", "spatial_join_pairs"]


@pytest.mark.parametrize("name", catalog.queries())
def test_small(spark, name):
    same, detail = compare(spark, open_tables(SMALL), name, SMALL)
    assert same, detail


@pytest.mark.parametrize("name", BOTH_SCALES)
def test_medium(spark, name):
    same, detail = compare(spark, open_tables(MEDIUM), name, MEDIUM)
    assert same, detail


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10 and rows[0].crash_count >= rows[-1].crash_count > 0


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.queries()) - set(oracles.oracle_sql()) == {
        "rf_predictions", "poisson_predictions", "rf_road_class",
    }
