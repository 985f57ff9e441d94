"""Every registered query against its SQL equivalent, on tables large enough to give it rows."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from checks.registry import HOMES

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Models and portfolios need months of thirty tickers and more.
LARGE_HOMES = {"checks.model_queries", "checks.extra_queries", "checks.walkforward_queries"}


@pytest.fixture(scope="module")
def tables():
    made = {sf: duck(sf) for sf in (SMALL, LARGE)}
    yield made
    for con in made.values():
        con.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    sf = LARGE if HOMES.get(name) in LARGE_HOMES else SMALL
    ok, note = compare(
        spark, tables[sf], sf, name, entry.queries()[name], entry.oracle_sql().get(name)
    )
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
