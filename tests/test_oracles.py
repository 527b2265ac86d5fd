"""Every registered query against its SQL statement."""

import pytest

from stratafold.registry.oracles import ORACLES
from stratafold.registry.queries import QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, con, sf_dir, name):
    assert differences(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.columns == ["customer_id", "company_name", "plan", "segment", "total_events"]
    assert result.count() == 10
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
