"""Every query against its SQL, and the shape of the driver contract."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect
from tabia.plans.queries import QUERIES
from tests.conftest import SMALL

@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.count() > 0 and result.columns == ["company_id", "customer_id", "bank_score", "risk_level", "rules_fired"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal_to_sql(spark, duck, name):
    message, rows, _, _ = compare(queries()[name](spark, SMALL), duck, oracle_sql()[name])
    assert message == "ok"
    assert rows > 0
