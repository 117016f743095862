"""Every query of the network engine that has a SQL twin gives its rows."""

import pytest
from conftest import same_rows

import genoloom.plans.files  # noqa: F401  registers its queries
from genoloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
