"""Every query of the library against its SQL."""

import pytest

from graphloom import catalogue

from .conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_is_its_sql(spark, sf, name):
    same_as_sql(spark, catalogue.queries()[name], catalogue.oracles()[name], sf)


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) >= {"nodes", "edge_ids", "severity"}
