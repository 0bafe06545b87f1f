"""Every query of the catalogue against its SQL on the small tables."""

import pytest

from palimpsest import catalogue

from .compare import compared, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    difference = compared(spark, con, SF, catalogue.queries()[name], catalogue.oracle_sql().get(name))
    assert difference in (None, "no rows"), difference


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(__spark_entry__.queries())
