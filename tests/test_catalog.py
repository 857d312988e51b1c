"""Registered queries against their SQL twins on the smallest tables ."""
import os

import pytest

from tests.check_oracle import compare, connect
from vacantia.plans.catalog import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(catalog())))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, catalog()[name]) is None


def test_every_query_has_sql():
    assert all(sql for _, sql in catalog().values())
