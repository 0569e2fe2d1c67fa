"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from checks import compare, oracles, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", queries.registry())
def test_query_matches_its_oracle(spark, oracle, name):
    assert name in oracles.registry()
    assert compare.compare(spark, oracle, SF_DIR, name) == ""
