import os

import pytest

from factloom.plans import registry

from ..oracle import differences

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, DIR, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""
