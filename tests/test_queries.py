"""Every query against its SQL on the smallest tables."""

import pytest

from siltstone.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
