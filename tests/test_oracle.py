"""Every registered query against its SQL on the smallest tables; the same check as ``python -m tests.oracle``."""

import os

import pytest

from tallyloom.plans import catalog
from tests.oracle import compare

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, SF_DIR, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, note
