"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql
from workload.queries import QUERIES
from compare import difference, duck, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    assert difference(got, oracle_rows(con, oracle_sql()[name])) is None


def test_entry(spark):
    assert entry(spark).columns == ["o_id", "d_id", "path", "freq", "score"]
