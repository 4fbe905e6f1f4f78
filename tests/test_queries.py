"""Every query with SQL equals its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from millrace.compare import compare
from millrace.plans import problem_queries, star_queries

NAMES = sorted({**star_queries.SQL, **problem_queries.SQL})


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, name, sf_dir) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
