"""Every drawing query with an SQL text, on the smallest tables."""

import pytest
from draftlens import queries as q
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, name):
    compare(spark, q.QUERIES[name], q.SQL[name], SF)


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(q.QUERIES) - set(q.SQL)):
        assert q.QUERIES[name](spark, SF).count() > 0, name
