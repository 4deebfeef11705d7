import pytest

import __spark_entry__
from tests.oracle import compare

QUERIES = {k: v for k, v in __spark_entry__.own_queries().items() if k in __spark_entry__.own_sql()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, QUERIES[name], __spark_entry__.own_sql()[name])
