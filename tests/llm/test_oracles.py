import os

import pytest

from tests.oracle import SF, compare, duck
from trackloom.llm import queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(), queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0
