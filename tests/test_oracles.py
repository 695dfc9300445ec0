import os

import pytest

import __spark_entry__ as entry
from tests.oracle import SF, compare, duck
from trackloom import queries_core, queries_lookup, queries_passes, queries_repair, queries_tracks

OWN = {k: (m.QUERIES[k], s) for m in (queries_core, queries_repair, queries_passes, queries_lookup, queries_tracks) for k, s in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, *OWN[name]) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 88 and set(entry.oracle_sql()) <= set(entry.queries())
