import os

import pytest

from tests.oracle import SF, check, views
from tickweave.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.SQL:
        check(spark, queries.QUERIES[name], queries.SQL[name], con)
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0
