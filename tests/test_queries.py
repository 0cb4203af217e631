import os

import pytest

from tests.oracle import SF, check, views
from tickweave.plans import registry
from tickweave.runtime import release

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.SQL:
        check(spark, registry.QUERIES[name], registry.SQL[name], con)
    else:
        df = registry.QUERIES[name](spark, SF)
        df.write.format("noop").mode("overwrite").save()
        assert df.columns == sorted(set(df.columns), key=df.columns.index)
    release()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
