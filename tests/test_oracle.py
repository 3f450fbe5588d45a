"""Every query against its SQL twin, over whole tables."""

import pytest

from checks.catalogue import ORACLES, QUERIES
from checks.compare import difference, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF).cache()
    df.write.format("noop").mode("overwrite").save()  # every column, which a count would prune
    assert df.count() > 0
