import pytest
from oracle import compare, duck

from veilgram.plans.catalogue import QUERIES
from veilgram.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF) >= 0
    else:
        assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 96
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
