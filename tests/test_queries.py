"""Every registered query against its SQL on the smallest tables."""

import pytest

from tessera import plans
from tests import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = compare.run_spark(spark, QUERIES[name], SF)
    assert got[1], "no rows"
    if name in ORACLES:
        assert compare.difference(got, compare.run_sql(con, ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["subj_id", "vox_id", "k", "p"]
