"""Registered queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import pytest

from tessera.llm import queries
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = compare.run_spark(spark, queries.QUERIES[name], SF)
    assert got[1], "no rows"
    if name in queries.ORACLES:
        assert compare.difference(got, compare.run_sql(con, queries.ORACLES[name])) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
    assert 0 < docs.dropDuplicates(["doc_id"]).count() <= rows
    got = corpus_pipeline.run(spark, SF)
    assert got.filter("NOT round_trip").count() == 0
    assert got.count() == docs.count()
