"""Registered queries on tables whose last locations lack a partner or a subject."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import prior_queries, spatial_queries


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Embeddings up to a number, as a table folder."""
    def make(n):
        folder = str(tmp_path_factory.mktemp(f"first{n}"))
        rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
        step = rows.agg(F.max("vec_id")).first()[0] + 1
        more = rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + step))
        more.where(F.col("vec_id") < n).write.parquet(f"{folder}/embeddings.parquet")
        return folder
    return make


def test_pairs_keep_a_location_without_its_partner(spark, cut):
    # Vectors 0 to 55: location 11 has only subject 0; subjects 1 to 4 have location 10 alone.
    got = spatial_queries.potts_duo_exact(spark, cut(56)).where("pair = 10").collect()
    assert len(got) == 5 * 10
    for r in got:
        assert r["u1"] is not None and (r["u2"] is None) == (r["agree"] is None) == (r["subj_id"] > 0)


def test_a_node_gives_its_posterior_to_both_locations(spark, cut):
    # Subjects 1 to 4 have no data at location 11, the partner of location 10.
    folder = cut(56)
    want = prior_queries.symmetric_map_roundtrip(spark, folder)
    got = prior_queries.symmetric_estep(spark, folder)
    assert got.count() == 5 * 12 * 10 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    same = prior_queries.symmetric_same_parcels_estep(spark, folder)
    assert same.count() == 5 * 12 * 10
    left, right = ({(r["subj_id"], r["k"]): r["p"] for r in same.where(F.col("vox_id") == v).collect()} for v in (10, 11))
    assert left == right


def test_a_location_without_a_partner_keeps_its_side(spark, cut):
    # Vectors 0 to 54: location 10 is the left one of a pair without a right one.
    folder = cut(55)
    for query in (prior_queries.symmetric_estep, prior_queries.symmetric_map_roundtrip):
        rows = query(spark, folder).where("vox_id = 10").collect()
        assert len(rows) == 50 and all(r["p"] == 0 for r in rows if r["k"] >= 5)
    table = prior_queries.pair_layout(spark, folder).table
    assert [(r["vox_id"], r["side"]) for r in table.where("node_id = 10").collect()] == [(10, 0)]
