"""Exact search in blocks of queries."""

from pyspark.sql import functions as F

from siltstone.operators import search


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    chosen = rows.where("id % 4 = 0")
    whole = sorted(tuple(r)[:2] + (r.position,) for r in search.exact_top(rows, chosen, 3).collect())
    monkeypatch.setattr(search, "MAX_QUERIES", 20)
    assert chosen.count() > 20
    assert sorted(tuple(r)[:2] + (r.position,) for r in search.exact_top(rows, chosen, 3).collect()) == whole
