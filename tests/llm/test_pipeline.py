"""The registered queries against SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import queries
from tests.llm import cases
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name], SF)


def test_stages_on_awkward_rows(spark):
    docs = cases.table(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("key"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == corpus_pipeline.COLUMNS and 0 < len(rows) <= docs.count(), name
        docs = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    junk = docs.where("text LIKE '%&&&%'").count()
    assert junk and kept.where("length(text) - length(replace(text, '&&&', '')) > 60").count() < junk
    assert kept.count() > 0.7 * docs.count()
    clean = stages["private_data"](spark, docs, SF)
    assert docs.where("text RLIKE '[0-9]@mail'").count() > 0 and clean.where("text RLIKE '[0-9]@mail'").count() == 0
    assert clean.count() == docs.count()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.collect()) == sorted(docs.collect())
