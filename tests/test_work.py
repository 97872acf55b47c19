import pytest
from pyspark.sql import functions as F

from siltstone.operators import journal, workflow
from siltstone.streaming import events


def test_chain_orders_and_refuses_cycles(spark):
    blocks = spark.createDataFrame([(i, i - 1 if i else None) for i in range(37)], "block_id long, previous_block_id long")
    heads = spark.createDataFrame([(36,)], "block_id long")
    assert {r.block_id: r.steps for r in journal.chain(blocks, heads).collect()} == {i: 36 - i for i in range(37)}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "block_id long, previous_block_id long")
    with pytest.raises(ValueError):
        journal.chain(loop, spark.createDataFrame([(1,)], "block_id long"))


def test_replay_order_and_conflicts(spark):
    rows = spark.createDataFrame([("c", "1"), ("a", "1"), ("b", "1"), ("a", "1"), ("b", "2")], "block_id string, digest string")
    assert [tuple(r) for r in journal.replay_order(rows).collect()] == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    assert [r.block_id for r in journal.replay_conflicts(rows).collect()] == ["b"]


def test_oversized_record_fails(spark):
    rows = spark.createDataFrame([(1, 0, 99)], "journal long, seq long, n_bytes long")
    with pytest.raises(Exception, match="maximum payload"):
        journal.journal_blocks(rows, limit=60).collect()


def test_fragments_are_bounded_and_counted_once(spark):
    ids = spark.range(101).select(F.sha2(F.col("id").cast("string"), 256).alias("block_id"))
    rows = journal.outcome_fragments(ids.union(ids), 10, 5).collect()
    assert len(rows) == 101 and {r.fragment for r in rows} == set(range(11))
    assert all(r.input_block_count == (5 if r.fragment == 0 else 0) for r in rows)
    assert [r.block_id for r in sorted(rows, key=lambda r: (r.fragment, r.block_id))] == sorted(r.block_id for r in rows)


def test_missing_embeddings_are_asked_for_once(spark):
    items = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "input_hash string, text string")
    known = spark.createDataFrame([("h2", [9.0])], "input_hash string, embedding array<float>")
    out = journal.embed_missing(items, known, lambda texts: [[float(len(t))] for t in texts], 1)
    assert sorted((r.input_hash, r.embedding) for r in out.collect()) == [("h1", [1.0]), ("h2", [9.0])]


def test_pass_diagnosis(spark):
    rows = spark.createDataFrame([(1, 10, 2), (2, 10, 4), (3, 10, 4), (4, 20, 5), (5, 20, 3)], "pass_no long, planned long, terminal long")
    assert [r.verdict for r in workflow.pass_diagnosis(rows).orderBy("pass_no").collect()] == ["inconclusive", "converging", "not-converging", "inconclusive", "not-converging"]


def test_stages_rank(spark):
    rows = spark.createDataFrame([("embedding",), ("nope",), ("terminal-failure",)], "s string").select(workflow.rank_of(F.col("s")).alias("r"))
    assert [r.r for r in rows.collect()] == [3, None, 6]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 7).alias("key"))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = events.file_stream(spark, f"file://{tmp_path}/in", rows.schema)
    table = f"file://{tmp_path}/table"
    events.ingest(stream, "key", table)
    assert sorted(r.key for r in spark.read.parquet(table).collect()) == list(range(7))
