"""Stages as streaming state: a stream equals the batch rules on the same events, across a restart."""

from pyspark.sql import functions as F

from siltstone.operators import workflow
from siltstone.streaming import events, stages

RANKS = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
SF = "/root/testdata/sf0.001"


def _run(spark, folder, rows):
    out = stages.stage_moves(events.file_stream(spark, f"{folder}/in", rows.schema), "user_id", ["ts", "event_id"], RANKS, ["event_id"])
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_a_stream_equals_the_batch_across_a_restart(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", F.col("event_type").alias("stage")).where("user_id % 3 = 0")
    cuts = rows.select("ts").approxQuantile if False else [r.ts for r in rows.select("ts").orderBy("ts").collect()]
    bounds = [None, cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], None]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = rows.where(F.lit(True) if lo is None else F.col("ts") >= F.lit(lo)).where(F.lit(True) if hi is None else F.col("ts") < F.lit(hi))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = _run(spark, folder, rows)  # each call is a new query that goes on from the checkpoint
    ranked = rows.withColumn("rank", workflow.rank_of(F.col("stage"), tuple(RANKS)))
    want = workflow.advance(ranked, "user_id", ["ts", "event_id"])
    assert sorted((r.event_id, r.advanced, r.regressed) for r in got.collect()) == sorted((r.event_id, r.advanced, r.regressed) for r in want.collect())
    last = {r.user_id: (r["rank"], r.checkpoints) for r in got.groupBy("user_id").agg(F.max("rank").alias("rank"), F.max("checkpoints").alias("checkpoints")).collect()}
    assert last == {r.user_id: (r["rank"], r.checkpoints) for r in workflow.current_stage(ranked, "user_id").collect()}


def test_terminal_stages_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, 7, 1, "click"), (2, 7, 2, "terminal-success"), (3, 7, 3, "view"), (4, 7, 4, "unknown"), (5, 7, 5, "purchase"), (6, 8, 1, "terminal-failure")], "event_id long, user_id long, ts long, stage string")
    rows.coalesce(1).write.parquet(f"{folder}/in")
    got = {r.event_id: (r["rank"], r.checkpoints, r.advanced, r.regressed, r.refused) for r in _run(spark, folder, rows).collect()}
    assert got == {1: (1, 1, True, False, False), 2: (1, 1, False, False, True), 3: (1, 2, False, True, False), 4: (1, 3, False, True, False), 5: (3, 4, True, False, False), 6: (-1, 0, False, False, True)}
