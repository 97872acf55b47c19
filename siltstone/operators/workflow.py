"""Workflow journals as tables: work, checkpoints, invariants; pass telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order (fixed values of the journal format); the two terminal ones share a rank.
STAGES = ("source-acquisition", "mailbox-admission", "chunk-derivation", "embedding", "published-root-generation", "root-history-publication", "terminal-success")


def rank_of(stage: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """Position of a stage in the order, null for an unknown one."""
    known = F.when(stage == "terminal-failure", "terminal-success").otherwise(stage)
    return F.nullif(F.array_position(F.array(*(F.lit(s) for s in stages)), known) - 1, F.lit(-1).cast("long"))


def queue_work(pending: DataFrame, completed: DataFrame, requested: DataFrame) -> DataFrame:
    """Pending work after a request: what is completed or queued already is not queued again."""
    fresh = requested.select("work_id").distinct().join(completed.select("work_id"), "work_id", "left_anti")
    return pending.select("work_id").unionByName(fresh).distinct()


def inventory(pending: DataFrame, completed: DataFrame) -> DataFrame:
    """``work_id, state``: ``pending``, ``completed``, or ``conflict`` for work that stands in both."""
    both = pending.select("work_id", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(completed.select("work_id", F.lit(0).alias("p"), F.lit(1).alias("c")))
    seen = both.groupBy("work_id").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return seen.select("work_id", F.when(F.col("p") + F.col("c") == 2, "conflict").when(F.col("c") == 1, "completed").otherwise("pending").alias("state"))


def advance(checkpoints: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each checkpoint with the highest rank so far and whether it moved the stage forward; repeats are no-ops."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = checkpoints.withColumn("best_before", F.coalesce(F.max("rank").over(before), F.lit(-1)))
    return rows.withColumn("advanced", F.col("rank") > F.col("best_before")).withColumn("regressed", F.col("rank") < F.col("best_before"))


def current_stage(checkpoints: DataFrame, key: str) -> DataFrame:
    return checkpoints.groupBy(key).agg(F.max("rank").alias("rank"), F.count("*").alias("checkpoints"))


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """``rule, key``: one row per broken rule and row."""
    parts = [rows.where(broken).select(F.lit(name).alias("rule"), F.col(key).alias("key")) for name, broken in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def pass_diagnosis(passes: DataFrame) -> DataFrame:
    """Verdict on each pass against the one before, from ``pass_no, planned, terminal``; one short series."""
    order = Window.orderBy("pass_no")
    rows = passes.withColumn("gap", F.greatest(F.col("planned") - F.col("terminal"), F.lit(0)))
    rows = rows.withColumn("terminal0", F.lag("terminal").over(order)).withColumn("gap0", F.lag("gap").over(order))
    better = (F.col("terminal") > F.col("terminal0")) | (F.col("gap") < F.col("gap0"))
    worse = (F.col("terminal") < F.col("terminal0")) | (F.col("gap") > F.col("gap0"))
    verdict = F.when(F.col("terminal0").isNull(), "inconclusive").when(better & worse, "inconclusive").when(better, "converging").otherwise("not-converging")
    return rows.select("pass_no", "planned", "terminal", "gap", verdict.alias("verdict"))


def changed_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Drops rows whose value equals the one before them."""
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(window)).where(~F.col("before").eqNullSafe(F.col(value))).drop("before")
