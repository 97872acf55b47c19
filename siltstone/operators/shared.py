"""A table in the folder that driver and executors share, for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. If none is set: a local folder in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df``, written, with ``rank`` from 0 in the order of ``column`` (distinct values).

    Ranks come from a range-partitioned sort and one count per partition, never from a single task.
    """
    ordered = kept(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()), name)
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("part").orderBy(column)
    return ordered.withColumn("at", F.row_number().over(local) - 1).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "start", "at")


def ranked_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df``, written, with ``rank`` from 0 in ``order`` inside each ``group``, however large the groups are; ties are in any order.

    Rows are range-partitioned by both and ranked inside their partition, which starts where the ones before it end.
    """
    placed = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(group, order, "tie").withColumn("part", F.spark_partition_id())
    placed = kept(placed, name)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and partition
    starts = placed.groupBy(group, "part").agg(F.count("*").alias("n")).select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy(group, "part").orderBy(order, "tie")
    return placed.withColumn("at", F.row_number().over(local) - 1).join(starts, [group, "part"]).withColumn("rank", F.col("start") + F.col("at")).drop("part", "start", "at", "tie")
