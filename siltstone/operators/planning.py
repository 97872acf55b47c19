"""Clustering planned in passes, with a ledger of partitions, status rows and resumption.

A pass splits every pending partition, all of them in one job, into as many parts as it needs and a block can name. A part
that fits in a block is terminal. Below the run's work folder each pass leaves ``split-<n>`` (the rows that it moved, with
their new path), ``ledger-<n>`` (``path, size, terminal``) and, written last, ``pass-<n>``, its report; a run that was
killed begins after the last pass that has one. Rows of terminal partitions are not written again.

The first pass of ``kmeans`` is spherical k-means of the whole corpus; all other splits cut at quantiles of the
partition's principal axis, so parts are balanced and every pass makes partitions smaller, equal vectors included.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import vectors as V

from . import trees
from .shared import kept, ranked_within
from .spread import centroids, principal_axes
from .store import finished, table_or_none
from .telemetry import PREVIEW

#: Status rows as :mod:`siltstone.operators.telemetry` reads them.
STATUSES = (
    "run_id string, seq long, pass_no int, family string, phase string, layer_index int, state string, item_count long, completed_units long, total_units long, pending_count long, "
    "pending array<struct<path:string,expected:long,observed:long>>, partition_path string, partition_size long, recursion_depth int, stall_reason string, stall_ms long, elapsed_ms long"
)
PASSES = (
    "run_id string, pass_no int, items long, planned long, terminal long, depth int, complete boolean, requested_clusters long, realized_clusters long, quality double, balance double, completion_reason string"
)
_NAMES = [part.split(" ")[0] for part in STATUSES.replace("struct<path:string,expected:long,observed:long>", "").split(", ")]


class Telemetry:
    """Appends a status row at a time below ``folder``; numbering goes on after what a run that ended has left."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str, family: str = "v3"):
        self.spark, self.folder, self.run_id, self.family, self.began = spark, folder, run_id, family, time.monotonic()
        held = table_or_none(spark, f"{folder}/statuses")
        last = held.where(F.col("run_id") == run_id).agg(F.max("seq")).first()[0] if held is not None else None
        self.seq = -1 if last is None else last

    def tell(self, phase: str, **known) -> None:
        self.seq += 1
        row = dict.fromkeys(_NAMES) | {"pass_no": 0, "state": "running"} | known
        row |= {"run_id": self.run_id, "seq": self.seq, "family": self.family, "phase": phase, "elapsed_ms": int(1000 * (time.monotonic() - self.began))}
        self.spark.createDataFrame([tuple(row[n] for n in _NAMES)], STATUSES).coalesce(1).write.mode("append").parquet(f"{self.folder}/statuses")


@dataclass
class Plan:
    clustered: DataFrame  # entry_ix, embedding, cluster (terminal partitions in path order)
    passes: DataFrame


def _quantile_split(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``entry_ix, embedding, path``: each partition cut into its ``ways`` along its principal axis; ``sizes`` is ``path, size, ways``."""
    keyed = rows.select(F.col("path").alias("block_id"), "entry_ix", "embedding")
    along = keyed.join(principal_axes(keyed), "block_id").join(centroids(keyed), "block_id")
    along = along.select(F.col("block_id").alias("path"), "entry_ix", "embedding", V.dot(V.minus(F.col("embedding"), F.col("centroid")), F.col("axis")).alias("along"))
    ranked = ranked_within(along, "path", "along", "plan-axis").join(sizes, "path")
    part = F.expr("rank * ways div size")
    return ranked.select("entry_ix", "embedding", _child(F.col("path"), part).alias("path"))


def _child(path, part):
    return F.concat_ws("/", F.nullif(path, F.lit("")), F.lpad(part.cast("string"), 6, "0"))


def _kmeans_split(rows: DataFrame, clusters: int, seed: int) -> DataFrame:
    found = trees._kmeans(rows.select("entry_ix", "embedding"), clusters, seed)
    return found.select("entry_ix", "embedding", _child(F.lit(""), F.col("cluster")).alias("path"))


def _report(run_id: str, number: int, total: int, split: DataFrame, ledgers: list[DataFrame], requested: int, size: int) -> DataFrame:
    """The pass's row; quality is the mean cosine of its rows to their part's centroid, balance the mean part over the largest."""
    here = ledgers[-1].agg(F.count("*").alias("realized"), (F.avg("size") / F.max("size")).alias("balance"), F.count_if(~F.col("terminal")).alias("pending")).first()
    ended = sum(x.where("terminal").count() for x in ledgers)
    centres = centroids(split.select(F.col("path").alias("block_id"), "entry_ix", "embedding")).select(F.col("block_id").alias("path"), "centroid")
    quality = split.join(centres, "path").agg(F.avg(V.cosine(F.col("embedding"), F.col("centroid")))).first()[0]
    reason = f"{here['pending']} partition(s) above {size} item(s)" if here["pending"] else None
    row = (run_id, number, total, ended + here["pending"], ended, number, not here["pending"], requested, here["realized"], quality, here["balance"], reason)
    return split.sparkSession.createDataFrame([row], PASSES)


def plan(vectors: DataFrame, work: str, size: int, telemetry: Telemetry, method: str = "kmeans", clusters: int | None = None, seed: int = 0, max_passes: int = 64) -> Plan:
    """Partitions of at most ``size`` of ``vectors (entry_ix, embedding)``, with every pass's report."""
    spark, family = vectors.sparkSession, telemetry.family
    total = vectors.count()
    splits: list[DataFrame] = []
    ledgers: list[DataFrame] = []
    for number in range(1, max_passes + 1):
        paths = {name: f"{work}/{name}-{number}" for name in ("split", "ledger", "pass")}
        if not finished(spark, paths["pass"]):
            if number == 1:
                rows = vectors.select("entry_ix", F.col("embedding").cast("array<double>").alias("embedding"), F.lit("").alias("path"))
                sizes = spark.createDataFrame([("", total)], "path string, size long")
            else:
                sizes = ledgers[-1].where("NOT terminal").select("path", "size")
                rows = splits[-1].join(sizes.select("path"), "path", "left_semi")
            ways = F.least(F.lit(size), F.greatest(F.lit(1), F.ceil(F.col("size") / size))).cast("long")
            sizes = kept(sizes.withColumn("ways", F.lit(clusters).cast("long") if clusters and number == 1 else ways), "plan-sizes")
            first = sizes.orderBy(F.desc("size"), "path").limit(PREVIEW + 1).collect()
            asked = sizes.agg(F.count("*").alias("n"), F.sum("ways").alias("ways")).first()
            known = {"pass_no": number - 1, "item_count": total, "pending_count": asked["n"], "pending": [(r["path"], r["size"], None) for r in first]}
            if family == "v2":
                telemetry.tell("planning-pass", **known)
            else:
                telemetry.tell("hierarchy-planning", pass_no=number - 1, item_count=total, partition_path=first[0]["path"] or "/", partition_size=first[0]["size"], recursion_depth=number - 1)
                telemetry.tell("partition-load", pass_no=number - 1, item_count=total, layer_index=number - 1, completed_units=0, total_units=asked["n"])
            by_kmeans = method == "kmeans" and number == 1 and 2 <= first[0]["ways"] <= min(trees.MAX_CENTRES, total)
            made = None
            if by_kmeans:
                made = kept(_kmeans_split(rows, first[0]["ways"], seed), "plan-kmeans")
                if made.select("path").distinct().count() < 2:  # equal vectors have one centre
                    made = None
            (_quantile_split(rows, sizes) if made is None else made).write.mode("overwrite").parquet(paths["split"])
            split = spark.read.parquet(paths["split"])
            counted = split.groupBy("path").agg(F.count("*").alias("size"))
            counted.withColumn("terminal", F.col("size") <= size).write.mode("overwrite").parquet(paths["ledger"])
            ledger = spark.read.parquet(paths["ledger"])
            _report(telemetry.run_id, number, total, split, [*ledgers, ledger], asked["ways"], size).coalesce(1).write.mode("overwrite").parquet(paths["pass"])
            done = {"pass_no": number - 1, "item_count": total, "completed_units": asked["n"], "total_units": asked["n"], "state": "completed"}
            telemetry.tell("planning-pass" if family == "v2" else "partition-classify", **done, **({} if family == "v2" else {"layer_index": number - 1}))
        splits.append(spark.read.parquet(paths["split"]))
        ledgers.append(spark.read.parquet(paths["ledger"]))
        if spark.read.parquet(paths["pass"]).first()["complete"]:
            break
    else:
        raise ValueError(f"planning took more than {max_passes} passes")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    ended = union([x.where("terminal").select("path") for x in ledgers])
    rows = union([s.join(x.where("terminal").select("path"), "path", "left_semi") for s, x in zip(splits, ledgers)])
    # Terminal partitions are numbered in path order, so that neighbours in the plan become neighbours in the tree.
    numbers = trees.numbered(ended, "path", "plan-paths").select("path", F.col("rank").cast("long").alias("cluster"))
    reports = union([spark.read.parquet(f"{work}/pass-{k}") for k in range(1, len(splits) + 1)])
    return Plan(rows.join(numbers, "path").select("entry_ix", "embedding", "cluster"), reports)
