"""Statistics of vector blocks: spread, principal axis, quantile bins, layers and splits.

``entries`` is ``block_id, entry_ix, embedding``; ``blocks`` is ``block_id,
level``; ``edges`` is ``parent_id, child_ix, child_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors as V

from .shared import kept, ranked_within

BINS = 4
POWER_STEPS = 8


def centroids(entries: DataFrame) -> DataFrame:
    """``block_id, n, centroid``: one partially aggregated pass, no row per dimension."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return entries.groupBy("block_id").agg(F.count("*").alias("n"), vector_to_array(mean).alias("centroid"))


def centered(entries: DataFrame, centres: DataFrame) -> DataFrame:
    return entries.join(centres, "block_id").select("block_id", "entry_ix", "n", V.minus(F.col("embedding"), F.col("centroid")).alias("delta"))


def spread(entries: DataFrame) -> DataFrame:
    """``block_id, n, centroid, mean_distance, max_distance``."""
    centres = centroids(entries)
    away = centered(entries, centres).groupBy("block_id").agg(F.avg(V.norm(F.col("delta"))).alias("mean_distance"), F.max(V.norm(F.col("delta"))).alias("max_distance"))
    return centres.join(away, "block_id")


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block of a batch: the sum of outer products."""
    for pdf in batches:
        for block, part in pdf.groupby("block_id"):
            x = np.stack(part["delta"].to_numpy())
            yield pd.DataFrame({"block_id": [block], "n": [len(x)], "gram": [(x.T @ x).ravel()]})


def _axis(pdf: pd.DataFrame) -> pd.DataFrame:
    """Eight power steps on a block's summed outer products (one row per task that held the block)."""
    gram = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)
    dims = int(np.sqrt(len(gram)))
    gram = gram.reshape(dims, dims)
    total, axis, strength = float(np.trace(gram)), np.zeros(dims), 0.0
    if pdf["n"].sum() > 1 and total > V.EPSILON:
        axis = np.asarray(pdf["start"].iloc[0], dtype=float) if pdf["start"].iloc[0] is not None else np.ones(dims)
        axis = axis / np.linalg.norm(axis)
        for _ in range(POWER_STEPS):
            after = gram @ axis
            if np.linalg.norm(after) <= V.EPSILON:
                break
            axis = after / np.linalg.norm(after)
        strength = float(np.clip(axis @ gram @ axis / total, 0, 1))
    return pd.DataFrame({"block_id": [pdf["block_id"].iloc[0]], "axis": [axis], "strength": [strength]})


def principal_axes(entries: DataFrame) -> DataFrame:
    """``block_id, axis, strength``: leading variance over total variance, 0 for one entry or no variance."""
    deltas = centered(entries, centroids(entries))
    kind = entries.schema["block_id"].dataType.simpleString()
    start = deltas.where(V.norm(F.col("delta")) > V.EPSILON).groupBy("block_id").agg(F.min_by("delta", "entry_ix").alias("start"))
    grams = deltas.select("block_id", "delta").mapInPandas(_gram, f"block_id {kind}, n long, gram array<double>")
    return grams.join(start, "block_id", "left").groupBy("block_id").applyInPandas(_axis, f"block_id {kind}, axis array<double>, strength double")


def quantile_bins(projected: DataFrame, bins: int = BINS) -> DataFrame:
    """Occupancy of ``bins`` quantile bins per block, from ``block_id, projection``; ties share a bin.

    Projections are written first: sums computed twice may differ in the last bit, and a value must be compared with itself.
    """
    projected = kept(projected.select("block_id", "projection"), "projected")
    sizes = projected.groupBy("block_id").agg(F.count("*").alias("n"))
    ranked = ranked_within(projected, "block_id", "projection", "projections").join(sizes, "block_id")
    cut = [F.max(F.when(F.col("rank") + 1 == F.ceil(F.lit(i) * F.col("n") / bins), F.col("projection"))).alias(f"t{i}") for i in range(1, bins)]
    cuts = ranked.groupBy("block_id").agg(*cut).select("block_id", F.array(*(f"t{i}" for i in range(1, bins))).alias("cuts"))
    placed = projected.join(cuts, "block_id").select("block_id", F.size(F.filter("cuts", lambda t: F.col("projection") > t)).alias("bin"))
    counts = [F.count_if(F.col("bin") == i).alias(f"bin{i}") for i in range(bins)]
    filled = placed.groupBy("block_id").agg(F.count("*").alias("n"), *counts)
    expected = F.col("n") / bins
    each = F.array(*(F.col(f"bin{i}") for i in range(bins)))
    variance = F.aggregate(each, F.lit(0.0), lambda s, c: s + (c - expected) * (c - expected)) / bins
    return filled.select(
        "block_id", *(f"bin{i}" for i in range(bins)), variance.alias("occupancy_variance"),
        F.size(F.filter(each, lambda c: c == 0)).cast("long").alias("empty_bins"),
        F.size(F.filter(each, lambda c: c > 2 * expected + V.EPSILON)).cast("long").alias("overfull_bins"),
    )


def stdev(column: Column) -> Column:
    """Population deviation, 0 for one value."""
    return F.when(F.count(column) > 1, F.stddev_pop(column)).otherwise(F.lit(0.0))


def sibling_distances(edges: DataFrame, blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """``level, distance`` of each unordered pair of children with one parent and one level."""
    child = edges.join(blocks.withColumnRenamed("block_id", "child_id"), "child_id").join(stats.select(F.col("block_id").alias("child_id"), "centroid"), "child_id")
    left = child.select("parent_id", "level", F.col("child_ix").alias("i"), F.col("centroid").alias("a"))
    right = child.select("parent_id", "level", F.col("child_ix").alias("j"), F.col("centroid").alias("b"))
    return left.join(right, ["parent_id", "level"]).where("i < j").select("level", V.distance(F.col("a"), F.col("b")).alias("distance"))


def layer_metrics(blocks: DataFrame, edges: DataFrame, stats: DataFrame, bins: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """One row per level: block count, mean and deviation of spread, bins, axis strength and sibling distance."""
    rows = blocks.join(stats, "block_id").join(bins, "block_id")
    more = []
    if axes is not None:
        rows = rows.join(axes.select("block_id", "strength"), "block_id")
        more = [F.avg("strength").alias("mean_axis_strength"), stdev(F.col("strength")).alias("stdev_axis_strength")]
    layers = rows.groupBy("level").agg(
        F.count("*").alias("block_count"),
        F.avg("mean_distance").alias("mean_dispersion"), stdev(F.col("mean_distance")).alias("stdev_dispersion"),
        F.avg("occupancy_variance").alias("mean_occupancy_variance"), stdev(F.col("occupancy_variance")).alias("stdev_occupancy_variance"),
        F.count_if(F.col("empty_bins") > 0).alias("blocks_with_empty_bins"), F.count_if(F.col("overfull_bins") > 0).alias("blocks_with_overfull_bins"), *more,
    )
    siblings = sibling_distances(edges, blocks, stats).groupBy("level").agg(F.avg("distance").alias("mean_sibling_distance"), stdev(F.col("distance")).alias("stdev_sibling_distance"))
    return layers.join(siblings, "level", "left").fillna(0.0, ["mean_sibling_distance", "stdev_sibling_distance"])


def split_metrics(blocks: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per parent: how often, and by how much, a child is more dispersed than the parent."""
    parent = stats.join(blocks, "block_id").select(F.col("block_id").alias("parent_id"), F.col("level").alias("parent_level"), F.col("mean_distance").alias("up"))
    child = stats.select(F.col("block_id").alias("child_id"), F.col("mean_distance").alias("down"))
    more = F.when(F.col("down") - F.col("up") > V.EPSILON, F.col("down") - F.col("up"))
    return (
        edges.join(parent, "parent_id").join(child, "child_id").groupBy("parent_id", "parent_level")
        .agg(F.count("*").alias("child_count"), F.count(more).alias("exceeding"), (F.count(more) * 100.0 / F.count("*")).alias("exceeding_percent"),
             F.coalesce(F.avg(more), F.lit(0.0)).alias("mean_increase"), F.coalesce(F.max(more), F.lit(0.0)).alias("max_increase"))
    )
