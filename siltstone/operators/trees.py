"""Index trees over embeddings: a deterministic label tree, and trees built by clustering.

A tree is three DataFrames: ``blocks (block_id, level)``, ``edges (parent_id,
child_ix, child_id)`` and ``entries (block_id, entry_ix, embedding)``. A branch
entry's embedding is the centroid of the child's entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V

from .shared import kept, numbered, ranked_within
from .spread import centroids, principal_axes
from .store import MAX_PROBES, only

#: Bytes of a block, and of what an entry takes besides its floats (fixed values of the format).
BLOCK_BYTES = 65_536
ENTRY_OVERHEAD = 40
#: Centres that k-means fits and every task holds; more clusters come from halving.
MAX_CENTRES = 256


@dataclass
class Tree:
    blocks: DataFrame
    edges: DataFrame
    entries: DataFrame

    def near(self, ids: DataFrame) -> Tree:
        """What the tables, if they are in buckets, have to be read for when only blocks of ``ids (block_id)`` are wanted."""
        if "bucket" not in self.blocks.columns:
            return self
        few = ids.distinct().limit(MAX_PROBES + 1).collect()
        named = [r["block_id"] for r in few] if len(few) <= MAX_PROBES else ids
        return Tree(only(self.blocks, "block_id", named), only(self.edges, "parent_id", named), only(self.entries, "block_id", named))


def fan_out(dims: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Entries of ``dims`` floats that a block holds."""
    return max(2, block_bytes // (4 * dims + ENTRY_OVERHEAD))


def stack(leaves: DataFrame, parents: list) -> Tree:
    """A tree over leaf entries: each function in ``parents`` names the parent of a block id one level up."""
    entries, blocks, edges = leaves.select("block_id", "entry_ix", "embedding"), [leaves.select("block_id").distinct().withColumn("level", F.lit(0))], []
    below, parts = entries, [entries.withColumn("embedding", F.col("embedding").cast("array<double>"))]
    for level, parent in enumerate(parents, 1):
        centres = centroids(below).select(parent(F.col("block_id")).alias("parent_id"), F.col("block_id").alias("child_id"), "centroid")
        ranked = centres.withColumn("child_ix", F.row_number().over(Window.partitionBy("parent_id").orderBy("child_id")) - 1)
        edges.append(ranked.select("parent_id", "child_ix", "child_id"))
        below = ranked.select(F.col("parent_id").alias("block_id"), F.col("child_ix").cast("long").alias("entry_ix"), F.col("centroid").alias("embedding"))
        parts.append(below)
        blocks.append(below.select("block_id").distinct().withColumn("level", F.lit(level)))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Tree(union(blocks), union(edges), union(parts))


def label_tree(embeddings: DataFrame) -> Tree:
    """Leaves by label (``L``), three branches (``B``: label modulo 3), one root (``R``)."""
    leaves = embeddings.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("block_id"), F.col("vec_id").alias("entry_ix"), "embedding")
    branch = lambda b: F.concat(F.lit("B"), (F.substring(b, 2, 9).cast("int") % 3).cast("string"))
    return stack(leaves, [branch, lambda b: F.lit("R")])


def _kmeans(entries: DataFrame, clusters: int, seed: int) -> DataFrame:
    rows = entries.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=clusters, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows)
    return model.transform(rows).select("entry_ix", "embedding", F.col("prediction").cast("long").alias("cluster"))


def _halve(entries: DataFrame, depth: int) -> DataFrame:
    """``depth`` cuts of every cluster (``entry_ix, embedding, cluster``) at the median of its principal axis."""
    out = entries
    for _ in range(depth):
        out = kept(out, "tree-halves")
        keyed = out.select(F.col("cluster").alias("block_id"), "entry_ix", "embedding")
        axes, centres = principal_axes(keyed), centroids(keyed)
        along = keyed.join(axes, "block_id").join(centres, "block_id").withColumn("p", V.dot(V.minus(F.col("embedding"), F.col("centroid")), F.col("axis")))
        middle = along.groupBy("block_id").agg(F.expr("percentile_approx(p, 0.5, 10000)").alias("cut"))
        out = along.join(middle, "block_id").select("entry_ix", "embedding", (F.col("block_id") * 2 + (F.col("p") > F.col("cut")).cast("long")).alias("cluster"))
    return out


def _clustered(vectors: DataFrame, wanted: int, method: str, seed: int) -> DataFrame:
    """``entry_ix, embedding, cluster``. Beyond ``MAX_CENTRES`` clusters, those found by k-means are halved on."""
    if method == "kmeans":
        found = _kmeans(vectors, max(2, min(wanted, MAX_CENTRES)), seed)
        return _halve(found, (-(-wanted // MAX_CENTRES) - 1).bit_length())
    return _halve(vectors.select("entry_ix", "embedding").withColumn("cluster", F.lit(0).cast("long")), (wanted - 1).bit_length())


def _content_ids(entries: DataFrame) -> DataFrame:
    """``name, block_id``: SHA-256 over a leaf's entries in order. A leaf has at most a fan-out of them."""
    digest = F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256)
    listed = F.array_sort(F.collect_list(F.struct("entry_ix", digest.alias("h"))))
    return entries.groupBy("name").agg(F.sha2(F.to_json(listed), 256).alias("block_id"))


def build_tree(vectors: DataFrame, dims: int, method: str = "kmeans", clusters: int | None = None, seed: int = 0, block_bytes: int = BLOCK_BYTES) -> Tree:
    """Leaves of at most :func:`fan_out` entries, grouped by ``kmeans`` (cosine) or ``pca`` halving, then packed upward.

    ``vectors`` is ``entry_ix, embedding``, with distinct ids of any kind. Inside a cluster, entries fill leaves in ascending
    ``entry_ix``. A block's id is a hash of its content: of its entries, or of its children's ids.
    """
    size = fan_out(dims, block_bytes)
    total = vectors.count()
    wanted = clusters or max(1, -(-total // size))
    return assemble(_clustered(vectors, wanted, method, seed), size)


def assemble(clustered: DataFrame, size: int, tell: Callable[[int, int], None] = lambda level, groups: None) -> Tree:
    """The tree over ``entry_ix, embedding, cluster``, bottom up; ``tell`` hears of each level and its number of blocks."""
    ranked = ranked_within(clustered, "cluster", "entry_ix", "tree-leaves").withColumn("leaf", F.floor(F.col("rank") / size))
    named = ranked.select(F.format_string("%012d-%012d", "cluster", "leaf").alias("name"), "entry_ix", F.col("embedding").cast("array<double>").alias("embedding"))
    named = kept(named, "tree-named")
    ids = kept(_content_ids(named), "tree-ids")
    below = kept(named.join(ids, "name").select("name", "block_id", "entry_ix", "embedding"), "tree-entries")
    entry = lambda rows: rows.select("block_id", "entry_ix", "embedding")
    blocks, edges, parts, level = [], [], [entry(below)], 0
    none = below.select(F.col("block_id").alias("parent_id"), F.lit(0).alias("child_ix"), F.col("block_id").alias("child_id")).limit(0)
    while True:
        blocks.append(ids.select("block_id").withColumn("level", F.lit(level)))
        made = ids.count()
        tell(level, made)
        if made <= 1:
            break
        level += 1
        # Blocks of a level in name order fill the parents.
        position = numbered(ids, "name", "tree-names").select("block_id", "rank")
        up = centroids(below).join(position, "block_id").select(
            F.format_string("%012d", F.floor(F.col("rank") / size)).alias("name"), (F.col("rank") % size).cast("int").alias("child_ix"), F.col("block_id").alias("child_id"), "centroid")
        up = kept(up, "tree-level")
        listed = F.array_sort(F.collect_list(F.struct("child_ix", "child_id")))
        ids = kept(up.groupBy("name").agg(F.sha2(F.concat(F.lit(f"{level}|"), F.to_json(listed)), 256).alias("block_id")), "tree-ids")
        up = kept(up.join(ids, "name"), "tree-level")
        edges.append(up.select(F.col("block_id").alias("parent_id"), "child_ix", "child_id"))
        below = up.select("name", "block_id", F.col("child_ix").cast("long").alias("entry_ix"), F.col("centroid").alias("embedding"))
        parts.append(entry(below))
    join = lambda frames: reduce(DataFrame.unionByName, frames)
    return Tree(join(blocks), join(edges) if edges else none, join(parts))
