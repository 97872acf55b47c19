"""Top-k search over corpora and trees: exact, beam, recall and access cost."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.functions.hashing import choice, sample_key, seed_bytes

from .shared import kept
from .store import MAX_PROBES, only
from .trees import Tree

SAMPLE = 100
TOP = 10
#: Queries that one pass of an exact search holds in every task.
MAX_QUERIES = 10_000
#: Queries that are scored against a batch of the corpus at once.
QUERY_TILE = 1_000
#: What a matrix product may be off in a cosine; closer pairs are scored one by one.
SLACK = 1e-9
ROUND_TRIP_BYTES = 65_536


def seeded_sample(entries: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """The ``n`` entries of smallest seeded hash: the same ones in whatever order the rows come."""
    return entries.orderBy(sample_key(seed, F.col(id_col)), id_col).limit(n)


def exact_top(corpus: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, neighbor_id, score, position``: best cosines, self excluded; ties by neighbor id.

    ``corpus`` and ``queries`` are ``id, embedding``. Queries go in blocks of about ``MAX_QUERIES``, one pass over the
    corpus each. A block goes to every task; each batch of the corpus is one matrix product and passes on its best ``k``
    per query, so the ranking shuffle of a block carries queries x batches x k rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    count = queries.count()
    if count <= MAX_QUERIES:
        return _exact_block(corpus, queries, k)
    number = -(-count // MAX_QUERIES)
    dealt = kept(queries.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(number)).alias("block")), "queries")
    return reduce(DataFrame.unionByName, (kept(_exact_block(corpus, dealt.where(F.col("block") == n), k), "exact-block") for n in range(number)))


def _best(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's best ``k`` of a tile. Only what reaches the k-th score is sorted, ties included."""
    rounded = np.round(scores, 12)
    if rounded.shape[1] > k:
        least = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
    else:
        least = np.full((len(names), 1), -np.inf)
    row, column = np.nonzero((rounded >= least) & np.isfinite(scores))
    order = np.lexsort((ids[column], -rounded[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return pd.DataFrame({"query_id": names[row], "neighbor_id": ids[column], "score": scores[row, column]})


def _exact_block(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("id", "embedding").collect()
    names = np.array([r["id"] for r in rows])
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
            ids = pdf["id"].to_numpy()
            for lo in range(0, len(names), QUERY_TILE):
                own = names[lo : lo + QUERY_TILE]
                scores = matrix[lo : lo + QUERY_TILE] @ x
                scores[own[:, None] == ids[None, :]] = -np.inf
                yield _best(own, ids, scores, k)

    kind = corpus.schema["id"].dataType.simpleString()
    best = corpus.select("id", "embedding").mapInPandas(tile, f"query_id {kind}, neighbor_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "neighbor_id")
    return best.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k)


def _pair_scores(targets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines row by row, added up from the first dimension on: equal vectors get equal scores wherever they lie. NaN without a length."""
    dot, left, right = (np.zeros(len(targets)) for _ in range(3))
    for t, v in zip(targets.T, vectors.T):
        dot += t * v
        left += t * t
        right += v * v
    length = np.sqrt(left) * np.sqrt(right)
    return np.divide(dot, length, out=np.full(len(dot), np.nan), where=length > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), nan=0.0, posinf=0.0, neginf=0.0)


def _leaf_hits(frontier: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``query_id, neighbor_id, block_id, score, position``: the best ``k`` entries of each query's blocks in ``frontier``.

    Frontier rows go in parts of about ``MAX_QUERIES``, one pass over the entries each, as in :func:`exact_top`. In a task, a
    block's queries meet a batch of its entries in one matrix product; pairs within ``SLACK`` of a query's k-th are scored exactly.
    The product is all that grows with queries times entries; a pass shuffles at most ``k`` rows per query, block and batch.
    """
    kind = entries.schema["entry_ix"].dataType.simpleString()
    frontier = frontier.withColumn("own", F.expr(f"try_cast(query_id AS {kind})"))
    number = max(1, -(-frontier.count() // MAX_QUERIES))
    if number == 1:
        return _leaf_pass(frontier, entries, k)
    dealt = kept(frontier.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(number))), "beam-parts")
    entries = kept(entries.join(frontier.select("block_id").distinct(), "block_id", "left_semi"), "beam-entries")
    return reduce(DataFrame.unionByName, (kept(_leaf_pass(dealt.where(F.col("part") == n).drop("part"), entries, k), "beam-hits") for n in range(number)))


def _leaf_pass(frontier: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    rows = frontier.select("query_id", "block_id", "own", "target").collect()
    queries: dict = {}
    for r in rows:
        queries.setdefault(r["block_id"], []).append(r)
    held = {b: ([r["query_id"] for r in own], np.array([r["own"] for r in own], dtype=object), np.array([r["target"] for r in own], dtype=np.float64)) for b, own in queries.items()}

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, part in pdf.groupby("block_id"):
                names, own, targets = held[block]
                vectors, ids = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["entry_ix"].to_numpy()
                unit, there = _unit(vectors).T, set(ids)
                for lo in range(0, len(names), QUERY_TILE):
                    rough = _unit(targets[lo : lo + QUERY_TILE]) @ unit
                    for i, x in enumerate(own[lo : lo + QUERY_TILE]):
                        if x in there:
                            rough[i, ids == x] = -np.inf
                    least = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k] if rough.shape[1] > k else np.full((len(rough), 1), -np.inf)
                    row, column = np.nonzero((rough >= least - SLACK) & (rough > -np.inf))
                    score = _pair_scores(targets[lo + row], vectors[column])
                    order = np.lexsort((ids[column], -np.round(np.where(np.isnan(score), -2.0, score), 12), row))
                    row, column, score = row[order], column[order], score[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, column, score = row[best], column[best], score[best]
                    yield pd.DataFrame({"query_id": [names[lo + i] for i in row], "neighbor_id": ids[column], "block_id": block, "score": score})

    kinds = {f.name: f.dataType.simpleString() for f in [*frontier.schema, *entries.schema]}
    near = entries.where(F.col("block_id").isin(list(held))) if len(held) <= MAX_PROBES else entries.join(frontier.select("block_id").distinct(), "block_id", "left_semi")
    best = near.select("block_id", "entry_ix", "embedding").mapInPandas(tile, f"query_id {kinds['query_id']}, neighbor_id {kinds['entry_ix']}, block_id {kinds['block_id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "block_id", "neighbor_id")
    return best.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k)


def beam_search(tree: Tree, queries: DataFrame, root: str, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``hits (query_id, neighbor_id, block_id, score, position)`` and ``touched (query_id, block_id, level)``.

    One join per level: every query scores the entries of its frontier's blocks and keeps the best ``width`` children.
    ``queries`` is ``query_id, target``. A query's own entry counts as no neighbour. Of tables in buckets, each level reads
    what the frontier names (:func:`siltstone.operators.store.only`), so a search reads with width and depth, not with the archive.
    """
    if k < 1 or width < 1:
        raise ValueError("k and width must be at least 1")
    frontier = queries.select("query_id", "target", F.lit(root).alias("block_id"))
    touched = []
    top = only(tree.blocks, "block_id", [root]).agg(F.max("level")).first()[0] or 0
    for level in range(top, 0, -1):
        frontier = kept(frontier, "beam")
        at = tree.near(frontier.select("block_id"))
        links = at.edges.join(at.entries, (at.edges["parent_id"] == at.entries["block_id"]) & (at.edges["child_ix"] == at.entries["entry_ix"])).select("parent_id", "child_id", "embedding")
        here = frontier.join(at.blocks.where(F.col("level") == level).select("block_id"), "block_id")
        rest = frontier.join(at.blocks.where(F.col("level") == level).select("block_id"), "block_id", "left_anti").select("query_id", "target", "block_id")
        touched.append(here.select("query_id", "block_id", F.lit(level).alias("level")))
        scored = here.join(links.withColumnRenamed("parent_id", "block_id"), "block_id").withColumn("score", V.cosine(F.col("target"), F.col("embedding")))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "child_id")
        best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width)
        frontier = rest.unionByName(best.select("query_id", "target", F.col("child_id").alias("block_id")))
    frontier = kept(frontier, "beam")
    touched.append(frontier.select("query_id", "block_id", F.lit(0).alias("level")))
    hits = _leaf_hits(frontier, only(tree.entries, "block_id", frontier.select("block_id")), k)
    seen = touched[0]
    for t in touched[1:]:
        seen = seen.unionByName(t)
    return hits, seen


def recall(exact: DataFrame, found: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``query_id, k, matched, possible``: found neighbours among the exact ones, both within the first k."""
    levels = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    want = exact.select("query_id", "neighbor_id", "position", levels).where(F.col("position") < F.col("k")).select("query_id", "neighbor_id", "k")
    have = found.select("query_id", "neighbor_id", "position", levels).where(F.col("position") < F.col("k")).select("query_id", "neighbor_id", "k").withColumn("hit", F.lit(1))
    return want.join(have, ["query_id", "neighbor_id", "k"], "left").groupBy("query_id", "k").agg(F.count("hit").alias("matched"), F.count("*").alias("possible"))


def level_access(touched: DataFrame, sizes: DataFrame) -> DataFrame:
    """``query_id, level, blocks, bytes, round_trips``; ``sizes`` is ``block_id, n_bytes``."""
    per_level = touched.distinct().join(sizes, "block_id").groupBy("query_id", "level").agg(F.count("*").alias("blocks"), F.sum("n_bytes").alias("bytes"))
    return per_level.withColumn("round_trips", F.ceil(F.col("bytes") / ROUND_TRIP_BYTES))


def access_summary(touched: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per level: blocks and bytes over distinct blocks, round trips summed over queries."""
    blocks = touched.select("block_id", "level").distinct().join(sizes, "block_id").groupBy("level").agg(F.count("*").alias("blocks"), F.sum("n_bytes").alias("bytes"))
    trips = level_access(touched, sizes).groupBy("level").agg(F.sum("round_trips").alias("round_trips"))
    return blocks.join(trips, "level")


def query_totals(levels: DataFrame) -> DataFrame:
    """``query_id, blocks, bytes, round_trips``: :func:`level_access` summed over levels."""
    return levels.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("blocks", "bytes", "round_trips")))


def elapsed_summary(queries: DataFrame) -> DataFrame:
    """One row from ``query_id, micros``: number, total, whole mean and most."""
    total, n = F.sum("micros"), F.count("*")
    return queries.agg(n.alias("queries"), F.coalesce(total, F.lit(0)).alias("total_micros"), F.coalesce(F.floor(total / n), F.lit(0)).alias("mean_micros"), F.coalesce(F.max("micros"), F.lit(0)).alias("max_micros"))


def walk_sample(tree: Tree, root: str, seed: int, n: int, attempts: int = 32) -> DataFrame:
    """``block_id, entry_ix, walk``: the first ``n`` different entries of at most ``attempts * n`` walks."""
    found = random_walks(tree, root, seed, attempts * n).groupBy("block_id", "entry_ix").agg(F.min("walk").alias("walk"))
    return found.orderBy("walk").limit(n)


def walk_access(tree: Tree, root: str, sizes: DataFrame, seed: int, n: int, width: int) -> DataFrame:
    """:func:`level_access` of searches for entries found by walks: what they cost, without a recall baseline."""
    chosen = walk_sample(tree, root, seed, n).join(tree.entries, ["block_id", "entry_ix"])
    _, touched = beam_search(tree, chosen.select(F.col("entry_ix").alias("query_id"), F.col("embedding").alias("target")), root, width, TOP)
    return level_access(touched, sizes)


def random_walks(tree: Tree, root: str, seed: int, walks: int) -> DataFrame:
    """``walk, block_id, entry_ix``: deterministic descents, each choice by a hash of seed, walk, depth and block."""
    spark = tree.blocks.sparkSession
    counts = tree.entries.groupBy("block_id").agg(F.count("*").alias("n"))
    step = spark.range(walks).select(F.col("id").alias("walk"), F.lit(root).alias("block_id"))
    done = None
    top = tree.blocks.agg(F.max("level")).first()[0] or 0

    def little_endian(column):
        number = F.lpad(F.hex(column.cast("long")), 16, "0")
        return F.unhex(F.concat(*(F.substring(number, i, 2) for i in range(15, 0, -2))))

    for depth in range(top + 1):
        here = kept(step, "walks").join(tree.blocks, "block_id").join(counts, "block_id")
        salt = F.when(F.col("level") == 0, F.lit("leaf-entry")).otherwise(F.lit("branch-child")).cast("binary")
        digest = F.sha2(F.concat(seed_bytes(seed), little_endian(F.col("walk")), little_endian(F.lit(depth)), F.col("block_id").cast("binary"), salt), 256)
        chosen = here.withColumn("at", choice(digest, F.col("n")))
        leaf = chosen.where("level = 0").select("walk", "block_id", "at")
        done = leaf if done is None else done.unionByName(leaf)
        step = chosen.where("level > 0").join(tree.edges, (F.col("block_id") == F.col("parent_id")) & (F.col("at") == F.col("child_ix"))).select("walk", F.col("child_id").alias("block_id"))
    order = Window.partitionBy("block_id").orderBy("entry_ix")
    places = tree.entries.withColumn("at", F.row_number().over(order) - 1)
    return done.join(places, ["block_id", "at"]).select("walk", "block_id", "entry_ix")
