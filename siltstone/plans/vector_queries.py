"""Queries over embeddings: search, samples, block statistics, recall, access cost, health."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import health, planning, search, spread, telemetry, trees
from siltstone.operators.shared import shared_dir

from .registry import Registry

R = Registry()
DIMS, SEED, SAMPLE, WIDTH = 64, 0, 100, 3

# --- SQL pieces ------------------------------------------------------------------------------------------

_SAMPLE = f"(SELECT vec_id, embedding FROM embeddings ORDER BY sha256('{chr(92)}x00{chr(92)}x00{chr(92)}x00{chr(92)}x00{chr(92)}x00{chr(92)}x00{chr(92)}x00{chr(92)}x00'::BLOB || encode(vec_id::VARCHAR)), vec_id LIMIT {SAMPLE})"
_EXACT = f"""SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) - 1 AS position
  FROM {_SAMPLE} q, embeddings e WHERE q.vec_id <> e.vec_id"""
#: Entries (block, entry, dimension, value) of the label tree, level by level, and per block: centroid and distances.
_TREE = """
e0 AS (SELECT 'L' || label AS b, 'B' || (label % 3) AS p, vec_id AS x, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c0 AS (SELECT b, any_value(p) AS p, i, avg(v) AS m FROM e0 GROUP BY b, i),
e1 AS (SELECT p AS b, b AS x, i, m AS v FROM c0),
c1 AS (SELECT b, i, avg(v) AS m FROM e1 GROUP BY b, i),
e2 AS (SELECT 'R' AS b, b AS x, i, m AS v FROM c1),
c2 AS (SELECT b, i, avg(v) AS m FROM e2 GROUP BY b, i),
d AS (SELECT 0 AS level, b, x::VARCHAR AS x, sqrt(sum((v - m) * (v - m))) AS dist FROM e0 JOIN c0 USING (b, i) GROUP BY b, x
  UNION ALL SELECT 1, b, x, sqrt(sum((v - m) * (v - m))) FROM e1 JOIN c1 USING (b, i) GROUP BY b, x
  UNION ALL SELECT 2, b, x, sqrt(sum((v - m) * (v - m))) FROM e2 JOIN c2 USING (b, i) GROUP BY b, x),
s AS (SELECT level, b, count(*) AS n, avg(dist) AS mean_d, max(dist) AS max_d FROM d GROUP BY level, b)"""
_BINS = """
p AS (SELECT 0 AS level, b, v AS pr FROM e0 WHERE i = 1 UNION ALL SELECT 1, b, v FROM e1 WHERE i = 1 UNION ALL SELECT 2, b, v FROM e2 WHERE i = 1),
t AS (SELECT b, quantile_disc(pr, 0.25) AS t1, quantile_disc(pr, 0.5) AS t2, quantile_disc(pr, 0.75) AS t3, count(*) AS n FROM p GROUP BY b),
o AS (SELECT level, b, any_value(n) AS n, count(*) FILTER (pr <= t1) AS bin0, count(*) FILTER (pr > t1 AND pr <= t2) AS bin1, count(*) FILTER (pr > t2 AND pr <= t3) AS bin2, count(*) FILTER (pr > t3) AS bin3 FROM p JOIN t USING (b) GROUP BY level, b),
q AS (SELECT *, ((bin0 - n / 4) ** 2 + (bin1 - n / 4) ** 2 + (bin2 - n / 4) ** 2 + (bin3 - n / 4) ** 2) / 4 AS variance,
  (bin0 = 0)::BIGINT + (bin1 = 0)::BIGINT + (bin2 = 0)::BIGINT + (bin3 = 0)::BIGINT AS empty_bins,
  (bin0 > n / 2 + 1e-6)::BIGINT + (bin1 > n / 2 + 1e-6)::BIGINT + (bin2 > n / 2 + 1e-6)::BIGINT + (bin3 > n / 2 + 1e-6)::BIGINT AS overfull_bins FROM o)"""
_EDGES = "edges AS (SELECT DISTINCT 'B' || (label % 3) AS parent, 'L' || label AS child FROM embeddings UNION ALL SELECT DISTINCT 'R', 'B' || (label % 3) FROM embeddings)"
_SIZE = "(SELECT 'L' || label AS b, count(*) * 296 AS n_bytes FROM embeddings GROUP BY label UNION ALL SELECT 'B' || (label % 3), count(DISTINCT label) * 296 FROM embeddings GROUP BY label % 3 UNION ALL SELECT 'R', count(DISTINCT label % 3) * 296 FROM embeddings)"
#: Beam of width 3 over the label tree: branches, then leaves, then entries.
_BEAM = f"""
cl AS (SELECT b, any_value(p) AS p, list(m ORDER BY i) AS c FROM c0 GROUP BY b), cb AS (SELECT b, list(m ORDER BY i) AS c FROM c1 GROUP BY b),
qs AS (SELECT vec_id AS q, embedding::DOUBLE[] AS t FROM {_SAMPLE}),
b1 AS (SELECT q, t, b FROM (SELECT q, t, b, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(t, c), 12) DESC, b) AS r FROM qs, cb) WHERE r <= {WIDTH}),
b0 AS (SELECT q, t, b FROM (SELECT q, t, cl.b, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(t, c), 12) DESC, cl.b) AS r FROM b1 JOIN cl ON cl.p = b1.b) WHERE r <= {WIDTH}),
hits AS (SELECT q, e.vec_id AS neighbor, b, list_cosine_similarity(t, e.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(t, e.embedding::DOUBLE[]), 12) DESC, b, e.vec_id) - 1 AS position
  FROM b0 JOIN embeddings e ON 'L' || e.label = b0.b WHERE e.vec_id <> q),
touched AS (SELECT q, 'R' AS b, 2 AS level FROM qs UNION ALL SELECT q, b, 1 FROM b1 UNION ALL SELECT q, b, 0 FROM b0)"""


def _entries(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _sample(t) -> DataFrame:
    return search.seeded_sample(_entries(t), "id", SEED, SAMPLE)


def _beam(t, k: int = search.TOP):
    tree = trees.label_tree(t("embeddings"))
    return tree, *search.beam_search(tree, _sample(t).select(F.col("id").alias("query_id"), F.col("embedding").alias("target")), "R", WIDTH, k)


def _sizes(tree) -> DataFrame:
    return tree.entries.groupBy("block_id").agg((F.count("*") * (4 * DIMS + trees.ENTRY_OVERHEAD)).alias("n_bytes"))


@R.query(f"SELECT query_id, neighbor_id, position, round(score, 6) AS score FROM ({_EXACT}) WHERE position < 10")
def exact_top10(spark: SparkSession, t) -> DataFrame:
    out = search.exact_top(_entries(t), _sample(t))
    return out.select("query_id", "neighbor_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"))


@R.query(f"SELECT vec_id FROM {_SAMPLE}")
def seeded_sample(spark: SparkSession, t) -> DataFrame:
    return _sample(t).select(F.col("id").alias("vec_id"))


@R.query(f"WITH {_TREE} SELECT b AS block_id, n, round(mean_d, 6) AS mean_distance, round(max_d, 6) AS max_distance FROM s")
def block_spread(spark: SparkSession, t) -> DataFrame:
    stats = spread.spread(trees.label_tree(t("embeddings")).entries)
    return stats.select("block_id", "n", F.round("mean_distance", 6).alias("mean_distance"), F.round("max_distance", 6).alias("max_distance"))


def _first_element_bins(tree) -> DataFrame:
    return spread.quantile_bins(tree.entries.select("block_id", F.get("embedding", 0).cast("double").alias("projection")))


@R.query(f"""WITH {_TREE}, {_BINS}, {_EDGES},
c AS (SELECT 0 AS level, b, i, m FROM c0 UNION ALL SELECT 1, b, i, m FROM c1),
sib AS (SELECT l.level, l.b, r.b AS b2, sqrt(sum((l.m - r.m) ** 2)) AS dist FROM c l JOIN c r ON l.level = r.level AND l.i = r.i AND l.b < r.b JOIN edges x ON x.child = l.b JOIN edges y ON y.child = r.b AND x.parent = y.parent GROUP BY l.level, l.b, r.b),
sl AS (SELECT level, avg(dist) AS a, CASE WHEN count(*) > 1 THEN stddev_pop(dist) ELSE 0 END AS d FROM sib GROUP BY level)
SELECT s.level, count(*) AS block_count, round(avg(mean_d), 6) AS mean_dispersion, round(CASE WHEN count(*) > 1 THEN stddev_pop(mean_d) ELSE 0 END, 6) AS stdev_dispersion,
  round(avg(variance), 6) AS mean_occupancy_variance, round(CASE WHEN count(*) > 1 THEN stddev_pop(variance) ELSE 0 END, 6) AS stdev_occupancy_variance,
  count(*) FILTER (empty_bins > 0) AS blocks_with_empty_bins, count(*) FILTER (overfull_bins > 0) AS blocks_with_overfull_bins,
  round(coalesce(any_value(sl.a), 0), 6) AS mean_sibling_distance, round(coalesce(any_value(sl.d), 0), 6) AS stdev_sibling_distance
FROM s JOIN q ON s.b = q.b LEFT JOIN sl ON sl.level = s.level GROUP BY s.level""")
def layer_metrics(spark: SparkSession, t) -> DataFrame:
    tree = trees.label_tree(t("embeddings"))
    out = spread.layer_metrics(tree.blocks, tree.edges, spread.spread(tree.entries), _first_element_bins(tree))
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes))


@R.query(f"""WITH {_TREE}, {_EDGES}, x AS (SELECT parent, p.level, c.mean_d - p.mean_d AS up FROM edges JOIN s p ON p.b = parent JOIN s c ON c.b = child)
SELECT parent AS parent_id, level AS parent_level, count(*) AS child_count, count(*) FILTER (up > 1e-6) AS exceeding, round(100.0 * count(*) FILTER (up > 1e-6) / count(*), 6) AS exceeding_percent,
  round(coalesce(avg(up) FILTER (up > 1e-6), 0), 6) AS mean_increase, round(coalesce(max(up) FILTER (up > 1e-6), 0), 6) AS max_increase FROM x GROUP BY parent, level""")
def split_effectiveness(spark: SparkSession, t) -> DataFrame:
    tree = trees.label_tree(t("embeddings"))
    out = spread.split_metrics(tree.blocks, tree.edges, spread.spread(tree.entries))
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes))


@R.query(f"""WITH {_TREE}, {_EDGES}, x AS (SELECT count(*) FILTER (c.mean_d - p.mean_d > 1e-6) AS inversions FROM edges JOIN s p ON p.b = parent JOIN s c ON c.b = child)
SELECT count(*) AS blocks, count(*) FILTER (level = 0) AS leaves, count(*) FILTER (level > 0) AS branches, (SELECT count(*) FROM edges) AS edges, max(level) AS depth, (SELECT inversions FROM x) AS inversions,
  round(avg(mean_d), 6) AS mean_dispersion, round(max(max_d), 6) AS max_dispersion FROM s""")
def tree_summary(spark: SparkSession, t) -> DataFrame:
    tree = trees.label_tree(t("embeddings"))
    stats = spread.spread(tree.entries)
    blocks = tree.blocks.join(stats, "block_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("level") == 0).alias("leaves"), F.count_if(F.col("level") > 0).alias("branches"), F.max("level").alias("depth"),
        F.round(F.avg("mean_distance"), 6).alias("mean_dispersion"), F.round(F.max("max_distance"), 6).alias("max_dispersion"),
    )
    splits = spread.split_metrics(tree.blocks, tree.edges, stats).agg(F.sum("exceeding").alias("inversions"), F.sum("child_count").alias("edges"))
    return blocks.crossJoin(F.broadcast(splits))  # one row each


@R.query(f"WITH {_TREE}, {_BINS} SELECT b AS block_id, bin0, bin1, bin2, bin3, round(variance, 6) AS occupancy_variance, empty_bins, overfull_bins FROM q")
def quantile_occupancy(spark: SparkSession, t) -> DataFrame:
    return _first_element_bins(trees.label_tree(t("embeddings"))).withColumn("occupancy_variance", F.round("occupancy_variance", 6))


@R.query()
def pca_axis_strength(spark: SparkSession, t) -> DataFrame:
    """Power iteration; held against numpy in the tests."""
    axes = spread.principal_axes(trees.label_tree(t("embeddings")).entries)
    return axes.select("block_id", F.round("strength", 6).alias("strength"))


@R.query(f"WITH {_TREE}, {_BEAM} SELECT q AS query_id, neighbor AS neighbor_id, b AS block_id, position, round(score, 6) AS score FROM hits WHERE position < 5")
def beam_search_top5(spark: SparkSession, t) -> DataFrame:
    _, hits, _ = _beam(t, 5)
    return hits.select("query_id", "neighbor_id", "block_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"))


_RECALL = f"""m AS (SELECT x.query_id, k, count(*) AS possible, count(h.q) AS matched FROM (SELECT unnest([1, 5, 10]) AS k) ks JOIN ({_EXACT}) x ON x.position < k
  LEFT JOIN hits h ON h.q = x.query_id AND h.neighbor = x.neighbor_id AND h.position < k GROUP BY x.query_id, k)"""


@R.query(f"""WITH {_TREE}, {_BEAM}, {_RECALL} SELECT k, count(*) AS queries, round(avg(matched / possible), 6) AS mean_recall, round(CASE WHEN count(*) > 1 THEN stddev_pop(matched / possible) ELSE 0 END, 6) AS stdev_recall FROM m GROUP BY k""")
def tnn_recall(spark: SparkSession, t) -> DataFrame:
    _, hits, _ = _beam(t)
    rows = search.recall(search.exact_top(_entries(t), _sample(t)), hits)
    share = F.col("matched") / F.col("possible")
    return rows.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg(share), 6).alias("mean_recall"), F.round(spread.stdev(share), 6).alias("stdev_recall"))


@R.query(f"WITH {_TREE}, {_BEAM}, {_RECALL} SELECT k, matched, count(*) AS samples FROM m GROUP BY k, matched")
def recall_histogram(spark: SparkSession, t) -> DataFrame:
    _, hits, _ = _beam(t)
    return search.recall(search.exact_top(_entries(t), _sample(t)), hits).groupBy("k", "matched").agg(F.count("*").alias("samples"))


@R.query(f"WITH {_TREE}, {_BEAM} SELECT q AS query_id, level, count(*) AS blocks, sum(n_bytes)::BIGINT AS bytes, ceil(sum(n_bytes) / 65536)::BIGINT AS round_trips FROM touched JOIN {_SIZE} z USING (b) GROUP BY q, level")
def query_access_levels(spark: SparkSession, t) -> DataFrame:
    tree, _, touched = _beam(t)
    return search.level_access(touched, _sizes(tree))


@R.query(f"""WITH {_TREE}, {_BEAM}, l AS (SELECT q, level, ceil(sum(n_bytes) / 65536)::BIGINT AS rt FROM touched JOIN {_SIZE} z USING (b) GROUP BY q, level)
SELECT level, count(*) AS blocks, sum(n_bytes)::BIGINT AS bytes, (SELECT sum(rt)::BIGINT FROM l WHERE l.level = u.level) AS round_trips FROM (SELECT DISTINCT b, level FROM touched) u JOIN {_SIZE} z USING (b) GROUP BY level""")
def query_access_summary(spark: SparkSession, t) -> DataFrame:
    tree, _, touched = _beam(t)
    return search.access_summary(touched, _sizes(tree))


def _inputs(t) -> DataFrame:
    """Embeddings with planted faults: every 50th missing, every 41st zero, every 29th a copy of one vector."""
    fixed = t("embeddings").where("vec_id = 1").select(F.col("embedding").alias("one"))
    rows = t("embeddings").crossJoin(F.broadcast(fixed))  # one row
    value = F.when(F.col("vec_id") % 50 == 0, F.lit(None)).when(F.col("vec_id") % 41 == 0, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))).when(F.col("vec_id") % 29 == 0, F.col("one")).otherwise(F.col("embedding"))
    return rows.select(F.col("vec_id").alias("ix"), F.transform(value, lambda x: F.abs(F.round(x, 4)).cast("float")).alias("embedding"))


_INPUTS = """i AS (SELECT vec_id AS ix, CASE WHEN vec_id % 50 = 0 THEN NULL ELSE list_transform(CASE WHEN vec_id % 41 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN vec_id % 29 = 0 THEN (SELECT embedding FROM embeddings WHERE vec_id = 1) ELSE embedding END, lambda x: abs(round(x::DOUBLE, 4))::FLOAT) END AS e FROM embeddings),
o AS (SELECT ix, e, e::VARCHAR AS f, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS l2 FROM i), g AS (SELECT f, count(*) AS n FROM o WHERE e IS NOT NULL GROUP BY f)"""


@R.query(f"""WITH {_INPUTS}, d AS (SELECT j, var_pop(v) AS var FROM (SELECT unnest(e)::DOUBLE AS v, unnest(range(len(e))) AS j FROM o WHERE e IS NOT NULL) GROUP BY j)
SELECT count(*) AS input_count, count(e) AS available_count, count(*) FILTER (e IS NULL) AS missing_count, 0::BIGINT AS non_finite_count, count(*) FILTER (l2 <= 2.220446049250313e-16) AS zero_count,
  round(min(l2), 6) AS min_l2, round(avg(l2), 6) AS mean_l2, round(max(l2), 6) AS max_l2, (SELECT count(*) FROM g) AS unique_count, (SELECT sum(n - 1)::BIGINT FROM g) AS repeated_count,
  (SELECT count(*) FROM g WHERE n > 1) AS repeated_groups, (SELECT max(n) FROM g WHERE n > 1) AS max_occurrence, (SELECT count(*) FROM d WHERE var > 1e-12) AS varying_dimensions, (SELECT round(max(var), 6) FROM d) AS max_variance FROM o""")
def embedding_health(spark: SparkSession, t) -> DataFrame:
    out = health.health(_inputs(t))
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes))


@R.query(f"""WITH {_INPUTS} SELECT n AS occurrences, (SELECT string_agg(ix::VARCHAR, ',' ORDER BY ix) FROM (SELECT ix FROM o WHERE o.f = g.f ORDER BY ix LIMIT 5)) AS sample_inputs FROM g WHERE n > 1""")
def repeated_embeddings(spark: SparkSession, t) -> DataFrame:
    return health.repeated_groups(_inputs(t), groups=None).drop("fingerprint")


@R.query(f"""WITH {_INPUTS} SELECT ix, concat_ws(',', CASE WHEN e IS NULL THEN 'missing-embedding' END, CASE WHEN l2 <= 2.220446049250313e-16 THEN 'zero-vector' END, CASE WHEN n > 1 THEN 'repeated-embedding' END) AS reasons
FROM o LEFT JOIN g USING (f) WHERE e IS NULL OR l2 <= 2.220446049250313e-16 OR n > 1 ORDER BY ix LIMIT 5""")
def suspicious_inputs(spark: SparkSession, t) -> DataFrame:
    return health.suspicious(_inputs(t))


@R.query()
def built_tree_leaves(spark: SparkSession, t) -> DataFrame:
    """A tree built by clustering; every vector lies in one leaf and no block exceeds the fan-out (see the tests)."""
    tree = trees.build_tree(t("embeddings").select(F.col("vec_id").alias("entry_ix"), "embedding"), DIMS, clusters=8)
    return tree.entries.join(tree.blocks, "block_id").groupBy("block_id", "level").agg(F.count("*").alias("n"))


def _chosen(walk: str, depth: int, block: str, salt: str, n: str) -> str:
    """SQL of a walk's choice: the first eight bytes of a hash, little-endian, modulo ``n``."""
    number = lambda x: f"unhex(printf('%02x', {x}) || '00000000000000')"  # noqa: E731  walks and depths are below 256
    digest = f"sha256({number(SEED)} || {number(walk)} || {number(depth)} || encode({block}) || encode('{salt}'))"
    low_first = " || ".join(f"substr({digest}, {i}, 2)" for i in range(15, 0, -2))
    return f"(('0x' || {low_first})::HUGEINT % {n})"


@R.query(f"""WITH b AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT 'B' || (label % 3) AS c FROM embeddings)),
l AS (SELECT 'B' || (label % 3) AS p, 'L' || label AS c, row_number() OVER (PARTITION BY label % 3 ORDER BY 'L' || label) - 1 AS ix, count(*) OVER (PARTITION BY label % 3) AS n FROM (SELECT DISTINCT label FROM embeddings)),
e AS (SELECT 'L' || label AS p, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ix, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
w1 AS (SELECT w, b.c FROM (SELECT unnest(range({SAMPLE})) AS w) JOIN b ON b.ix = {_chosen('w', 0, "'R'", 'branch-child', 'b.n')}),
w2 AS (SELECT w, l.c FROM w1 JOIN l ON l.p = w1.c AND l.ix = {_chosen('w', 1, 'w1.c', 'branch-child', 'l.n')})
SELECT w AS walk, w2.c AS block_id, vec_id AS entry_ix FROM w2 JOIN e ON e.p = w2.c AND e.ix = {_chosen('w', 2, 'w2.c', 'leaf-entry', 'e.n')}""")
def random_walk_access(spark: SparkSession, t) -> DataFrame:
    """Deterministic descents; each choice is a hash modulo the block's entries (see the tests)."""
    tree = trees.label_tree(t("embeddings"))
    return search.random_walks(tree, "R", SEED, SAMPLE)


# --- planning --------------------------------------------------------------------------------------------

#: Entries that a planned partition holds at most.
PARTITION = 12


@R.query(f"""WITH RECURSIVE parts AS (SELECT 0 AS pass_no, count(*)::BIGINT AS n FROM embeddings
  UNION ALL SELECT pass_no + 1, ((i + 1) * n + w - 1) // w - (i * n + w - 1) // w FROM (
    SELECT pass_no, n, w, unnest(range(w)) AS i FROM (SELECT *, least({PARTITION}, greatest(1, (n + {PARTITION} - 1) // {PARTITION})) AS w FROM parts WHERE n > {PARTITION} OR pass_no = 0))),
s AS (SELECT pass_no, count(*) AS made, count(*) FILTER (n <= {PARTITION}) AS ended, count(*) FILTER (n > {PARTITION}) AS pending FROM parts WHERE pass_no > 0 GROUP BY pass_no),
c AS (SELECT *, sum(ended) OVER (ORDER BY pass_no) AS terminal FROM s),
l AS (SELECT *, lag(terminal) OVER (ORDER BY pass_no) AS t0, lag(pending) OVER (ORDER BY pass_no) AS g0 FROM c)
SELECT pass_no, (SELECT count(*) FROM embeddings) AS items, (terminal + pending)::BIGINT AS planned, terminal::BIGINT AS terminal, pass_no AS depth, made AS realized_clusters, pending = 0 AS complete,
  CASE WHEN pending = 0 THEN 'converging' WHEN t0 IS NULL OR ((terminal > t0 OR pending < g0) AND (terminal < t0 OR pending > g0)) THEN 'inconclusive'
    WHEN terminal > t0 OR pending < g0 THEN 'converging' ELSE 'not-converging' END AS verdict FROM l""")
def planning_passes(spark: SparkSession, t) -> DataFrame:
    """The passes of a real plan over all embeddings, with the verdict on each."""
    folder = f"{shared_dir(spark)}/planning-{uuid.uuid4().hex}"
    vectors = t("embeddings").select(F.col("vec_id").alias("entry_ix"), "embedding")
    made = planning.plan(vectors, f"{folder}/run", PARTITION, planning.Telemetry(spark, folder, "run"), "pca")
    told = telemetry.pass_summaries(made.passes, spark.read.parquet(f"{folder}/statuses")).select("pass_no", "verdict")
    return made.passes.join(told, "pass_no").select("pass_no", "items", "planned", "terminal", "depth", "realized_clusters", "complete", "verdict")
