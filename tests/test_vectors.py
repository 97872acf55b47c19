import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import graph, health, search, spread, trees

SF = "/root/testdata/sf0.001"


def _tree(spark):
    return trees.label_tree(spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_axis_strength_equals_numpy(spark):
    tree = _tree(spark)
    entries = {}
    for r in tree.entries.orderBy("block_id", "entry_ix").collect():
        entries.setdefault(r.block_id, []).append(r.embedding)
    for r in spread.principal_axes(tree.entries).collect():
        x = np.array(entries[r.block_id], dtype=float)
        x = x - x.mean(axis=0)
        axis = x[0] / np.linalg.norm(x[0])
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis /= np.linalg.norm(axis)
        assert r.strength == pytest.approx(float(axis @ x.T @ (x @ axis) / (x**2).sum()), abs=1e-9)


def test_single_entry_has_no_axis(spark):
    one = spark.createDataFrame([("a", 0, [1.0, 2.0])], "block_id string, entry_ix long, embedding array<double>")
    row = spread.principal_axes(one).first()
    assert row.strength == 0.0


def test_degenerate_axis_fills_one_bin(spark):
    rows = spark.createDataFrame([("a", 0.0)] * 4, "block_id string, projection double")
    row = spread.quantile_bins(rows).first()
    assert (row.bin0, row.empty_bins, row.overfull_bins) == (4, 3, 1)


def test_leaf_hits_equal_brute_force_in_parts(spark, monkeypatch):
    """Copies, a vector without length, an entry that is there twice; queries in several parts; no row for a pair of query and entry."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 4)).round(2).tolist()
    rows = [(i, base[i % 60] if i % 50 else [0.0] * 4, i % 3) for i in range(240)] + [(7, base[9], 1)]
    entries = spark.createDataFrame([(f"L{b}", i, v) for i, v, b in rows], "block_id string, entry_ix long, embedding array<double>")
    asked = [(i, v, f"L{b}") for i, v, _ in rows[:40] for b in (0, 1)]
    frontier = spark.createDataFrame(asked, "query_id long, target array<double>, block_id string")
    length = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q, t, _ in asked[::2]:
        found = []
        for i, v, b in rows:
            if b in (0, 1) and i != q:
                size = length(t) * length(v)
                found.append((-round(sum(x * y for x, y in zip(t, v)) / size, 12) if size else 9.0, f"L{b}", i))
        want += [(q, at, block, i, None if s == 9.0 else -s) for at, (s, block, i) in enumerate(sorted(found)[:5])]
    for most in (10_000, 30):
        monkeypatch.setattr(search, "MAX_QUERIES", most)
        out = search._leaf_hits(frontier, entries, 5)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.query_id, r.position, r.block_id, r.neighbor_id, r.score if r.score is None else round(r.score, 12)) for r in out.collect())
        assert got == sorted(want)


def _unsteady(spark, block):
    """Four projections of each of 20 blocks, in order, that differ a little each time they are computed."""
    shaky = F.udf(lambda at: float(at) + random.random() / 2, "double").asNondeterministic()
    return spark.range(80).select(block.alias("block_id"), shaky(F.col("id") % 4).alias("projection"))


def test_bins_compare_values_that_were_computed_once(spark):
    rows = spread.quantile_bins(_unsteady(spark, F.floor(F.col("id") / 4))).collect()
    assert len(rows) == 20 and {(r.bin0, r.bin1, r.bin2, r.bin3, r.occupancy_variance, r.empty_bins) for r in rows} == {(1, 1, 1, 1, 0.0, 0)}


def test_layers_of_values_that_were_computed_once(spark):
    block = F.concat(F.lit("b"), F.floor(F.col("id") / 4).cast("string"))
    blocks = spark.range(20).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("block_id"), F.lit(0).alias("level"))
    stats = blocks.select("block_id", F.lit(4).alias("n"), F.array(F.lit(0.0)).alias("centroid"), F.lit(1.0).alias("mean_distance"), F.lit(1.0).alias("max_distance"))
    edges = blocks.select(F.lit("r").alias("parent_id"), F.lit(0).alias("child_ix"), F.col("block_id").alias("child_id"))
    row = spread.layer_metrics(blocks, edges, stats, spread.quantile_bins(_unsteady(spark, block))).first()
    assert (row.block_count, row.mean_occupancy_variance, row.blocks_with_empty_bins, row.blocks_with_overfull_bins) == (20, 0.0, 0, 0)


def test_codecs(spark):
    df = spark.createDataFrame([([1.0, -2.5],)], "v array<float>")
    for kind in ("f32le", "f16le"):
        raw = df.select(V.encode(kind)("v").alias("b"))
        assert raw.select(V.decode(2, kind)("b").alias("v")).first().v == [1.0, -2.5]
        assert raw.select(V.decode(3, kind)("b").alias("v")).first().v is None


def test_two_leaf_recall(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    tree = trees.label_tree(rows)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))
    hits, touched = search.beam_search(tree, queries, "R", 7, 10)
    exact = search.exact_top(rows.select(F.col("vec_id").alias("id"), "embedding"), rows.select(F.col("vec_id").alias("id"), "embedding"))
    got = {(r.query_id, r.k): (r.matched, r.possible) for r in search.recall(exact, hits).collect()}
    assert got == {(q, k): (1, 1) for q in (0, 1) for k in (1, 5, 10)}
    assert touched.count() == 2 * 5


def test_bad_k_is_refused(spark):
    with pytest.raises(ValueError):
        search.exact_top(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), 0)


def test_sample_ignores_order(spark):
    ids = spark.range(8).select(F.col("id"))
    a = [r.id for r in search.seeded_sample(ids, "id", 23, 3).collect()]
    b = [r.id for r in search.seeded_sample(ids.orderBy(F.desc("id")).repartition(3), "id", 23, 3).collect()]
    assert a == b and len(a) == 3


@pytest.mark.parametrize("method", ["kmeans", "pca"])
def test_built_trees_hold_every_vector_once(spark, method):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("entry_ix"), "embedding")
    tree = trees.build_tree(vectors, 64, method, clusters=4, block_bytes=64 * 296)
    leaves = tree.entries.join(tree.blocks.where("level = 0"), "block_id")
    assert leaves.count() == leaves.select("entry_ix").distinct().count() == vectors.count()
    assert tree.entries.groupBy("block_id").count().agg(F.max("count")).first()[0] <= trees.fan_out(64, 64 * 296)
    assert tree.blocks.where(F.col("level") == tree.blocks.agg(F.max("level")).first()[0]).count() == 1
    children = tree.edges.select("child_id").distinct().count()
    assert children == tree.blocks.count() - 1


def test_random_walks_end_in_entries_and_repeat(spark):
    tree = _tree(spark)
    a, b = (search.random_walks(tree, "R", 5, 20).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) == 20
    have = {(r.block_id, r.entry_ix) for r in tree.entries.collect()}
    assert all((r.block_id, r.entry_ix) in have for r in a)


def test_health_counts(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("nan"), 0.0])]
    row = health.health(spark.createDataFrame(rows, "ix long, embedding array<float>")).first()
    assert (row.available_count, row.non_finite_count, row.zero_count, row.repeated_count, row.unique_count, row.repeated_groups, row.max_occurrence) == (4, 1, 1, 1, 2, 1, 2)
    assert health.suspicious(spark.createDataFrame(rows, "ix long, embedding array<float>")).count() == 4


def test_shared_child_is_visited_once_and_failures_name_all_roots(spark):
    edges = spark.createDataFrame([("a", 0, "c"), ("b", 0, "c"), ("c", 0, "gone")], "parent_id string, child_ix long, child_id string")
    blocks = spark.createDataFrame([("a", 2, 2), ("b", 2, 2), ("c", 1, 2)], "block_id string, level int, dims int")
    roots = spark.createDataFrame([("a",), ("b",)], "block_id string")
    assert graph.traverse(edges, blocks, roots).count() == 3
    plan = graph.copy_plan(graph.reaching_roots(edges, roots), blocks, blocks.limit(0))
    assert {r.block_id: r.status for r in plan.collect()} == {"a": "copied", "b": "copied", "c": "copied", "gone": "failed"}
    assert graph.failure_roots(plan.where("status = 'failed'"), edges, roots).first().roots == "a,b"
