"""Depth-first traversal and its findings against a recursive walk, on random graphs with shared children, cycles and missing blocks."""

import random

import pytest

from siltstone.operators import graph
from siltstone.plans import catalog
from tests.oracle import compare


def walk(edges, blocks, root):
    visited, out, order = set(), [], []

    def enter(b, parent, path):
        visited.add(b)
        order.append((b, len(path)))
        if parent:
            if blocks[b][0] >= blocks[parent][0]:
                out.append(("child-level-not-lower", parent, b))
            if blocks[b][1] != blocks[parent][1]:
                out.append(("embedding-spec-mismatch", parent, b))
        for _, child in sorted(edges.get(b, [])):
            if child in [*path, b]:
                out.append(("cycle", b, child))
            elif child in visited:
                out.append(("shared-child", b, child))
            elif child not in blocks:
                out.append(("missing-child", b, child))
            else:
                enter(child, b, [*path, b])

    if root in blocks:
        enter(root, None, [])
    return sorted(out), sorted(order)


@pytest.mark.parametrize("seed", range(6))
def test_findings_of_random_graphs(spark, seed):
    """Six graphs a run, their names apart, so that one job walks them all from six roots."""
    rng = random.Random(seed)
    rows, blocks, want, reached, roots = [], {}, [], [], []
    for g in range(6):
        n = rng.randint(1, 9)
        names = [f"{g}-{i}" for i in range(n + 1)]
        mine = {b: (rng.randint(0, 3), rng.choice([2, 2, 2, 3])) for b in names[: n + (rng.random() < 0.3)]}
        edges = {}
        for _ in range(rng.randint(0, 2 * n)):
            parent = rng.choice(names)
            edges.setdefault(parent, []).append((len(edges.get(parent, [])), rng.choice(names)))
        found, order = walk(edges, mine, names[0])
        want += found
        reached += order
        blocks |= mine
        roots.append(names[0])
        rows += [(p, ix, c) for p, xs in edges.items() for ix, c in xs]
    e = spark.createDataFrame(rows, "parent_id string, child_ix int, child_id string").repartition(3)
    b = spark.createDataFrame([(k, *v) for k, v in blocks.items()], "block_id string, level int, dims int")
    r = spark.createDataFrame([(x,) for x in roots], "block_id string")
    assert sorted((x.block_id, x.depth) for x in graph.traverse(e, b, r).collect()) == sorted(reached)
    assert sorted(tuple(x) for x in graph.findings(e, b, r).collect()) == sorted(want)


def test_a_shared_child_is_judged_once(spark):
    """R over A and B, C under both: the edge from B is shared and nothing else, whatever C's level and spec."""
    e = spark.createDataFrame([("R", 0, "A"), ("R", 1, "B"), ("A", 0, "C"), ("B", 0, "C")], "parent_id string, child_ix int, child_id string")
    b = spark.createDataFrame([("R", 3, 2), ("A", 2, 2), ("B", 1, 2), ("C", 1, 3)], "block_id string, level int, dims int")
    r = spark.createDataFrame([("R",)], "block_id string")
    assert sorted(tuple(x) for x in graph.findings(e, b, r).collect()) == [("embedding-spec-mismatch", "A", "C"), ("shared-child", "B", "C")]


def test_a_deeper_way_can_come_first(spark):
    """Breadth first would enter D from the root; the walk meets it below A."""
    e = spark.createDataFrame([("R", 0, "A"), ("R", 1, "D"), ("A", 0, "B"), ("B", 0, "D"), ("D", 0, "E"), ("E", 0, "A")], "parent_id string, child_ix int, child_id string")
    b = spark.createDataFrame([(x, 9 - i, 2) for i, x in enumerate("RABDE")], "block_id string, level int, dims int")
    got = {x.block_id: "".join(x.path) for x in graph.traverse(e, b, spark.createDataFrame([("R",)], "block_id string")).collect()}
    assert got == {"R": "R", "A": "RA", "B": "RAB", "D": "RABD", "E": "RABDE"}
    assert sorted(tuple(x) for x in graph.findings(e, b, spark.createDataFrame([("R",)], "block_id string")).collect()) == [("cycle", "E", "A"), ("shared-child", "R", "D")]


@pytest.mark.parametrize("name", ["structural_findings", "rooted_closure"])
def test_matches_sql_at_the_next_size(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], "/root/testdata/sf0.01")
