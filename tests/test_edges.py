"""Edges of every kind: each once, whatever its parent is called, and what travels for them."""

import hashlib

from siltstone.operators import graph


def test_edges_are_told_once_and_travel_as_bytes_by_parent(spark):
    a, b, c = (hashlib.sha256(x.encode()).hexdigest() for x in "abc")
    branches = spark.createDataFrame([(a, b), (a, b.upper()), (a.upper(), b), ("plain", c), ("plain", c), (None, c), (a, "no hash")], "parent_id string, child_id string")
    leaves = spark.createDataFrame([(a, {"email_artifact_ref": b})], "block_id string, metadata map<string,string>")
    records = spark.createDataFrame([(a, b, (None,))], "block_id string, item_block_id string, content_ref struct<email_ref:string>")
    blocks = spark.createDataFrame([(a, None), (b, a)], "block_id string, previous_block_id string")
    emails = spark.createDataFrame([(c, None)], "block_id string, mailbox_artifact_ref string")
    edges, failures = graph.child_edges(branches, leaves, records, blocks, emails)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(parent#") == 1  # 32 bytes a hash, a parent's edges together
    want = [(None, c, "branch"), (a, b, "artifact"), (a, b, "branch"), (a, b, "journal-item"), (a.upper(), b, "branch"), (b, a, "journal-previous"), ("plain", c, "branch")]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, edges.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, failures.collect())) == sorted([(a, "no block hash: no hash"), (c, "email without mailbox_artifact_ref")])
