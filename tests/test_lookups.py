"""Tables in buckets: what a look for a few ids reads, and searches that read with width and depth."""

import json

from pyspark.sql import functions as F

from siltstone.archive import Archive, hashed_words
from siltstone.operators import search, store, trees
from siltstone.sources.requests import Request


def _files_read(rows):
    """Files that the scan of ``rows`` opened when they were collected."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numFiles").value(), plan


def test_a_look_reads_files_by_ids_not_by_size(spark, tmp_path):
    ids = lambda lo, hi: spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("block_id"), "id")
    path = f"file://{tmp_path}/t"
    wanted = ids(7, 10)
    counts = []
    for lo, hi in ((0, 3_000), (3_000, 12_000)):
        store.append_bucketed(ids(lo, hi), path, "block_id")
        table = spark.read.parquet(path)
        found = store.only(table, "block_id", wanted.select("block_id"))
        n, plan = _files_read(found)
        assert sorted(r.id for r in found.collect()) == [7, 8, 9]
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(block_id" in plan.replace(" ", "")
        assert len(table.inputFiles()) >= 256
        counts.append(n)
    assert counts[0] <= 3 * 2 and counts[1] <= 2 * counts[0] + 3  # an append adds a file to a bucket, its size adds none
    many = ids(0, store.MAX_PROBES + 5)
    assert store.only(table, "block_id", many.select("block_id")).join(many.select("block_id"), "block_id").count() == store.MAX_PROBES + 5
    assert store.only(table.drop("bucket"), "block_id", wanted.select("block_id")).count() == 12_000
    assert store.only(table, "block_id", []).count() == 0


def test_bucketed_and_plain_trees_are_searched_alike(spark, tmp_path):
    vectors = spark.range(600).select(F.col("id").alias("entry_ix"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    tree = trees.build_tree(vectors, 8, "pca", None, 0, 1_000)
    root = tree.blocks.orderBy(F.desc("level")).first()["block_id"]
    for name, key, rows in (("blocks", "block_id", tree.blocks), ("edges", "parent_id", tree.edges), ("entries", "block_id", tree.entries)):
        store.append_bucketed(rows, f"file://{tmp_path}/{name}", key)
    other = trees.Tree(*(spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("blocks", "edges", "entries")))
    queries = vectors.where("entry_ix % 100 = 0").select(F.col("entry_ix").alias("query_id"), F.col("embedding").alias("target"))
    for a, b in zip(search.beam_search(tree, queries, root, 3, 5), search.beam_search(other, queries, root, 3, 5)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_an_archive_is_searched_and_looked_up_by_what_is_touched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(30):
        (tmp_path / "in" / f"{i:02}.mbox").write_bytes(f"From x\nSubject: topic {i}\n\nword{i} speaks of item{i}.\n".encode())
        (tmp_path / "in" / f"{i:02}.txt").write_bytes(b"the same note" if i < 20 else f"note {i}".encode())
    archive, provider = Archive(spark, f"file://{tmp_path}/a", str(tmp_path / "refs")), hashed_words(16)
    request = Request("main", documents=f"file://{tmp_path}/in", mailboxes=f"file://{tmp_path}/in", dims=16, stages=("ingest", "cluster"), block_bytes=700)
    assert archive.ingest(request, provider) == 60 and archive.ingest(request, provider) == 0
    root = archive.build(request)
    found = archive.search_chunks("the same note", provider, root, k=4, width=3)
    assert [h["text"] for h in found["hits"]] == ["the same note"] * 4 and [h["position"] for h in found["hits"]] == [0] * 4
    paths = [h["source_path"] for h in found["hits"]]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["00.txt", "01.txt", "02.txt", "03.txt"]  # of twenty items, the first four by path
    hit = archive.search_chunks("word7 speaks of item7.", provider, root, k=1, width=3)["hits"][0]
    assert (hit["source_kind"], hit["source_name"], hit["media_type"]) == ("email", "topic 7", "text/plain")
    assert set(found["timing"]) == {"root_load_ms", "embedding_ms", "target_preparation_ms", "traversal_ms", "total_ms"}
    item = archive.table("items").where("text LIKE 'word9 %'").first()
    assert [r.block_id for r in archive.get_email(item.email_ref).collect()] == [item.block_id]
    assert archive.get_leaf_email(item.block_id)["text"] == item.text
    n, plan = _files_read(store.only(archive.table("items"), "block_id", [item.block_id]))
    assert n == 1 and len(archive.table("items").inputFiles()) > 20
    json.dumps(found)
