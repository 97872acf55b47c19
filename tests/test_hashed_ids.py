"""Trees over ids that are hashes."""

from pyspark.sql import functions as F

from siltstone.__main__ import main
from siltstone.archive import Archive, hashed_words
from siltstone.operators import store, trees


def test_leaves_fill_to_the_fan_out_for_any_ids(spark):
    rows = spark.range(600).select(F.xxhash64("id").alias("entry_ix"), F.array(*(F.rand(k).cast("float") for k in range(8))).alias("embedding"))
    size = trees.fan_out(8, 32 * 72)
    tree = trees.build_tree(rows, 8, clusters=3, block_bytes=32 * 72)
    leaves = tree.entries.join(tree.blocks.where("level = 0"), "block_id").groupBy("block_id").count().collect()
    assert sum(r["count"] for r in leaves) == 600 and max(r["count"] for r in leaves) <= size
    assert sum(r["count"] < size for r in leaves) <= 3


def test_search_chunks_returns_k_hits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(24):
        (tmp_path / "in" / f"{i:02}.txt").write_bytes(f"a note on bird{i}".encode())
    common = ["--archive", f"file://{tmp_path}/archive", "--refs", str(tmp_path / "refs"), "--dims", "32"]
    assert main([*common, "run", "--documents", f"file://{tmp_path}/in"]) == 0
    archive = Archive(spark, f"file://{tmp_path}/archive", str(tmp_path / "refs"))
    root = store.load_ref(archive.refs, "main")["current_root_block_id"]
    assert len(archive.search_chunks("a note on bird3", hashed_words(32), root, k=5, width=3)["hits"]) == 5
