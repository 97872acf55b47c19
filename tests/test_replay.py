"""The replay journal, source snapshots, and ingestion that never loses rows."""

import pytest
from pyspark.sql import functions as F

from siltstone.archive import Archive, hashed_words
from siltstone.operators import invariants, replay, search, store, trees, workflow
from siltstone.sources import snapshot
from siltstone.sources.requests import Request
from siltstone.streaming import events
from tests.test_invariants import AT, BASE

ITEMS = "block_id string, kind string, path string, email_ref string, chunk_index int, metadata map<string,string>"


def _items(spark, ids):
    return spark.createDataFrame([(f"{i:064x}", "document" if i % 2 else "email-chunk", f"a\\{i}.txt", None if i % 2 else "r", None if i % 2 else i, {"z": str(i), "a": "x"}) for i in ids], ITEMS)


def test_journal_grows_in_bounded_blocks_and_replays_in_order(spark, tmp_path):
    folder, refs = f"file://{tmp_path}/archive", str(tmp_path / "refs")
    heads = []
    for ids in (range(40), range(40, 47), range(0)):
        heads.append(replay.append(replay.records_from_items(_items(spark, ids)), folder, refs, "main", ["item_block_id"], limit=1500))
    assert heads[0] != heads[1] == heads[2] == store.load_ref(refs, "main")["replay_journal_head_block_id"]
    blocks = spark.read.parquet(f"{folder}/journal_blocks").collect()
    assert all(b.n_bytes + replay.OVERHEAD <= 1500 for b in blocks) and sum(b.n_records for b in blocks) == 47 and len(blocks) > 10
    rows = replay.read(spark, folder, heads[1]).orderBy(F.desc("steps"), "seq").collect()
    assert [r.item_block_id for r in rows][:40] == [f"{i:064x}" for i in range(40)] and len(rows) == 47
    assert replay.read(spark, folder, heads[0]).count() == 40 and replay.read(spark, folder, None).count() == 0
    items = replay.items_from_records(replay.read(spark, folder, heads[1])).collect()
    assert {i.path for i in items if i.kind == "document"} == {f"a/{i}.txt" for i in range(1, 47, 2)}
    with pytest.raises(Exception, match="maximum payload"):
        replay.append(replay.records_from_items(_items(spark, [1])), folder, refs, "main", ["item_block_id"], limit=150)
    assert store.load_ref(refs, "main")["replay_journal_head_block_id"] == heads[1]


def test_digests_do_not_depend_on_the_order_of_metadata(spark):
    rows = spark.sql("SELECT 'k' AS k, map('a', '1', 'b', '2') AS m UNION ALL SELECT 'k', map('b', '2', 'a', '1') UNION ALL SELECT 'k', map('a', '1b', '', '2')")
    digests = [r.d for r in rows.select(replay.sort_digest(F.col("k"), F.col("m")).alias("d")).collect()]
    assert digests[0] == digests[1] != digests[2]


def test_entries_must_match_their_leaves(spark):
    leaves = spark.createDataFrame([("1", "k1", {"a": "b"}), ("2", "k2", {"a": "b"})], "block_id string, content_key string, metadata map<string,string>")
    entries = leaves.select("block_id", replay.sort_digest(F.col("content_key"), F.col("metadata")).alias("digest"))
    assert replay.checked_entries(entries, leaves).count() == 2 and replay.broken_entries(entries, leaves).count() == 0
    other = leaves.withColumn("metadata", F.create_map(F.lit("a"), F.col("block_id")))
    with pytest.raises(Exception, match="does not match"):
        replay.checked_entries(entries, other).collect()
    with pytest.raises(Exception, match="missing block"):
        replay.checked_entries(entries, leaves.where("block_id = '1'")).collect()
    artifacts = spark.createDataFrame([("r", "text")], "block_id string, body string")
    chunks = spark.createDataFrame([("c", "r")], "chunk string, email_ref string")
    assert replay.with_artifact(chunks, artifacts).first().body == "text"
    with pytest.raises(Exception, match="missing artifact"):
        replay.with_artifact(chunks, artifacts.where("false")).collect()


def test_leaves_become_records(spark):
    rows = [("1", "leaf", 0, 2, "f32le", 1, [1.0, 0.0], {"source_kind": "document", "source_path": "p"}), ("2", "leaf", 0, 2, "f32le", 2, [1.0, 0.0], {"source_kind": "document", "source_path": "q"}), ("3", "branch", 1, 2, "f32le", 1, [1.0], {})]
    leaves = spark.createDataFrame(rows, "block_id string, kind string, level int, dims int, encoding string, n_entries int, embedding array<float>, metadata map<string,string>")
    (r,) = replay.records_from_leaves(leaves, 2, "f32le").collect()
    assert (r.item_block_id, r.content_ref.path, r.record_kind) == ("1", "p", "replay-input")


def test_snapshot_is_taken_once_and_reused(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.mbox").write_bytes(b"From x\n\nhello\n")
    (tmp_path / "in" / "sub" / "b.mbox").write_bytes(b"From y\n\nhello\n")
    folder, source = f"file://{tmp_path}/archive", f"file://{tmp_path}/in"
    start = invariants.journal_of(spark, BASE)
    one = snapshot.acquire(spark, start, source, "u", folder, AT)
    assert not one["reused"] and sorted(r.work_id for r in one["work"].collect()) == ["mailbox:a.mbox", "mailbox:sub/b.mbox"]
    row = one["journal"].first()
    assert (row.current_stage, row.source_snapshot.corpus_manifest_identity, row.source_snapshot.additional_provenance["entry_count"]) == ("mailbox-admission", one["manifest_id"], "2")
    again = snapshot.acquire(spark, one["journal"], source, "u", folder, "later")
    assert again["reused"] and (again["manifest_id"], again["source_snapshot_id"]) == (one["manifest_id"], one["source_snapshot_id"]) and again["work"].count() == 2
    assert snapshot.load_manifest(spark, folder, one["manifest_id"])[1].count() == 2 and spark.read.parquet(f"{folder}/payloads").count() == 2
    with pytest.raises(ValueError, match="about"):
        snapshot.acquire(spark, start, source, "other", folder, AT)
    with pytest.raises(ValueError, match="no manifest"):
        snapshot.load_manifest(spark, folder, "0" * 64)
    lost = invariants._with(one["journal"], "source_snapshot", corpus_manifest_identity=F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="names no manifest"):
        snapshot.acquire(spark, lost, source, "u", folder, AT)
    spark.read.parquet(f"{folder}/manifests").withColumn("schema_version", F.lit(2)).withColumn("block_id", F.lit("x")).write.mode("append").parquet(f"{folder}/manifests")
    with pytest.raises(ValueError, match="schema_version"):
        snapshot.load_manifest(spark, folder, "x")


def test_a_second_ingest_adds_to_the_table(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    for n, keys in enumerate((range(5), range(3, 9))):
        spark.createDataFrame([(k,) for k in keys], "key long").write.parquet(f"file://{tmp_path}/in{n}")
        for _ in range(2):
            events.ingest(events.file_stream(spark, f"file://{tmp_path}/in{n}", "key long"), "key", table)
    assert sorted(r.key for r in spark.read.parquet(table).collect()) == list(range(9))


def test_heartbeats_repeat_nothing_and_streams_can_be_stopped(spark, tmp_path):
    said = []
    beat = events.Heartbeat(said.append)
    for message in ("a", "a", "b", "a"):
        beat._tell(message)
    assert said == ["a", "b", "a"]
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/log").start()
    assert events.cancel(spark) == 1 and not query.isActive


def test_archive_replays_without_embedding_and_a_copy_can_be_searched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(30):
        (tmp_path / "in" / f"{i:02}.txt").write_bytes(f"note {i} on subject{i} and thing{i * 7}".encode())
    folder, refs = f"file://{tmp_path}/archive", str(tmp_path / "refs")
    archive = Archive(spark, folder, refs)
    request = Request("main", documents=f"file://{tmp_path}/in", dims=16, block_bytes=(4 * 16 + trees.ENTRY_OVERHEAD) * 4)
    assert archive.ingest(request, hashed_words(16)) == 30
    root = archive.build(request)
    head = store.load_ref(refs, "main")["replay_journal_head_block_id"]
    assert archive.build(request) == root and store.load_ref(refs, "main")["replay_journal_head_block_id"] == head  # the same tree is recorded once
    assert archive.replayed("main").count() == 30
    for i in range(30, 34):
        (tmp_path / "in" / f"{i:02}.txt").write_bytes(f"note {i} on subject{i}".encode())
    assert archive.ingest(request, hashed_words(16)) == 4
    newer = archive.build(Request("main", dims=16, block_bytes=request.block_bytes, stages=("cluster",)))
    assert newer != root and archive.search_chunks("note 3 on subject3 and thing21", hashed_words(16), root, k=1, width=9)["hits"]
    tree = archive.tree(newer)
    leaves = tree.entries.join(tree.blocks.where("level = 0"), "block_id").groupBy("block_id").count().collect()
    assert sum(r["count"] for r in leaves) == 34 and max(r["count"] for r in leaves) <= 4 and archive.tree(root).blocks.count() < archive.tree().blocks.count()
    ends = archive._journal("main").where("record_kind = 'indexing-outcome'")
    assert {r.item_block_id for r in ends.collect()} == {root, newer}
    other = Archive(spark, f"file://{tmp_path}/copy", str(tmp_path / "refs2"))
    report = archive.copy([newer], other.folder).first()
    assert report.failed == 0 and report.copied == other.tree().blocks.count() == tree.blocks.count()
    query = "note 33 on subject33"
    hits = [archive.search_chunks(query, hashed_words(16), newer, k=3, width=4)["hits"], other.search_chunks(query, hashed_words(16), newer, k=3, width=4)["hits"]]
    assert hits[0] == hits[1] and hits[0][0]["text"] == query
    again = archive.copy([newer], other.folder).first()
    assert (again.copied, again.skipped) == (0, report.copied) and other.tree().entries.count() == tree.entries.count()
    assert archive.compact()["items"] == 34 and archive.search_chunks(query, hashed_words(16), newer, k=1)["hits"]
    with pytest.raises(ValueError, match="no email"):
        archive.get_leaf_email(archive.table("items").first().block_id)
    with pytest.raises(ValueError, match="holds no"):
        archive.get_leaf_email("x")


def test_tree_ids_are_hashes_of_content(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "entry_ix long, embedding array<float>")
    ids = lambda v, **k: {r.block_id for r in trees.build_tree(v, 3, block_bytes=52 * 4, **k).blocks.collect()}
    one = ids(vectors, method="pca")
    assert one == ids(vectors.repartition(7), method="pca") and all(len(x) == 64 for x in one)
    changed = vectors.withColumn("embedding", F.when(F.col("entry_ix") == 7, F.array(*(F.lit(x).cast("float") for x in (9, 9, 9)))).otherwise(F.col("embedding")))
    assert one != ids(changed, method="pca") and one & ids(changed, method="pca")


def test_many_clusters_need_few_centres(spark, monkeypatch):
    monkeypatch.setattr(trees, "MAX_CENTRES", 4)
    rows = [(i, [float(i % 7) + 1, float(i % 11), float(i)]) for i in range(120)]
    tree = trees.build_tree(spark.createDataFrame(rows, "entry_ix long, embedding array<float>"), 3, clusters=16, block_bytes=52 * 30)
    leaves = tree.blocks.where("level = 0").join(tree.entries, "block_id").groupBy("block_id").count().collect()
    assert sum(r["count"] for r in leaves) == 120 and len(leaves) > 4


def test_random_walks_choose_by_hash(spark):
    import hashlib

    rows = [(i, i % 6, [float(i % 6), float(i)]) for i in range(50)]
    tree = trees.label_tree(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    got = {r.walk: (r.block_id, r.entry_ix) for r in search.random_walks(tree, "R", 9, 20).collect()}
    entries = {}
    for r in tree.entries.orderBy("block_id", "entry_ix").collect():
        entries.setdefault(r.block_id, []).append(r.entry_ix)
    child = {(e.parent_id, e.child_ix): e.child_id for e in tree.edges.collect()}
    little = lambda n: n.to_bytes(8, "little")
    for walk in range(20):
        at = "R"
        for depth, kind in enumerate(("branch-child", "branch-child", "leaf-entry")):
            digest = hashlib.sha256(little(9) + little(walk) + little(depth) + at.encode() + kind.encode()).digest()
            chosen = int.from_bytes(digest[:8], "little") % len(entries[at])
            if kind == "leaf-entry":
                assert got[walk] == (at, entries[at][chosen])
            else:
                at = child[(at, chosen)]
