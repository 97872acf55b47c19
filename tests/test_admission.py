"""Admission by batch and by stream: references, exactly-once journals, safe compaction, copies that tell what failed."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.archive import Archive, hashed_words
from siltstone.operators import replay, store
from siltstone.sources import mail
from siltstone.sources.requests import Request
from siltstone.streaming import events


class Died(BaseException):
    pass


def _request(tmp_path, **more):
    return Request("main", documents=f"file://{tmp_path}/in", dims=8, method="pca", **more)


def _notes(tmp_path, n=9):
    (tmp_path / "in").mkdir(exist_ok=True)
    for i in range(n):
        (tmp_path / "in" / f"{i}.txt").write_bytes(f"note {i % 7}".encode())


def _state(archive):
    """What an archive holds, without what differs from run to run (the cut of the journal into blocks)."""
    records = archive._journal("main").where("record_kind = 'replay-input'")
    return (
        sorted(r.block_id for r in archive.table("items").collect()), sorted(r.item_block_id for r in records.collect()),
        sorted(r.input_hash for r in archive.table("embeddings").collect()), sorted((r.key_hash, r.block_id) for r in archive.table("keys").collect()), archive.replayed("main").count(),
    )


@pytest.mark.parametrize("point", ["_add_keys", "append", "update_ref", "after"])
def test_a_stream_that_dies_anywhere_gives_the_batch_result(spark, tmp_path, monkeypatch, point):
    _notes(tmp_path)
    batch = Archive(spark, f"file://{tmp_path}/batch", str(tmp_path / "batch-refs"))
    assert batch.ingest(_request(tmp_path), hashed_words(8)) == 9
    items = mail.document_items(spark, f"file://{tmp_path}/in")
    items.repartition(3, "path").write.parquet(f"file://{tmp_path}/items")
    archive = Archive(spark, f"file://{tmp_path}/stream", str(tmp_path / "stream-refs"))
    owner, name = {"_add_keys": (Archive, "_add_keys"), "append": (replay, "append"), "update_ref": (store, "update_ref"), "after": (Archive, "_admit")}[point]
    real, calls = getattr(owner, name), []

    def dies(*args, **options):
        calls.append(1)
        if len(calls) == 2:  # in the second batch: before the step, or just after all of them
            if point == "after":
                real(*args, **options)
            raise RuntimeError("died")
        return real(*args, **options)

    def run():
        stream = events.file_stream(spark, f"file://{tmp_path}/items", items.schema)
        archive.ingest_stream(stream, _request(tmp_path), hashed_words(8), f"file://{tmp_path}/checkpoint")

    monkeypatch.setattr(owner, name, dies)
    with pytest.raises(Exception, match="died"):
        run()
    monkeypatch.setattr(owner, name, real)
    run()
    run()
    assert _state(archive) == _state(batch)
    assert store.load_ref(archive.refs, "main")["metadata"]["stream:stream"].isdigit()


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    refs, folder = str(tmp_path / "refs"), f"file://{tmp_path}/j"
    records = lambda lo: spark.range(lo, lo + 5).select(F.lit("replay-input").alias("record_kind"), F.sha2(F.col("id").cast("string"), 256).alias("item_block_id"), F.lit(None).cast("struct<kind:string,path:string,email_ref:string,chunk_index:int>").alias("content_ref"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("digest"))
    replay.append(records(0), folder, refs, "main", ["item_block_id"])
    real, gate, out = store.update_ref, threading.Barrier(2), []

    def together(*args, **options):
        gate.wait(300)
        return real(*args, **options)

    def write(lo):
        try:
            out.append(replay.append(records(lo), folder, refs, "main", ["item_block_id"]))
        except store.Conflict as error:
            out.append(error)

    store.update_ref = together
    try:
        threads = [threading.Thread(target=write, args=(lo,)) for lo in (100, 200)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        store.update_ref = real
    lost = [x for x in out if isinstance(x, store.Conflict)]
    assert len(lost) == 1 and "head of main" in str(lost[0])
    assert replay.read(spark, folder, store.load_ref(refs, "main")["replay_journal_head_block_id"]).count() == 10


def test_a_reference_comes_back_if_its_replacement_fails(tmp_path, monkeypatch):
    folder = str(tmp_path)
    before = store.update_ref(folder, "a/b", root="r1", head="h1")
    real = os.replace

    def fails(source, target):
        if not str(target).endswith(".bak") and not str(source).endswith(".bak"):
            raise OSError("disk")
        return real(source, target)

    monkeypatch.setattr(os, "replace", fails)
    with pytest.raises(OSError, match="disk"):
        store.update_ref(folder, "a/b", root="r2")
    monkeypatch.setattr(os, "replace", real)
    assert store.load_ref(folder, "a/b") == before and sorted(os.listdir(tmp_path / "a")) == ["b.json", "b.json.lock"]
    with pytest.raises(store.Conflict):
        store.update_ref(folder, "a/b", head="h9", expected_head="h0")
    os.replace(tmp_path / "a" / "b.json", tmp_path / "a" / "b.json.bak")  # a crash between backup and replacement
    assert store.load_ref(folder, "a/b") == before
    assert store.update_ref(folder, "a/b", head="h2", expected_head="h1")["current_root_block_id"] == "r1"


def test_compaction_makes_a_generation_and_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    _notes(tmp_path)
    archive = Archive(spark, f"file://{tmp_path}/a", str(tmp_path / "refs"))
    archive.ingest(_request(tmp_path), hashed_words(8))
    root, before = archive.build(_request(tmp_path)), _state(archive)
    real = store.replace_document
    monkeypatch.setattr(store, "replace_document", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        archive.compact()
    assert _state(archive) == before
    monkeypatch.setattr(store, "replace_document", real)
    counts = archive.compact()
    assert counts["items"] == 9 and _state(archive) == before
    assert archive.search_chunks("note 3", hashed_words(8), root, k=1)["hits"][0]["text"] == "note 3"
    gone = archive.vacuum()
    assert "items" in gone and any(x.startswith("items-") for x in gone) and archive.vacuum() == []
    (tmp_path / "in" / "new.txt").write_bytes(b"a new note")
    assert archive.ingest(_request(tmp_path), hashed_words(8)) == 1 and archive.table("items").count() == 10


def test_a_copy_tells_what_it_could_not_read(spark, tmp_path):
    _notes(tmp_path)
    archive = Archive(spark, f"file://{tmp_path}/a", str(tmp_path / "refs"))
    request = _request(tmp_path, block_bytes=150)
    archive.ingest(request, hashed_words(8))
    root = archive.build(request)
    assert archive.copy([root], f"file://{tmp_path}/b").first().failed == 0 and archive.copy_failures([root]).count() == 0
    lost = archive.table("blocks").where("level = 0").first()["block_id"]
    kept = archive.table("blocks").where(F.col("block_id") != lost).collect()
    schema = archive.table("blocks").schema
    archive._path = lambda name, real=archive._path: f"file://{tmp_path}/damaged" if name == "blocks" else real(name)
    spark.createDataFrame(kept, schema).write.partitionBy("bucket").parquet(f"file://{tmp_path}/damaged")
    assert archive.copy([root], f"file://{tmp_path}/c").first().failed == 1
    assert [tuple(r) for r in archive.copy_failures([root]).collect()] == [(lost, root, "read", f"block is not in the source: {lost}")]
    json.dumps(store.load_ref(archive.refs, "main"))
