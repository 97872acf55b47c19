import pytest
from pyspark.sql import functions as F

from siltstone.__main__ import main
from siltstone.archive import Archive, hashed_words
from siltstone.operators import store
from siltstone.sources.requests import Request, should_retry


def test_request_checks():
    with pytest.raises(ValueError, match="no documents"):
        Request("main").check()
    with pytest.raises(ValueError, match="clusters"):
        Request("main", documents="x", clusters=0).check()
    for bad in ("", "/a", "a//b", "a b", "../x"):
        with pytest.raises(ValueError):
            store.valid_ref_name(bad)
    assert store.valid_ref_name(" a\\b ") == "a/b"
    assert should_retry(0, 2, 503) and not should_retry(2, 2, 503) and not should_retry(0, 2, 404)


def test_refs_merge_and_replace(tmp_path):
    folder = str(tmp_path)
    assert store.load_ref(folder, "x")["current_root_block_id"] is None
    store.update_ref(folder, "x", root="r", metadata={"a": "b"})
    state = store.update_ref(folder, "x", head="h")
    assert (state["current_root_block_id"], state["replay_journal_head_block_id"], state["metadata"]) == ("r", "h", {"a": "b"})


def test_appends_are_idempotent_and_verified(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "bytes string").withColumn("block_id", F.sha2("bytes", 256))
    path = f"file://{tmp_path}/t"
    for _ in range(2):
        store.append_new(store.verified(rows), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="hash differs"):
        store.verified(rows.withColumn("bytes", F.lit("x"))).collect()


def test_replay_items(spark):
    rows = [("1", {"source_kind": "document", "source_path": "p"}), ("2", {"source_kind": "email", "email_artifact_ref": "r", "chunk_index": "3"}), ("3", {"source_kind": "other"})]
    df = spark.createDataFrame(rows, "block_id string, metadata map<string,string>")
    assert [tuple(r) for r in store.replay_items(df).orderBy("block_id").collect()] == [("1", "document", "p", None, None), ("2", "email-chunk", None, "r", 3)]
    with pytest.raises(Exception, match="source_path"):
        store.replay_items(spark.createDataFrame([("1", {"source_kind": "document"})], df.schema)).collect()


def test_archive_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"{i:02}.mbox").write_bytes(f"From x\nSubject: topic {i}\nTo: l@x\n\nword{i} speaks of item{i}. And more.\n".encode())
    (tmp_path / "in" / "n.txt").write_bytes(b"a note on birds")
    common = ["--archive", f"file://{tmp_path}/archive", "--refs", str(tmp_path / "refs"), "--dims", "32"]
    run = [*common, "run", "--documents", f"file://{tmp_path}/in", "--mailboxes", f"file://{tmp_path}/in"]
    assert main([*run, "--validate-only"]) == 0
    assert main(run) == 0 and '"new_items": 13' in capsys.readouterr().out
    assert main(run) == 0 and '"new_items": 0' in capsys.readouterr().out
    archive = Archive(spark, f"file://{tmp_path}/archive", str(tmp_path / "refs"))
    root = store.load_ref(archive.refs, "main")["current_root_block_id"]
    found = archive.search_chunks("a note on birds", hashed_words(32), root, k=3, width=3)
    assert found["hits"][0]["text"] == "a note on birds" and "elapsed_ms" in found
    ref = archive.table("items").where("kind = 'email-chunk'").first()["email_ref"]
    assert archive.get_email(ref).count() == 1 and archive.get_thread("x") == {"status": "unsupported"}
    assert main([*common, "quality"]) == 0
    assert main([*common, "copy", f"file://{tmp_path}/copy"]) == 0 and '"failed": 0' in capsys.readouterr().out
    assert archive.copy([root], f"file://{tmp_path}/copy").first().copied == 0


def test_overrides_and_stages():
    base = Request("main", documents="x", clusters=4)
    assert base.with_overrides(clusters=7).clusters == 7 and base.with_overrides().clusters == 4
    assert base.with_overrides((0, 6, 9)).clustering()["profile_version"] == "0.6.9"
    for change, message in (({"environment": "production"}, "local"), ({"profile_version": (0, 7, 0)}, "takes no number"), ({"replay_batch_size": 0}, "replay_batch_size"), ({"max_concurrency": 0}, "max_concurrency")):
        with pytest.raises(ValueError, match=message):
            Request("main", **({"documents": "x", "clusters": 4} | change)).check()
    assert Request("main", stages=("cluster",)).check().batch_size(8) == 8 and Request("m", replay_batch_size=3, max_concurrency=5).batch_size(8) == 3


def test_http_provider_retries_and_checks(monkeypatch):
    import json

    from siltstone.sources import providers

    calls = []

    def post(url, body, headers):
        calls.append((url, headers.get("Authorization")))
        if len(calls) == 1:
            raise OSError("refused")
        if len(calls) == 2:
            return 503, b""
        texts = json.loads(body)["input"]
        return 200, json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()

    embed = providers.http_provider("http://h/", "m", 2, "key", delay_ms=0, post=post)
    assert embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]] and calls == [("http://h/v1/embeddings", "Bearer key")] * 3
    with pytest.raises(RuntimeError, match="after 1 attempts"):
        providers.http_provider("http://h", "m", 2, delay_ms=0, post=lambda *a: (404, b""))(["a"])
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        providers.http_provider("http://h", "m", 2, max_retries=2, delay_ms=0, post=lambda *a: (503, b""))(["a"])
    with pytest.raises(ValueError, match="dimensions"):
        providers.http_provider("http://h", "m", 3, post=post)(["a"])


def test_best_of_a_tile_keeps_ties_in_order():
    import numpy as np

    from siltstone.operators import search

    rng = np.random.default_rng(1)
    for n in (2, 5, 30):
        scores = rng.integers(0, 4, (6, n)) / 4.0
        scores[0, 0] = -np.inf
        ids, names = rng.permutation(n), np.arange(6)
        got = search._best(names, ids, scores, 3)
        for q in range(6):
            want = sorted(((-s, i) for s, i in zip(scores[q], ids) if np.isfinite(s)))[:3]
            assert [(-s, i) for s, i in zip(got[got.query_id == q].score, got[got.query_id == q].neighbor_id)] == want
