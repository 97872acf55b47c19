"""Sort keys and digests of items against bytes written out by hand; inline items from request to replay."""

import hashlib

from pyspark.sql import functions as F

from siltstone.archive import Archive, hashed_words
from siltstone.operators import journal, replay
from siltstone.sources.requests import Request


def _bytes(text):
    return text.encode().replace(b"\0", b"\0\1") + b"\0\0"


def test_digests_are_of_comparable_bytes(spark):
    cases = [("document:a/b", {"b": "2", "a": "1"}), ("email:r:00000000000000000007", {}), ("k\0x", {"a\0": "\0\0", "": "é"}), ("inline:text/plain:[]", {"z": ""})]
    rows = spark.createDataFrame(cases, "k string, m map<string,string>").withColumn("d", replay.sort_digest(F.col("k"), F.col("m"))).collect()
    want = {k: hashlib.sha256(_bytes(k) + b"".join(_bytes(x) + _bytes(m[x]) for x in sorted(m, key=str.encode))).hexdigest() for k, m in cases}
    assert {r.k: r.d for r in rows} == want
    assert len({replay_d for replay_d in want.values()}) == 4


def test_keys_of_every_kind(spark):
    rows = spark.createDataFrame([("document", "a/b.txt", None, None, None), ("email-chunk", None, "ref", 12, None), ("inline", None, None, None, bytearray(b"\x00A\xff")), ("inline", None, None, None, bytearray())], "kind string, path string, email_ref string, chunk_index int, body binary")
    keys = [r.k for r in rows.select(journal.content_key(F.col("kind"), F.col("path"), F.col("email_ref"), F.col("chunk_index"), F.lit("text/plain"), F.col("body")).alias("k")).collect()]
    assert keys == ["document:a/b.txt", "email:ref:00000000000000000012", "inline:text/plain:[0, 65, 255]", "inline:text/plain:[]"]


def test_order_is_by_pairs_of_metadata(spark):
    rows = spark.sql("SELECT 'k' AS content_key, map('a', 'x\"') AS metadata, 1 AS n UNION ALL SELECT 'k', map('a', 'x'), 2 UNION ALL SELECT 'k', map('a', 'x', 'b', ''), 3 UNION ALL SELECT 'j', map('z', 'z'), 4")
    assert [r.n for r in replay.in_replay_order(rows).collect()] == [4, 2, 3, 1]


def test_inline_items_are_admitted_replayed_and_found(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"a file")
    archive = Archive(spark, f"file://{tmp_path}/a", str(tmp_path / "refs"))
    request = Request("main", documents=f"file://{tmp_path}/in", dims=8, method="pca")
    given = spark.createDataFrame([("inline words", {"name": "given"}), ("inline words", {"name": "other"}), (None, {"name": "none"})], "body string, metadata map<string,string>")
    assert archive.ingest(request, hashed_words(8), given) == 4 and archive.ingest(request, hashed_words(8), given) == 0
    assert archive.replayed("main").count() == 4
    root = archive.build(request)
    hits = archive.search_chunks("inline words", hashed_words(8), root, k=2)["hits"]
    assert sorted(h["source_name"] for h in hits) == ["given", "other"] and {h["text"] for h in hits} == {"inline words"}
