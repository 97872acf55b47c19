"""Report names, files, gates, telemetry records and the edges that a copy follows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph, reports, telemetry

STATUS = (
    "run_id string, seq long, pass_no int, family string, phase string, layer_index int, state string, item_count int, completed_units int, total_units int, pending_count int, "
    "pending array<struct<path:string,expected:int,observed:int>>, partition_path string, partition_size int, recursion_depth int, stall_reason string, stall_ms long, elapsed_ms long"
)
NAMES = [c.split(" ")[0] for c in STATUS.replace(",expected", ";").replace(",observed", ";").split(", ")]


def statuses(spark, *rows):
    plain = {"run_id": "r", "pass_no": 0, "family": "v3", "state": "in-progress", "item_count": 5, "completed_units": 2, "elapsed_ms": 7}
    return spark.createDataFrame([tuple((plain | {"seq": i} | row).get(n) for n in NAMES) for i, row in enumerate(rows)], STATUS)


def test_report_names_and_files(tmp_path):
    assert reports.quality_report_name("abcdef0123456") == "block-tree-quality-abcdef01.json"
    assert reports.search_report_name("abcdef0123456", "q") == f"rooted-search-abcdef01-{hashlib.sha256(b'q').hexdigest()[:8]}.json"
    assert reports.copy_report_name([]) == "rooted-copy-empty.json"
    assert reports.copy_report_name(["a" * 64, "b" * 64]) == f"rooted-copy-aaaaaaaa-{hashlib.sha256(('a' * 64 + chr(10) + 'b' * 64).encode()).hexdigest()[:8]}.json"
    path = reports.write_report(str(tmp_path / "deep" / "r.json"), {"a": 1})
    assert json.load(open(path)) == {"a": 1} and reports.format_millis(1234567) == "1234.567"
    error = reports.write_failure(str(tmp_path / "deep" / "r.json" / "x.json"), {"a": 1}, RuntimeError("first"))
    assert str(error) == "first" and "not written" in error.__notes__[0]
    assert "diagnostics:" in reports.write_failure(str(tmp_path / "f.json"), {"a": 1}, RuntimeError("x")).__notes__[0]


def test_summaries():
    text = reports.search_summary({"root_id": "r", "top_k": 1, "traversal_width": 3, "query": "q", "elapsed_ms": 4, "hits": [{"position": 0, "leaf": "l", "text": "a\nb ", "source_path": "p"}]})
    assert text.splitlines()[-2:] == ["1. p [l]", "   a b"]
    text = reports.copy_summary({"roots": ["r"], "read_before_write": True, "failed": 1, "copied": 2, "skipped": 3, "failures": [{"block_id": "b", "roots": "r"}]})
    assert "Copied blocks: 2" in text and text.endswith("FAIL block b roots r")
    assert "Attempted writes: 2" in reports.copy_summary({"roots": [], "read_before_write": False, "failed": 0, "copied": 2, "skipped": 0})
    assert "Recall@1: mean 0.500000" in reports.quality_summary({"root_id": "r", "blocks": 3, "findings": [], "layers": [{"level": 0, "n": 2, "m": 0.5}], "recall": [{"k": 1, "mean": 0.5, "stdev": 0.0}]})


def test_failure_bundle_is_bounded(spark):
    inputs = spark.range(5).select(F.col("id").alias("ix"))
    assert reports.failure_diagnostics(inputs, {}, {}, {}, limit=4) is None
    assert reports.failure_diagnostics(inputs, {"zero": 1}, {"k": 2}, {"dims": 2}, {"provenance": "exact"}, limit=5)["input_count"] == 5


def test_metadata_keeps_texts_and_the_last_of_equal_keys(spark):
    pairs = spark.createDataFrame([([("b", "1"), ("a", "2"), ("b", "3"), (None, "x"), ("c", None)],)], "p array<struct<key:string,value:string>>")
    assert [tuple(e) for e in pairs.select(F.map_entries(reports.text_metadata(F.col("p"))).alias("m")).first().m] == [("a", "2"), ("b", "3")]


def test_neighbor_ids_follow_content_not_order(spark):
    rows = spark.sql("SELECT map('b', '2', 'a', '1') AS m UNION ALL SELECT map('a', '1', 'b', '2') UNION ALL SELECT map('a', '1', 'b', '3')")
    made = [r.n for r in rows.select(reports.neighbor_id(F.lit("0a" * 32), F.lit("e").cast("binary"), F.lit("text/plain"), F.lit("body").cast("binary"), F.col("m")).alias("n")).collect()]
    want = hashlib.sha256(bytes.fromhex("0a" * 32) + b"e" + b"text/plain" + b"body" + b"a\x001\xff" + b"b\x002\xff").hexdigest()
    assert made[0] == made[1] == want != made[2]


def test_hits_are_projected(spark):
    rows = spark.createDataFrame([(0, "l", "text/plain", bytearray(b"hi"), {"source_kind": "email", "email_name": "s", "name": "n", "source_path": "x/y"}), (1, "l", "text/plain", bytearray(b"ho"), {"source_path": "x/y", "email_subject": "t"})], "position int, block_id string, media_type string, body binary, metadata map<string,string>")
    assert [(r.text, r.source_kind, r.source_name) for r in reports.search_hits(rows).orderBy("position").collect()] == [("hi", "email", "s"), ("ho", None, None)]


def test_recall_gate_without_queries(spark):
    none = spark.createDataFrame([], "query_id long, k int, matched long, possible long")
    out = reports.gated_recall(none, spark.createDataFrame([], "kind string")).collect()
    assert sorted((r.k, r.mean, r.stdev, r.histogram) for r in out) == [(1, 0.0, 0.0, []), (5, 0.0, 0.0, []), (10, 0.0, 0.0, [])]


def test_blocked_on_and_records(spark):
    part = lambda i: (f"p{i}", 4, i or None)
    rows = statuses(
        spark, {"phase": "planning-pass", "family": "v2", "pending": [part(0), part(1), part(2)], "stall_reason": "unchanged-pass-observed-count", "stall_ms": 30},
        {"phase": "planning-pass", "family": "v2", "state": "completed"}, {"phase": "hierarchy-planning", "partition_path": "0/1", "recursion_depth": 2},
        {"phase": "partition-load", "layer_index": 1, "total_units": 9}, {"phase": "bottom-up-assembly", "layer_index": 1}, {"phase": "final-materialization-replay"},
    )
    told = [r.b for r in rows.orderBy("seq").select(telemetry.blocked_on().alias("b")).collect()]
    assert told == [
        "3 pending partition(s); pending detail p0 expects 4 item(s) | p1 expects 4 item(s), observed 1; +1 more pending partition(s); suspected stall unchanged-pass-observed-count for 30 ms", "unknown",
        "active partition 0/1; recursion depth 2", "loading layer 1 block(s) 2 of 9", "assembling layer 1 group(s); completed 2", "unknown",
    ]
    records = {r.seq: json.loads(r.record) for r in telemetry.status_records(rows).collect()}
    assert sorted(records) == [0, 2, 3, 4]
    assert (records[0]["telemetry_kind"], records[0]["pending_partition_count"], len(records[0]["pending_partitions"]), records[0]["pass_number"]) == ("intra-pass", 3, 2, 1)
    assert (records[3]["telemetry_kind"], records[3]["remaining_units"], records[3]["layer_index"]) == ("live-status", 7, 1)


def test_record_files_are_replaced_once_and_then_grow(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    rows = spark.createDataFrame([('{"a":1}',)], "record string")
    for first in (True, True, False):
        telemetry.write_records(rows, path, first)
    assert spark.read.json(path).count() == 2


def test_pass_summaries_remember_what_was_concrete(spark):
    passes = spark.createDataFrame([("r", 1, 9, 10, 2, 1, False), ("r", 2, 9, 10, 4, 1, False), ("r", 3, 9, 10, 4, 1, False), ("r", 4, 9, 20, 5, 1, False), ("r", 5, 9, 20, 5, 1, True)], "run_id string, pass_no int, items int, planned int, terminal int, depth int, complete boolean")
    told = statuses(spark, {"pass_no": 2, "phase": "partition-load", "layer_index": 0, "total_units": 3}, {"pass_no": 2, "phase": "final-materialization-replay"}, {"pass_no": 3, "phase": "final-materialization-replay"})
    out = {r.pass_no: r for r in telemetry.pass_summaries(passes, told).collect()}
    assert [out[i].verdict for i in range(1, 6)] == ["inconclusive", "converging", "not-converging", "inconclusive", "converging"]
    assert out[2].evidence == "terminal partitions 2 -> 4; non-terminal gap 8 -> 6" and out[2].message.endswith("; last blocked on loading layer 0 block(s) 2 of 3")
    assert "stayed at 4" in out[3].evidence and out[3].blocked_on == "unknown" and out[1].blocked_on is None and out[5].evidence.endswith("confirmed on pass 5")


def test_failing_subset_is_exact_or_the_attempt(spark):
    failures = spark.createDataFrame([("a", "p", 4), ("b", "p", 3)], "run_id string, phase string, item_count long")
    attempts = spark.createDataFrame([("a", 4), ("b", 4)], "run_id string, input_count long")
    assert {r.run_id: r.provenance for r in telemetry.failing_subset(failures, attempts).collect()} == {"a": "exact", "b": "narrowest-provable"}


def test_failures_are_attributed_upward_and_depth_is_no_silent_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", 0, f"n{i + 1}") for i in range(9)] + [("m", 0, "n5")], "parent_id string, child_ix int, child_id string")
    roots = spark.createDataFrame([("n0",), ("m",), ("z",)], "block_id string")
    failed = spark.createDataFrame([("n9",), ("n2",), ("z",)], "block_id string")
    assert {r.block_id: r.roots for r in graph.failure_roots(failed, edges, roots).collect()} == {"n9": "m,n0", "n2": "n0", "z": "z"}
    assert graph.closure(edges, roots).count() == 12
    blocks = edges.select(F.col("parent_id").alias("block_id"))
    for call in (lambda: graph.closure(edges, roots, 4), lambda: graph.traverse(edges, blocks, roots, 4), lambda: graph.failure_roots(failed, edges, roots, 4)):
        with pytest.raises(ValueError, match="deeper"):
            call()
    assert graph.store_failure(roots, "write", "full").count() == 3


def test_metadata_of_the_user_wins_and_urls_keep_their_signature(spark):
    from siltstone.functions import formats

    rows = spark.sql("SELECT map('z', '1', 'source_path', 'mine') AS u UNION ALL SELECT CAST(NULL AS MAP<STRING, STRING>)")
    out = [[tuple(e) for e in r.m] for r in rows.select(F.map_entries(formats.joined_metadata(F.lit("document"), F.lit("a\\b"), F.col("u"))).alias("m")).collect()]
    assert out == [[("source_kind", "document"), ("source_path", "mine"), ("z", "1")], [("source_kind", "document"), ("source_path", "a/b")]]
    one = spark.range(1).select(formats.signed_url(F.lit("https://h/c/?sig=x"), F.lit("r.json")).alias("a"), formats.shown_url(F.lit("https://h/c?sig=x"), F.lit("r.json")).alias("b"), formats.quoted(F.lit("it's")).alias("c")).first()
    assert tuple(one) == ("https://h/c/r.json?sig=x", "https://h/c/r.json", "'it''s'")


def test_cbor_heads(spark):
    from siltstone.functions import formats

    sizes = {0: 1, 23: 1, 24: 2, 255: 2, 256: 3, 65535: 3, 65536: 5, 2**32 - 1: 5, 2**32: 9}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.cbor_head_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == sizes


def test_baseline_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 4, 1.0)], "name string, n long, x double")
    out = reports.against_baseline(rows, "name", "a", ["n", "x"])
    assert {(r.name, r.delta_n, r.delta_x) for r in out.collect()} == {("a", 0, 0.0), ("b", 3, -1.0)}
    reports.write_csv(out, f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").count() == 2
    assert [r.block_id for r in reports.in_report_order(spark.createDataFrame([("b",), ("a",)], "block_id string"), "blocks").collect()] == ["a", "b"]


def test_emails_are_chunked_again_from_their_artifacts(spark, tmp_path):
    from siltstone.sources import mail

    (tmp_path / "a.mbox").write_bytes(b"From x\nSubject: s\n\n" + b" ".join(b"Sentence number %d is here." % i for i in range(90)) + b"\n")
    emails = mail.normalise(mail.split_mailbox(mail.files(spark, f"file://{tmp_path}", "mbox")))
    items, artifacts = mail.chunk_items(emails), mail.email_artifacts(emails)
    want = sorted((r.chunk_index, r.text) for r in items.collect())
    assert len(want) > 1 and sorted((r.chunk_index, r.text) for r in mail.resolve_chunks(items, artifacts).collect()) == want
    with pytest.raises(Exception, match="no chunk"):
        mail.resolve_chunks(items.withColumn("chunk_index", F.lit(99)), artifacts).collect()
    with pytest.raises(Exception, match="missing artifact"):
        mail.resolve_chunks(items, artifacts.where("false")).collect()
    with pytest.raises(Exception, match="unsupported artifact"):
        mail.resolve_chunks(items, artifacts.withColumn("schema_version", F.lit(2))).collect()


def test_walk_samples_are_distinct_and_first(spark):
    from siltstone.operators import search, trees

    tree = trees.label_tree(spark.createDataFrame([(i, i % 6, [float(i % 6), float(i) + 1]) for i in range(50)], "vec_id long, label int, embedding array<float>"))
    walks = search.random_walks(tree, "R", 9, 32 * 6).collect()
    first = {}
    for w in sorted(walks, key=lambda w: w.walk):
        first.setdefault((w.block_id, w.entry_ix), w.walk)
    got = [(r.block_id, r.entry_ix) for r in search.walk_sample(tree, "R", 9, 6).collect()]
    assert got == list(first)[:6]
    sizes = tree.entries.groupBy("block_id").agg((F.count("*") * 100).alias("n_bytes"))
    access = search.walk_access(tree, "R", sizes, 9, 4, 2)
    assert access.select("query_id").distinct().count() == 4 and search.query_totals(access).count() == 4


def test_stage_dimension(spark):
    from siltstone.operators import invariants

    rows = {(r.stage, r.work_kind): (r.rank, r.may_be_pending) for r in invariants.stage_dimension(spark).collect()}
    assert rows["embedding", "chunking"] == (3, False) and rows["embedding", "embedding"] == (3, True) and rows["terminal-failure", "chunking"] == (6, True) and len(rows) == 40
