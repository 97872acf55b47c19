"""Planning in passes over real builds: partitions, ledger, status rows, resumption, cancellation and diagnosed failures."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.archive import Archive, Cancelled, hashed_words
from siltstone.operators import planning, reports, store, telemetry, trees
from siltstone.plans import catalog
from siltstone.sources.requests import Request
from tests.oracle import compare


def _vectors(spark, n, same=0):
    wave = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i + i).cast("float"))
    return spark.range(n).select(F.col("id").alias("entry_ix"), F.when(F.col("id") < same, F.array(*[F.lit(1.0).cast("float")] * 6)).otherwise(wave).alias("embedding"))


def _plan(spark, folder, vectors, size, family="v3", **options):
    return planning.plan(vectors, f"{folder}/run", size, planning.Telemetry(spark, folder, "run", family), **options)


def test_a_pass_that_ends_no_partition_is_judged_by_the_same_rule_in_sql(spark):
    """2,000 vectors: the second pass makes 144 partitions of 13 or 14."""
    compare(spark, catalog.QUERIES["planning_passes"], catalog.ORACLE["planning_passes"], "/root/testdata/sf0.1")


@pytest.mark.parametrize("method", ["kmeans", "pca"])
def test_partitions_fit_and_hold_every_row_once(spark, tmp_path, method):
    folder = f"file://{tmp_path}"
    out = _plan(spark, folder, _vectors(spark, 700, same=300), 7, method=method, seed=3)
    rows = out.clustered.collect()
    assert sorted(r.entry_ix for r in rows) == list(range(700))
    sizes = {}
    for r in rows:
        sizes[r.cluster] = sizes.get(r.cluster, 0) + 1
    assert max(sizes.values()) <= 7 and sorted(sizes) == list(range(len(sizes)))
    passes = {r.pass_no: r for r in out.passes.collect()}
    assert len(passes) > 1 and [passes[p].complete for p in sorted(passes)] == [False] * (len(passes) - 1) + [True]
    last = passes[max(passes)]
    assert last.terminal == last.planned == len(sizes) and last.completion_reason is None and "above 7 item(s)" in passes[1].completion_reason
    told = telemetry.pass_summaries(out.passes, spark.read.parquet(f"{folder}/statuses")).orderBy("pass_no").collect()
    assert told[-1].verdict == "converging" and told[0].message.startswith("Completed planning pass 1 over 700 item(s); terminal partitions") and "realized/requested clusters" in told[0].message
    record = json.loads(told[-1].record)
    assert record["planning_completion_state"] == "complete" and record["terminal_partition_count"] == len(sizes) and 0 < record["planning_balance_metric"] <= 1


def test_small_inputs_take_one_pass(spark, tmp_path):
    for n, size in ((1, 5), (5, 5)):
        out = _plan(spark, f"file://{tmp_path}/{n}", _vectors(spark, n), size)
        assert {r.cluster for r in out.clustered.collect()} == {0} and out.passes.count() == 1


def test_statuses_of_both_families(spark, tmp_path):
    for family in ("v2", "v3"):
        folder = f"file://{tmp_path}/{family}"
        _plan(spark, folder, _vectors(spark, 90), 5, family, method="pca")
        records = [json.loads(r.record) for r in telemetry.status_records(spark.read.parquet(f"{folder}/statuses")).orderBy("seq").collect()]
        if family == "v2":
            assert {r["telemetry_kind"] for r in records} == {"intra-pass"}
            assert records[0]["pending_partition_count"] == 1 and records[0]["pending_partitions"] == [{"path": "", "expected": 90}]
            assert records[1]["pending_partition_preview_count"] == 2 and records[1]["pending_partition_count"] > 2
        else:
            assert {"hierarchy-planning", "partition-load", "partition-classify"} == {r["phase"] for r in records}


def test_a_run_that_was_killed_goes_on_after_its_last_pass(spark, tmp_path, monkeypatch):
    vectors, folder = _vectors(spark, 400), f"file://{tmp_path}/a"
    whole = _plan(spark, f"file://{tmp_path}/b", vectors, 4, method="pca")
    report, calls = planning._report, []

    def dies(*args):
        calls.append(args[1])
        if args[1] == 2 and calls.count(2) == 1:
            raise KeyboardInterrupt
        return report(*args)

    monkeypatch.setattr(planning, "_report", dies)
    with pytest.raises(KeyboardInterrupt):
        _plan(spark, folder, vectors, 4, method="pca")
    assert store.finished(spark, f"{folder}/run/pass-1") and not store.finished(spark, f"{folder}/run/pass-2")
    again = _plan(spark, folder, vectors, 4, method="pca")
    assert calls[:3] == [1, 2, 2]  # the first pass is not planned again
    assert sorted((r.entry_ix, r.cluster) for r in again.clustered.collect()) == sorted((r.entry_ix, r.cluster) for r in whole.clustered.collect())
    seqs = [r.seq for r in spark.read.parquet(f"{folder}/statuses").collect()]
    assert sorted(seqs) == list(range(len(seqs)))
    done = len(calls)
    _plan(spark, folder, vectors, 4, method="pca")
    assert len(calls) == done  # a finished run plans nothing


def _archive(spark, tmp_path, n=40):
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"{i:02}.txt").write_bytes(f"note {i} on topic {i % 5}".encode())
    request = Request("main", documents=f"file://{tmp_path}/in", dims=8, method="pca", block_bytes=4 * (32 + trees.ENTRY_OVERHEAD))
    archive = Archive(spark, f"file://{tmp_path}/a", str(tmp_path / "refs"))
    archive.ingest(request, hashed_words(8))
    return archive, request


def test_a_build_plans_reports_and_searches(spark, tmp_path):
    archive, request = _archive(spark, tmp_path)
    root = archive.build(request)
    told = archive.pass_reports().orderBy("pass_no").collect()
    assert told[-1].verdict == "converging" and "over 40 item(s)" in told[-1].message
    assert archive.status_records().count() > 1
    assert archive.tree(root).entries.join(archive.table("blocks").where("level = 0"), "block_id").count() == 40
    assert archive.build(request) == root and archive.pass_reports().count() == len(told)
    assert archive.search_chunks("note 7 on topic 2", hashed_words(8), root, k=1, width=8)["hits"][0]["text"] == "note 7 on topic 2"


def test_a_cancelled_build_leaves_head_and_root(spark, tmp_path, monkeypatch):
    archive, request = _archive(spark, tmp_path)
    before = store.load_ref(archive.refs, "main")
    plan = planning.plan

    def slow(*args, **options):
        timer = threading.Timer(1.0, archive.cancel)
        timer.start()
        try:
            spark.range(4, numPartitions=4).select(F.udf(lambda x: __import__("time").sleep(30) or x)("id")).collect()
        finally:
            timer.join()
        return plan(*args, **options)

    monkeypatch.setattr(planning, "plan", slow)
    with pytest.raises(Cancelled, match="build"):
        archive.build(request)
    assert store.load_ref(archive.refs, "main") == before and not os.path.exists(tmp_path / "refs" / "failures")
    monkeypatch.setattr(planning, "plan", plan)
    assert archive.build(request) == store.load_ref(archive.refs, "main")["current_root_block_id"]
    assert archive.cancel() == 0


def test_a_failed_build_leaves_a_bundle(spark, tmp_path, monkeypatch):
    archive, request = _archive(spark, tmp_path, 6)

    def fails(*args, **options):
        raise ValueError("no plan")

    monkeypatch.setattr(planning, "plan", fails)
    with pytest.raises(ValueError, match="no plan") as caught:
        archive.build(request)
    path = str(tmp_path / "refs" / "failures" / "main.json")
    assert caught.value.__notes__ == [f"diagnostics: {path}"]
    with open(path) as f:
        bundle = json.load(f)
    assert bundle["input_count"] == 6 and bundle["clustering"]["planning_algorithm_id"] == "directional-pca" and bundle["embedding_health"]["input_count"] == 6
    monkeypatch.setattr(reports, "failure_diagnostics", fails)
    with pytest.raises(ValueError, match="no plan") as caught:
        archive.build(request)
    assert caught.value.__notes__ == ["no diagnostics: no plan"]
