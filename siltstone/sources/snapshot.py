"""Snapshots of a source folder: payloads and a manifest as tables, acquired once and reused by the journal that names it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import slash_path
from siltstone.operators import invariants, store, workflow
from siltstone.operators.shared import kept

from . import mail

#: Fixed values of the manifest format.
TYPE_NAME, MEDIA_TYPE, VERSION = "source-snapshot", "application/json", 1
_OPEN_STAGES = ("source-acquisition", "mailbox-admission")


def work_items(entries: DataFrame) -> DataFrame:
    """``work_id`` of each manifest entry: one mailbox to admit."""
    return entries.select(F.concat(F.lit("mailbox:"), slash_path(F.col("relative_path"))).alias("work_id")).distinct()


def write_manifest(spark: SparkSession, entries: DataFrame, folder: str, source_uri: str, acquired_at: str) -> tuple[str, str]:
    """Append the entries and one manifest row; returns the manifest's id and the snapshot's."""
    snapshot, count = mail.snapshot_id(entries, source_uri).first()
    block_id = hashlib.sha256(f"{VERSION}|{source_uri}|{snapshot}|{acquired_at}".encode()).hexdigest()
    own = entries.select(F.lit(block_id).alias("manifest_id"), "relative_path", "block_id", "byte_length")
    held = store.table_or_none(spark, f"{folder}/manifests")
    if held is None or not held.where(F.col("block_id") == block_id).take(1):
        own.write.mode("append").parquet(f"{folder}/manifest_entries")
        row = (block_id, TYPE_NAME, MEDIA_TYPE, VERSION, source_uri, snapshot, acquired_at, count)
        spark.createDataFrame([row], "block_id string, type_name string, media_type string, schema_version int, source_uri string, source_snapshot_id string, acquired_at string, n_entries long").write.mode("append").parquet(f"{folder}/manifests")
    return block_id, snapshot


def load_manifest(spark: SparkSession, folder: str, manifest_id: str) -> tuple[dict, DataFrame]:
    """A manifest's row and its entries; a missing one, or another type, media type or version, raises."""
    held = store.table_or_none(spark, f"{folder}/manifests")
    row = held.where(F.col("block_id") == manifest_id).first() if held is not None else None
    if row is None:
        raise ValueError(f"no manifest {manifest_id}")
    for field, want in (("type_name", TYPE_NAME), ("media_type", MEDIA_TYPE), ("schema_version", VERSION)):
        if row[field] != want:
            raise ValueError(f"manifest {manifest_id} has {field} {row[field]!r}, not {want!r}")
    return row.asDict(), spark.read.parquet(f"{folder}/manifest_entries").where(F.col("manifest_id") == manifest_id).drop("manifest_id")


def acquire(spark: SparkSession, journal: DataFrame, path: str, source_uri: str, folder: str, acquired_at: str) -> dict:
    """Take a snapshot of the files below ``path`` for a journal, or reuse the one that the journal has completed.

    Returns the new ``journal``, ``manifest_id``, ``source_snapshot_id``, ``reused`` and ``work``: the mailboxes to admit, a
    table (``work_id``), as there may be many. A journal of another source raises, and so does a completed one without its manifest.
    """
    source_uri, acquired_at = source_uri.strip(), acquired_at.strip()
    if not source_uri or not acquired_at:
        raise ValueError("source_uri and acquired_at must not be empty")
    (state,) = journal.select("current_stage", "source_snapshot", "work").collect()
    if state["source_snapshot"]["source_uri"].strip() != source_uri:
        raise ValueError(f"the journal is about {state['source_snapshot']['source_uri']!r}, not {source_uri!r}")
    done = spark.createDataFrame([(w,) for w in (state["work"]["mailbox_admission"]["completed"] or [])], "work_id string")
    none = done.limit(0)
    if state["source_snapshot"]["acquisition_completed_at"] is not None:
        manifest_id = state["source_snapshot"]["corpus_manifest_identity"]
        if manifest_id is None:
            raise ValueError("the journal's acquisition is complete but names no manifest")
        row, entries = load_manifest(spark, folder, manifest_id)
        if row["source_uri"] != source_uri:
            raise ValueError(f"manifest {manifest_id} is about {row['source_uri']!r}")
        changed = invariants._with(journal, "source_snapshot", source_snapshot_id=row["source_snapshot_id"])
        open_ = state["current_stage"] in _OPEN_STAGES
        if state["current_stage"] == "source-acquisition":
            changed = changed.withColumn("current_stage", F.lit("mailbox-admission"))
        work = workflow.queue_work(none, done, work_items(entries)) if open_ else none
        return {"journal": kept(changed, "journals"), "manifest_id": manifest_id, "source_snapshot_id": row["source_snapshot_id"], "reused": True, "work": work}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    store.append_new(files.select(F.sha2("content", 256).alias("block_id"), "content"), f"{folder}/payloads")
    entries = kept(mail.manifest(spark, path), "manifest-entries")
    manifest_id, snapshot = write_manifest(spark, entries, folder, source_uri, acquired_at)
    facts = {"storage_seam": "block-store", "manifest_block_id": manifest_id, "entry_count": str(entries.count())}
    provenance = F.create_map(*(F.lit(x) for pair in facts.items() for x in pair))
    changed = invariants._with(
        journal, "source_snapshot", source_snapshot_id=snapshot, acquisition_started_at=acquired_at, acquisition_completed_at=acquired_at, corpus_manifest_identity=manifest_id, additional_provenance=provenance,
    ).withColumn("current_stage", F.lit("mailbox-admission"))
    return {"journal": kept(changed, "journals"), "manifest_id": manifest_id, "source_snapshot_id": snapshot, "reused": False, "work": workflow.queue_work(none, done, work_items(entries))}
