"""Content-addressed tables: idempotent appends, integrity, replayable leaves, references, summaries."""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import vectors as V

from .shared import kept

#: Root that a run without clustering reports (a fixed value of the format).
PLACEHOLDER_ROOT = "0" * 64


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written the table at ``path`` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


# --- tables in buckets: partitioned by the first characters of a hash, sorted by it inside a file ------------

#: Characters of a hash that name its bucket, and ids that one look into a table may name.
PREFIX, MAX_PROBES = 2, 1_000


def bucket(key: Column | str) -> Column:
    return F.concat(F.lit("h"), F.substring(key, 1, PREFIX))


def append_bucketed(rows: DataFrame, path: str, key: str) -> None:
    """Append to a table in buckets. Each file holds a range of the key, so a look for a few ids opens a few row groups of a few files."""
    placed = rows.withColumn("bucket", bucket(F.col(key))).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
    placed.write.mode("append").partitionBy("bucket").parquet(path)


def only(table: DataFrame, key: str, ids: DataFrame | list[str]) -> DataFrame:
    """The rows of a table whose ``key`` may be among ``ids`` (one column): what a scan of a table in buckets has to read for them.

    Up to ``MAX_PROBES`` ids are named in the scan's filter, so it prunes partitions and row groups; more ids name their buckets, and
    the caller's join does the rest. A table without buckets is left whole.
    """
    if "bucket" not in table.columns:
        return table
    if not isinstance(ids, list):
        one = ids.toDF("id").where("id IS NOT NULL").distinct()
        rows = one.limit(MAX_PROBES + 1).collect()
        if len(rows) > MAX_PROBES:
            return table.where(F.col("bucket").isin([r["bucket"] for r in one.select(bucket("id").alias("bucket")).distinct().collect()]))
        ids = [r["id"] for r in rows]
    return table.where(F.col("bucket").isin(sorted({f"h{i[:PREFIX]}" for i in ids})) & F.col(key).isin(ids))


def append_new(rows: DataFrame, path: str, key: str = "block_id", bucketed: bool = False) -> DataFrame:
    """Append the rows whose key the table at ``path`` lacks; returns them, as they were written. A rerun appends nothing."""
    fresh = rows.dropDuplicates([key])
    held = table_or_none(rows.sparkSession, path)
    if held is not None:
        fresh = fresh.join(held.select(key), key, "left_anti")
    fresh = kept(fresh, "fresh")  # its own source: what is returned does not change with the table
    if bucketed:
        append_bucketed(fresh.drop("bucket"), path, key)
    else:
        fresh.write.mode("append").parquet(path)
    return fresh


def verified(rows: DataFrame, id_col: str = "block_id", bytes_col: str = "bytes") -> DataFrame:
    """Fails the job for a row whose id is not the hash of its bytes."""
    right = F.sha2(F.col(bytes_col).cast("binary"), 256) == F.col(id_col)
    return rows.withColumn(id_col, F.when(right, F.col(id_col)).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), F.col(id_col)))))


def readable_artifacts(rows: DataFrame, type_name: str, media_type: str, schema_version: int) -> DataFrame:
    """Artifacts of one type; another media type or version fails the job."""
    mine = rows.where(F.col("type_name") == type_name)
    fits = (F.col("media_type") == media_type) & (F.col("schema_version") == schema_version)
    return mine.withColumn("body", F.when(fits, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("unsupported artifact: "), F.col("block_id"))).cast("binary")))


def replayable(dims: int, encoding: str) -> Column:
    """Leaf blocks of level 0 with the wanted spec, one entry and a stored vector."""
    return (F.col("kind") == "leaf") & (F.col("level") == 0) & (F.col("dims") == dims) & (F.col("encoding") == encoding) & F.lit(dims > 0) & (F.col("n_entries") == 1) & (F.size("embedding") > 0)


def replay_items(leaves: DataFrame) -> DataFrame:
    """Index items from leaves' metadata: documents by path, email chunks by reference; other kinds are skipped."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    missing = lambda what: F.raise_error(F.concat(F.lit(f"leaf without {what}: "), F.col("block_id")))
    known = leaves.where(m("source_kind").isin("document", "email"))
    return known.select(
        "block_id",
        F.when(m("source_kind") == "document", "document").otherwise("email-chunk").alias("kind"),
        F.when(m("source_kind") == "document", F.coalesce(m("source_path"), missing("source_path"))).alias("path"),
        F.when(m("source_kind") == "email", F.coalesce(m("email_artifact_ref"), missing("email_artifact_ref"))).alias("email_ref"),
        F.when(m("source_kind") == "email", F.coalesce(m("chunk_index").try_cast("int"), missing("chunk_index").cast("int"))).alias("chunk_index"),
    )


def corpus(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that recall can use, and those of no magnitude."""
    fit = V.usable(F.col("embedding"))
    return entries.where(fit), entries.where(~fit)


def batch_summary(blocks: DataFrame, root_id: str | None = None) -> DataFrame:
    """One row: root, number of distinct blocks. The ids themselves stay a table (they grow with the data)."""
    return blocks.agg(F.lit(root_id or PLACEHOLDER_ROOT).alias("root_id"), F.countDistinct("block_id").alias("block_count"))


def sorted_block_ids(blocks: DataFrame) -> DataFrame:
    """The distinct ids of a batch in order, as a table."""
    return blocks.select("block_id").distinct().orderBy("block_id")


def latest_failure(statuses: DataFrame) -> DataFrame:
    """Per run: the failed status to report, the most specific, then the fewest items, then the latest."""
    order = F.struct("specificity", -F.col("item_count"), F.col("seq"))
    return statuses.where("failed").groupBy("run_id").agg(F.max_by("message", order).alias("message"), F.max("specificity").alias("specificity"))


# --- the one mutable thing: a small reference document per name -------------------------------------------


def valid_ref_name(name: str) -> str:
    """The name with forward slashes, or ``ValueError``."""
    clean = name.strip().replace("\\", "/")
    parts = clean.split("/")
    if not clean or clean.startswith("/") or any(p in ("", ".", "..") or re.search(r"[\s:*?\"<>|]", p) for p in parts):
        raise ValueError(f"bad reference name: {name!r}")
    return clean


def _ref_path(folder: str, name: str) -> str:
    return os.path.join(folder, f"{valid_ref_name(name)}.json")


def load_ref(folder: str, name: str) -> dict:
    path = _ref_path(folder, name)
    if not os.path.exists(path) and os.path.exists(f"{path}.bak"):
        path = f"{path}.bak"
    if not os.path.exists(path):
        return {"schema_version": 1, "current_root_block_id": None, "replay_journal_head_block_id": None, "metadata": {}}
    with open(path, encoding="utf-8") as f:
        state = json.load(f)
    if state.get("schema_version") != 1:
        raise ValueError(f"unsupported reference version in {path}")
    return state


def read_document(path: str) -> dict:
    """A small JSON document, or what a crash left of it; empty if there is none."""
    for candidate in (path, f"{path}.bak"):
        if os.path.exists(candidate):
            with open(candidate, encoding="utf-8") as f:
                return json.load(f)
    return {}


def replace_document(path: str, document: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    _replace(path, document)


class Conflict(Exception):
    """The reference was changed by another writer in the meantime."""


_ANY = object()


def update_ref(folder: str, name: str, root: str | None = None, head: str | None = None, metadata: dict | None = None, expected_head: object = _ANY) -> dict:
    """Only what is given changes; returns the new state (driver side, a few hundred bytes).

    With ``expected_head`` it is a compare-and-swap: if the head is another one, nothing changes and :class:`Conflict` is raised.
    Writers of one reference take turns by a lock on a file beside it. The state before is kept as ``<name>.json.bak`` until the
    new one is in place, and comes back if that fails; a backup without a reference is what a crash between the two steps left.
    """
    path = _ref_path(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        state = load_ref(folder, name)
        if expected_head is not _ANY and state["replay_journal_head_block_id"] != expected_head:
            raise Conflict(f"the head of {name} is {state['replay_journal_head_block_id']}, not {expected_head}")
        state["current_root_block_id"] = root or state["current_root_block_id"]
        state["replay_journal_head_block_id"] = head or state["replay_journal_head_block_id"]
        state["metadata"] = metadata if metadata is not None else state["metadata"]
        _replace(path, state)
    return state


def _replace(path: str, state: dict) -> None:
    backup = f"{path}.bak"
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.replace(path, backup)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(backup) and not os.path.exists(path):
            os.replace(backup, path)
        if os.path.exists(temporary):
            os.remove(temporary)
        raise
    if os.path.exists(backup):
        os.remove(backup)
