"""Reports: identifiers and gates on the cluster, names, files and summaries on the driver (one small document each)."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inputs up to which a failure report lists them (a fixed value of the format).
FAILURE_INPUTS = 1024
RECALL_AT = (1, 5, 10)
#: Metadata keys that name a source, the first one there counts (fixed values of the format).
SOURCE_NAMES = ("source_name", "document_name", "email_name", "thread_name", "name")


def text_metadata(pairs: Column) -> Column:
    """Map of the pairs (``array<struct<key, value>>``) that have both texts; the last of equal keys wins, keys ascend."""
    both = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(both, lambda p, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.array_sort(last))


def neighbor_id(leaf_id: Column, embedding: Column, media_type: Column, body: Column, metadata: Column) -> Column:
    """SHA-256 over the leaf's id and an entry's bytes; ``embedding`` and ``body`` are binary, metadata pairs go in key order."""
    pair = lambda e: F.concat(e["key"].cast("binary"), F.unhex(F.lit("00")), e["value"].cast("binary"), F.unhex(F.lit("FF")))
    pairs = F.aggregate(F.array_sort(F.map_entries(metadata)), F.lit("").cast("binary"), lambda acc, e: F.concat(acc, pair(e)))
    return F.sha2(F.concat(F.unhex(leaf_id), embedding, media_type.cast("binary"), body, pairs), 256)


def search_hits(entries: DataFrame) -> DataFrame:
    """Ranked leaf entries as hits: the body as text, whatever its bytes, and what the metadata says about the source."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    text = F.decode("body", "UTF-8") if dict(entries.dtypes)["body"] == "binary" else F.col("body")
    return entries.select("position", F.col("block_id").alias("leaf_block_id"), "media_type", text.alias("text"), "metadata", m("source_kind").alias("source_kind"), m("source_path").alias("source_path"), F.coalesce(*map(m, SOURCE_NAMES)).alias("source_name"))


def logical_spec(dims: Column, encoding: Column, logical_dims: Column, logical_encoding: Column) -> Column:
    """The spec that blocks are compared by: what their descriptor says the vectors mean, else how they are stored."""
    return F.when(logical_dims.isNotNull() & logical_encoding.isNotNull(), F.struct(logical_dims.alias("dims"), logical_encoding.alias("encoding"))).otherwise(F.struct(dims.alias("dims"), encoding.alias("encoding")))


def spec_mismatches(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``parent_id, child_id`` whose logical specs differ; ``blocks`` is ``block_id, spec``."""
    parent, child = (blocks.select(F.col("block_id").alias(f"{x}_id"), F.col("spec").alias(f"{x}_spec")) for x in ("parent", "child"))
    return edges.join(parent, "parent_id").join(child, "child_id").where("parent_spec <> child_spec").select("parent_id", "child_id")


def gated_recall(recalls: DataFrame, findings: DataFrame, ks: tuple[int, ...] = RECALL_AT) -> DataFrame:
    """``k, mean, stdev, histogram``: recall per k; all zero, with empty histograms, if a finding says that specs do not match.

    ``recalls`` is ``query_id, k, matched, possible``; the histogram counts queries by matched neighbours. The gate is one row.
    """
    spark = recalls.sparkSession
    share = F.when(F.col("possible") > 0, F.col("matched") / F.col("possible")).otherwise(0.0)
    bins = recalls.groupBy("k", "matched").agg(F.count("*").alias("samples")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("matched", "samples"))).alias("bins"))
    stats = recalls.groupBy("k").agg(F.avg(share).alias("m"), F.stddev_pop(share).alias("s")).join(bins, "k")
    gate = findings.where("kind = 'embedding-spec-mismatch'").agg((F.count("*") > 0).alias("shut"))
    levels = spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    rows = levels.join(stats, "k", "left").crossJoin(F.broadcast(gate))
    opened = lambda column, empty: F.when(F.col("shut") | F.col(column).isNull(), empty).otherwise(F.col(column))
    return rows.select("k", opened("m", F.lit(0.0)).alias("mean"), opened("s", F.lit(0.0)).alias("stdev"), opened("bins", F.array().cast("array<struct<matched:bigint,samples:bigint>>")).alias("histogram"))


#: Order of the rows of each report.
ORDERS = {"blocks": ["block_id"], "findings": ["severity", "block_id", "message"], "splits": ["parent_id"], "layers": ["level"], "hits": ["position"]}


def in_report_order(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as a report lists them, by those of its order's columns that they have."""
    return rows.orderBy(*(c for c in ORDERS[kind] if c in rows.columns))


def against_baseline(rows: DataFrame, key: str, baseline, values: list[str]) -> DataFrame:
    """``rows`` with ``delta_<value>`` against the row whose ``key`` is ``baseline`` (one row, broadcast)."""
    base = rows.where(F.col(key) == F.lit(baseline)).limit(1).select(*(F.col(v).alias(f"base_{v}") for v in values))
    out = rows.crossJoin(F.broadcast(base))
    return out.select(*rows.columns, *((F.col(v) - F.col(f"base_{v}")).alias(f"delta_{v}") for v in values))


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header line in every part file; what was there is replaced."""
    rows.write.mode("overwrite").option("header", True).csv(path)


# --- names, files, summaries: one document on the driver --------------------------------------------------


def _short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def quality_report_name(root_id: str) -> str:
    return f"block-tree-quality-{root_id[:8]}.json"


def search_report_name(root_id: str, query: str) -> str:
    return f"rooted-search-{root_id[:8]}-{_short_hash(query)}.json"


def copy_report_name(root_ids: list[str]) -> str:
    chosen = "\n".join(root_ids)
    return f"rooted-copy-{root_ids[0][:8]}-{_short_hash(chosen)}.json" if root_ids else "rooted-copy-empty.json"


def write_report(path: str, report: dict) -> str:
    """Pretty JSON at ``path``, whose folder is made if need be."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)
    return path


def write_failure(path: str, diagnostics: dict | None, error: Exception) -> Exception:
    """Write the diagnostics beside a failure and return the failure; a write that fails is noted on it, never in its place."""
    if diagnostics is not None:
        try:
            write_report(path, diagnostics)
        except OSError as problem:
            error.add_note(f"diagnostics were not written: {problem}")
        else:
            error.add_note(f"diagnostics: {path}")
    return error


def failure_diagnostics(inputs: DataFrame, health: dict, clustering: dict, spec: dict, subset: dict | None = None, limit: int = FAILURE_INPUTS) -> dict | None:
    """The bundle of a failed clustering; none if there are more than ``limit`` inputs (what comes to the driver is bounded)."""
    rows = [r.asDict(recursive=True) for r in inputs.limit(limit + 1).collect()]
    if len(rows) > limit:
        return None
    return {"embedding_spec": spec, "clustering": clustering, "embedding_health": health, "failing_subset": subset, "input_count": len(rows), "inputs": rows}


def format_millis(micros: int) -> str:
    return f"{micros / 1000:.3f}"


def search_summary(report: dict) -> str:
    timing = report.get("timing", {}) | {"total_ms": report["elapsed_ms"]}
    parts = ", ".join(f"{name}={timing[f'{name}_ms']}ms" for name in ("root_load", "embedding", "target_preparation", "traversal", "total") if f"{name}_ms" in timing)
    lines = [f"Rooted search results for {report['root_id']} (top_k {report['top_k']}, traversal_width {report['traversal_width']})", f"Query: {report['query']}", f"Timing: {parts}"]
    for hit in report["hits"]:
        name = hit.get("source_name") or hit.get("source_path") or hit["leaf"]
        lines += [f"{hit['position'] + 1}. {name} [{hit['leaf']}]", "   " + hit["text"].replace("\n", " ").strip()]
    return "\n".join(lines)


def copy_summary(report: dict) -> str:
    lines = [f"Rooted block copy results for {len(report['roots'])} requested root(s)", f"Destination mode: {'read-before-write' if report['read_before_write'] else 'blind-write'}", f"Failed blocks: {report['failed']}"]
    if report["read_before_write"]:
        lines += [f"Copied blocks: {report['copied']}", f"Skipped already present: {report['skipped']}"]
    else:
        lines.append(f"Attempted writes: {report['copied']}")
    if report["roots"]:
        lines.append("Roots: " + ", ".join(report["roots"]))
    return "\n".join(lines + [f"FAIL block {f['block_id']} roots {f['roots']}" for f in report.get("failures", [])])


def quality_summary(report: dict) -> str:
    lines = [f"Block-tree quality report for {report['root_id']}", f"Blocks: {report['blocks']} total, structural finding(s) {len(report['findings'])}", "Layer statistics:"]
    lines += [f"- level {layer['level']}: " + ", ".join(f"{k} {v:.6f}" if isinstance(v, float) else f"{k} {v}" for k, v in layer.items() if k != "level") for layer in report["layers"]]
    lines += [f"- TNN Recall@{r['k']}: mean {r['mean']:.6f} stdev {r['stdev']:.6f}" for r in report["recall"]]
    return "\n".join(lines + [f"- {f['kind']}: {f['parent_id']} -> {f['child_id']}" for f in report["findings"]])
