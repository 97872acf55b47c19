"""Block graphs: traversal with findings, rooted closure, copy plans, failure attribution.

``edges`` is ``parent_id, child_ix, child_id``; ``blocks`` is ``block_id, level,
dims``. Walks are joins over a frontier, one per level; each level is written,
so lineage stays short whatever the depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hashing import valid_hash

from .shared import kept


_WAY = "array<struct<ix:bigint,id:string>>"


def traverse(edges: DataFrame, blocks: DataFrame, roots: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``block_id, depth, path, way``: every existing block that a depth-first walk from ``roots (block_id)`` reaches, and how it gets there.

    The walk enters a block by the least of its simple paths, compared child by child in ``child_ix`` order: had a block of that
    path been entered before by a smaller one, the rest of the path would lead on from there. So ways are corrected downward from
    the blocks whose way got smaller last, one join a round, and a tree takes one round a level. ``max_depth`` bounds the rounds.
    """
    there = blocks.select("block_id").distinct()
    links = edges.select("parent_id", F.col("child_ix").cast("long").alias("ix"), "child_id")
    changed = kept(roots.select("block_id").distinct().join(there, "block_id").select("block_id", F.array(F.struct(F.lit(0).cast("long").alias("ix"), F.col("block_id").alias("id"))).cast(_WAY).alias("way")), "ways")
    rounds = [changed]
    least = lambda rows: rows.groupBy("block_id").agg(F.min("way").alias("way"))
    for _ in range(1, max_depth):
        step = changed.select(F.col("block_id").alias("parent_id"), "way").join(links, "parent_id").where(~F.exists("way", lambda x: x["id"] == F.col("child_id")))
        found = least(step.select(F.col("child_id").alias("block_id"), F.concat("way", F.array(F.struct("ix", F.col("child_id").alias("id")))).alias("way"))).join(there, "block_id")
        known = least(reduce(DataFrame.unionByName, rounds)).withColumnRenamed("way", "known")
        changed = kept(found.join(known, "block_id", "left").where(F.col("known").isNull() | (F.col("way") < F.col("known"))).select("block_id", "way"), "ways")
        if not changed.take(1):
            found = least(reduce(DataFrame.unionByName, rounds))
            return found.select("block_id", F.size("way").alias("n"), "way").select("block_id", (F.col("n") - 1).alias("depth"), F.transform("way", lambda x: x["id"]).alias("path"), "way")
        rounds.append(changed)
    raise ValueError(f"the graph is deeper than {max_depth} levels")


def findings(edges: DataFrame, blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """``kind, parent_id, child_id``: what a depth-first walk reports on the edges out of the blocks that it reaches.

    An edge back into the walk's own path is a cycle, an edge to a block that was entered by another edge is a shared child; only
    the edge by which a block is entered is judged by level and spec.
    """
    reached = kept(traverse(edges, blocks, roots), "reached")
    out = reached.select(F.col("block_id").alias("parent_id"), "way").join(edges, "parent_id")
    child = blocks.select(F.col("block_id").alias("child_id"), F.col("level").alias("child_level"), F.col("dims").alias("child_dims"))
    parent = blocks.select(F.col("block_id").alias("parent_id"), "level", "dims")
    entered = reached.select(F.col("block_id").alias("child_id"), F.col("way").alias("child_way"))
    out = out.join(parent, "parent_id").join(child, "child_id", "left").join(entered, "child_id", "left")
    here = F.concat("way", F.array(F.struct(F.col("child_ix").cast("long").alias("ix"), F.col("child_id").alias("id"))))
    missing, cycle = F.col("child_level").isNull(), F.exists("way", lambda x: x["id"] == F.col("child_id"))
    out = out.select("parent_id", "child_id", "level", "dims", "child_level", "child_dims", missing.alias("missing"), cycle.alias("cycle"), F.coalesce(here == F.col("child_way"), F.lit(False)).alias("enters"))
    out = kept(out, "reached-edges")
    rules = {
        "missing-child": F.col("missing"),
        "cycle": F.col("cycle"),
        "shared-child": ~F.col("cycle") & ~F.col("missing") & ~F.col("enters"),
        "child-level-not-lower": F.col("enters") & (F.col("child_level") >= F.col("level")),
        "embedding-spec-mismatch": F.col("enters") & (F.col("child_dims") != F.col("dims")),
    }
    parts = [out.where(rule).select(F.lit(kind).alias("kind"), "parent_id", "child_id") for kind, rule in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``block_id``: every block (existing or not) that some root reaches, once."""
    level = kept(roots.select("block_id").distinct(), "closure")
    parts = [level]
    for _ in range(max_depth):
        step = level.join(edges.select(F.col("parent_id").alias("block_id"), "child_id"), "block_id").select(F.col("child_id").alias("block_id")).distinct()
        level = kept(step.join(reduce(DataFrame.unionByName, parts), "block_id", "left_anti"), "closure")
        if not level.take(1):
            return reduce(DataFrame.unionByName, parts)
        parts.append(level)
    raise ValueError(f"the graph is deeper than {max_depth} levels")


def reaching_roots(edges: DataFrame, roots: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``root_id, block_id``: every block (existing or not) that each root reaches. Roots times blocks; for copies and failures see ``closure`` and ``failure_roots``."""
    level = kept(roots.select(F.col("block_id").alias("root_id"), "block_id").distinct(), "closure")
    parts = [level]
    for _ in range(max_depth):
        step = level.join(edges.select(F.col("parent_id").alias("block_id"), "child_id"), "block_id").select("root_id", F.col("child_id").alias("block_id")).distinct()
        level = kept(step.join(reduce(DataFrame.unionByName, parts), ["root_id", "block_id"], "left_anti"), "closure")
        if not level.take(1):
            return reduce(DataFrame.unionByName, parts)
        parts.append(level)
    raise ValueError(f"the graph is deeper than {max_depth} levels")


def child_edges(branches: DataFrame, leaves: DataFrame, records: DataFrame, blocks: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges (parent_id, child_id, kind)`` out of every kind of block, and ``failures (block_id, message)`` of blocks that cannot be read.

    ``branches``: ``parent_id, child_id``; ``leaves``: ``block_id, metadata`` (artifact references); ``records`` and
    ``blocks``: a journal's (its predecessor, its items and their artifacts, an outcome's root); ``emails``: ``block_id,
    mailbox_artifact_ref``. A reference that is no hash, or an email without a mailbox, is a failure of its block. The edges of
    one parent meet in one task: a block's size bounds them.
    """
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    named = lambda parent, child, kind: (F.col(parent).alias("parent_id"), child.alias("child_id"), F.lit(kind).alias("kind"))
    refs = leaves.select("block_id", F.explode(F.array(m("email_artifact_ref"), m("mailbox_artifact_ref"))).alias("ref")).where("ref IS NOT NULL")
    told = [
        branches.select(*named("parent_id", F.col("child_id"), "branch")),
        refs.select(*named("block_id", F.col("ref"), "artifact")),
        blocks.where("previous_block_id IS NOT NULL").select(*named("block_id", F.col("previous_block_id"), "journal-previous")),
        records.select(*named("block_id", F.col("item_block_id"), "journal-item")),
        records.where("content_ref.email_ref IS NOT NULL").select(*named("block_id", F.col("content_ref.email_ref"), "journal-artifact")),
        emails.select(*named("block_id", F.coalesce("mailbox_artifact_ref", F.lit("")), "mailbox")),
    ]
    every = reduce(DataFrame.unionByName, told).withColumn("valid", valid_hash(F.col("child_id")))
    # Hashes travel as their 32 bytes, by parent, so a parent's edges lie together; a parent whose id is no hash travels as it is.
    plain = F.col("parent_id").rlike("^[0-9a-f]{64}$")
    kinds = ["branch", "artifact", "journal-previous", "journal-item", "journal-artifact", "mailbox"]
    packed = every.where("valid IS NOT NULL").select(
        F.when(plain, F.unhex("parent_id")).alias("parent"), F.when(~plain, F.col("parent_id")).alias("other"), F.unhex("valid").alias("child"), F.array_position(F.lit(kinds), F.col("kind")).cast("int").alias("kind"))
    once = packed.repartition("parent", "other").distinct()
    edges = once.select(F.coalesce(F.lower(F.hex("parent")), "other").alias("parent_id"), F.lower(F.hex("child")).alias("child_id"), F.element_at(F.lit(kinds), F.col("kind")).alias("kind"))
    why = F.when((F.col("kind") == "mailbox") & (F.col("child_id") == ""), "email without mailbox_artifact_ref").otherwise(F.concat(F.lit("no block hash: "), F.col("child_id")))
    return edges, every.where("valid IS NULL").select(F.col("parent_id").alias("block_id"), why.alias("message")).distinct()


def copy_plan(reached: DataFrame, source: DataFrame, destination: DataFrame, read_before_write: bool = True) -> DataFrame:
    """``block_id, status`` of distinct reached blocks: ``failed`` (not in the source), ``skipped`` or ``copied``."""
    ids = reached.select("block_id").distinct()
    marked = ids.join(source.select("block_id").distinct().withColumn("readable", F.lit(True)), "block_id", "left")
    marked = marked.join(destination.select("block_id").distinct().withColumn("present", F.lit(True)), "block_id", "left")
    skip = F.col("present").isNotNull() & F.lit(read_before_write)
    return marked.select("block_id", F.when(F.col("readable").isNull(), "failed").when(skip, "skipped").otherwise("copied").alias("status"))


def copy_blocks(plan: DataFrame, source: DataFrame, path: str) -> DataFrame:
    """Append the planned blocks' rows to the table at ``path``; returns the rows written."""
    rows = source.join(plan.where("status = 'copied'").select("block_id"), "block_id")
    rows.write.mode("append").parquet(path)
    return rows


def copy_report(plan: DataFrame) -> DataFrame:
    """One row: visited, copied, skipped, failed."""
    return plan.agg(F.count("*").alias("visited"), *(F.count_if(F.col("status") == s).alias(s) for s in ("copied", "skipped", "failed")))


def failure_roots(failed: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``block_id, roots``: each failed block with all roots that reach it, in order; walks upward from the failures only."""
    level = kept(failed.select(F.col("block_id").alias("failed_id"), "block_id").distinct(), "upward")
    parts = [level]
    up = edges.select(F.col("child_id").alias("block_id"), "parent_id")
    for _ in range(max_depth):
        step = level.join(up, "block_id").select("failed_id", F.col("parent_id").alias("block_id")).distinct()
        level = kept(step.join(reduce(DataFrame.unionByName, parts), ["failed_id", "block_id"], "left_anti"), "upward")
        if not level.take(1):
            break
        parts.append(level)
    else:
        raise ValueError(f"the graph is deeper than {max_depth} levels")
    owned = reduce(DataFrame.unionByName, parts).join(roots.select("block_id").distinct(), "block_id")
    return owned.groupBy(F.col("failed_id").alias("block_id")).agg(F.array_join(F.array_sort(F.collect_set("block_id")), ",").alias("roots"))


def store_failure(roots: DataFrame, operation: str, message: str) -> DataFrame:
    """``root_id, operation, message``: a failure of the store itself, which concerns every requested root."""
    return roots.select(F.col("block_id").alias("root_id"), F.lit(operation).alias("operation"), F.lit(message).alias("message")).distinct()
