"""Replay order, append-only journals, batches.

A journal record is ``seq`` and a payload; journal blocks form a chain by
``previous_block_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, numbered

#: Size limit of one journal block's body (a fixed value of the format).
BLOCK_BYTES = 64 * 1024 * 1024
#: Texts that a provider is given at once.
PROVIDER_TEXTS = 256


def content_key(kind: Column, path: Column, artifact_ref: Column, chunk_index: Column, media_type: Column | None = None, body: Column | None = None) -> Column:
    """Sort key of an item: where its content comes from. Chunk numbers are zero-padded to 20 digits, an inline body is listed byte by byte."""
    key = F.when(kind == "email-chunk", F.concat_ws(":", F.lit("email"), artifact_ref, F.lpad(chunk_index.cast("string"), 20, "0")))
    if body is not None:
        listed = F.array_join(F.transform(F.regexp_extract_all(F.hex(body.cast("binary")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10)), ", ")
        key = key.when(kind == "inline", F.concat(F.lit("inline:"), media_type, F.lit(":["), listed, F.lit("]")))
    return key.otherwise(F.concat_ws(":", kind, path))


def replay_order(entries: DataFrame) -> DataFrame:
    """Distinct ``block_id, digest``, ascending: aggregated first, then one range-partitioned sort."""
    return entries.select("block_id", "digest").distinct().orderBy("block_id", "digest")


def replay_conflicts(entries: DataFrame) -> DataFrame:
    """Blocks that occur with more than one digest."""
    seen = entries.groupBy("block_id").agg(F.count("*").alias("occurrences"), F.min("digest").alias("least"), F.max("digest").alias("greatest"))
    return seen.where("least <> greatest")


def chain(blocks: DataFrame, heads: DataFrame, max_doublings: int = 60) -> DataFrame:
    """``head_id, block_id, steps``: each head's chain over ``previous_block_id``, newest first.

    Pointers double each round, so a chain of n blocks takes log2(n) joins. A head whose chain meets itself raises.
    """
    step = blocks.select("block_id", F.col("previous_block_id").alias("to"))
    links = step.join(blocks.select(F.col("block_id").alias("to")), "to").select("block_id", "to")
    found = kept(heads.select(F.col("block_id").alias("head_id"), "block_id", F.lit(0).cast("long").alias("steps")), "chain")
    for power in range(max_doublings):
        links = kept(links, "chain-links")
        if not links.take(1):
            return found
        ahead = found.join(links, "block_id").select("head_id", F.col("to").alias("block_id"), (F.col("steps") + F.lit(1 << power)).alias("steps"))
        found = kept(found.unionByName(ahead), "chain")
        twice = found.groupBy("head_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")
        if twice.take(1):
            raise ValueError("journal chain meets itself")
        links = links.join(links.select(F.col("block_id").alias("to"), F.col("to").alias("to2")), "to").select("block_id", F.col("to2").alias("to"))
    raise ValueError("journal chain meets itself")


def block_gaps(blocks: DataFrame) -> DataFrame:
    """Blocks whose predecessor is named but missing."""
    previous = blocks.where("previous_block_id IS NOT NULL").select("block_id", "previous_block_id")
    return previous.join(blocks.select(F.col("block_id").alias("previous_block_id")), "previous_block_id", "left_anti").select("block_id", "previous_block_id")


def fill_blocks(limit: int, overhead: int = 0):
    """For ``mapInPandas`` over records sorted by (journal, seq): greedy blocks of at most ``limit`` bytes; only the open block is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, block, used = None, 0, overhead
        for pdf in frames:
            out = []
            for name, size in zip(pdf["journal"], pdf["n_bytes"]):
                if size + overhead > limit:
                    raise ValueError(f"a record exceeds the {limit}-byte maximum payload")
                if name != owner:
                    owner, block, used = name, 0, overhead
                elif used + size > limit:
                    block, used = block + 1, overhead
                used += size
                out.append(block)
            yield pdf.assign(block_seq=pd.Series(out, dtype="int64"))

    return run


def journal_blocks(records: DataFrame, limit: int = BLOCK_BYTES, overhead: int = 0) -> DataFrame:
    """``journal, seq, n_bytes, block_seq`` from ``journal, seq, n_bytes``. A journal streams through one task in order, whatever its size."""
    kind = records.schema["journal"].dataType.simpleString()
    rows = records.select("journal", "seq", "n_bytes").repartition("journal").sortWithinPartitions("journal", "seq")
    return rows.mapInPandas(fill_blocks(limit, overhead), f"journal {kind}, seq long, n_bytes long, block_seq long")


def batches(items: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``batch_ix`` and ``done_before`` of each item inside its ``key``, in ``order``."""
    window = Window.partitionBy(key).orderBy(*order)
    numbered = items.withColumn("at", F.row_number().over(window) - 1)
    return numbered.withColumn("batch_ix", F.floor(F.col("at") / size)).withColumn("done_before", F.col("batch_ix") * size).drop("at")


def outcome_fragments(ids: DataFrame, per_fragment: int, input_blocks: int) -> DataFrame:
    """Sorted distinct generated ids in fragments of equal bound; the input count stands on the first only.

    Ids have one length, so a payload limit is a number of ids.
    """
    ranked = numbered(ids.select("block_id").distinct(), "block_id", "fragments")
    fragment = F.floor(F.col("rank") / per_fragment)
    return ranked.select(fragment.alias("fragment"), "block_id", F.when(fragment == 0, input_blocks).otherwise(0).alias("input_block_count"))


def embed_missing(items: DataFrame, known: DataFrame, provider, dims: int) -> DataFrame:
    """``input_hash, embedding`` for all items: known ones joined, the rest from ``provider(list of texts)`` once each, some at a time."""
    have = known.join(items.select("input_hash").distinct(), "input_hash")
    need = items.select("input_hash", "text").dropDuplicates(["input_hash"]).join(known.select("input_hash"), "input_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            made = [v for lo in range(0, len(texts), PROVIDER_TEXTS) for v in provider(texts[lo : lo + PROVIDER_TEXTS])]
            if any(len(v) != dims for v in made) or len(made) != len(pdf):
                raise ValueError("provider returned another number of vectors or dimensions")
            yield pd.DataFrame({"input_hash": pdf["input_hash"], "embedding": list(made)})

    return have.select("input_hash", "embedding").unionByName(need.mapInPandas(run, "input_hash string, embedding array<float>"))
