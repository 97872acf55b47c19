"""Line dedup with DataFrame functions only.

1. Each line's key is hashed to 128 bits; the index (hash, document, position)
   is written once, without text.
2. The index is range-partitioned by hash, document and position and sorted in
   that order. The document is part of the range, so a line that a third of all
   documents share is spread over many tasks. First occurrences stream out of
   the sorted partitions (an aggregation that follows the sort order and holds
   one hash at a time); one row per hash and partition meets the others.
3. The index joins the repeated hashes. What is dropped becomes one compressed
   keep bitmap per document (its runs of dropped lines; the rest is kept), and
   only this small row meets the text again.

Edge cases: null or empty text is one empty line; a null ``doc_id`` counts as
the smallest id; rows that share a ``doc_id`` are one document, so they never
drop each other's lines, and equal rows get equal results; lines whose key is
shorter than ``min_chars`` always stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, id_key, staged, texts_of

MIN_CHARS = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case (other letters stay as they are)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _prepared(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return texts_of(docs, carry).select("doc_id", id_key().alias("doc_key"), F.xxhash64(text, F.lit(7)).alias("text_key"), text.alias("text"), *(["carried"] if carry else []))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_key, text_key, bitmap, n_dropped`` of documents that lose lines; ``bitmap``: the dropped runs as ``array<struct<start, length>>``."""
    return _bitmaps(_prepared(docs), min_chars)


def _first_occurrences(index: DataFrame) -> DataFrame:
    """``h1, h2, first_doc``: the first document of each hash that a later one holds too."""
    ordered = index.repartitionByRange("h1", "h2", "doc_key", "pos").sortWithinPartitions("h1", "h2", "doc_key", "pos")
    # The least struct is aggregated in sort order, without a hash table of all lines.
    first = ordered.groupBy("h1", "h2").agg(F.min(F.struct("doc_key", "pos")).alias("first"), F.max("doc_key").alias("last_doc"))
    return first.where("first.doc_key < last_doc").select("h1", "h2", F.col("first.doc_key").alias("first_doc"))


def _bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_key", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_key", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    index = staged(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), F.col("key")).alias("h2"), "doc_key", "pos", "text_key"), "line-index")
    # Written, so that both sides of the join are plain exchanges and a line of many documents is split over tasks.
    repeated = staged(_first_occurrences(index), "line-repeats")
    lost = index.join(repeated, ["h1", "h2"]).where("doc_key > first_doc")
    gone = lost.groupBy("doc_key", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return gone.select("doc_key", "text_key", _runs(F.col("gone")).alias("bitmap"), F.size("gone").alias("n_dropped"))


def _runs(gone: Column) -> Column:
    """Sorted positions as runs: ``array<struct<start, length>>``."""
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) < p - 1))
    lasts = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) > p + 1))
    return F.zip_with(starts, lasts, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def _kept_runs(bitmap: Column, n_lines: Column) -> Column:
    """The runs between the dropped ones."""
    starts = F.concat(F.array(F.lit(0)), F.transform(bitmap, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(bitmap, lambda r: r["start"]), F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, keep_runs, kept_text`` (and ``carried``)."""
    whole = _prepared(docs, carry)
    bitmaps = _bitmaps(whole, min_chars).hint("shuffle_hash")
    joined = whole.join(bitmaps, ["doc_key", "text_key"], "left")
    lines = F.split("text", "\n", -1)
    some = joined.withColumn("n_lines", F.size(lines)).withColumn("keep_runs", _kept_runs(F.coalesce("bitmap", F.array().cast("array<struct<start:int,length:int>>")), F.col("n_lines")))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return some.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep_runs",
        F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        *(["carried"] if carry else []),
    )
