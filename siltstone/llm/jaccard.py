"""Near copies of texts: sets of lower-cased five-word shingles with a Jaccard similarity of 0.8 or more.

SimHash comes first: 64-bit fingerprints of the same shingles go through the
trie self-join of :mod:`.simhash` with its Hamming budget, and each link of its
forest is decided by the exact similarity of the two shingle sets. At 0.8 two
fingerprints differ in some ten bits, give or take three, so a budget that the
join can afford misses pairs. The exact way for the rest are bands of minima:
``BANDS`` bands of ``ROWS`` minima of the shingle hashes. A pair at 0.8 shares
none of the bands with probability (1 - 0.8 ** 4) ** 32 = 4e-8, a pair above it
less often. Pairs of a band that SimHash has already put into one component are
not compared again; every other candidate pair is decided exactly.

Each band links its members to the smallest one first. Only members of a band
that are then still in different components are compared with each other, so a
group of near copies gives pairs in proportion to its size. What such members
can share at most is known before any pair is made: a shingle that a single one
of them has is in no intersection, the others are dealt into ``GROUPS`` groups,
and of a group with s and s' shingles in two texts at most min(s, s') are
common. Pairs whose similarity cannot reach the limit by these counts are never
joined, and the rest are decided exactly.

Edge cases: null or empty text and text without words have an empty set and
equal each other; fewer than five words make one shingle; equal texts are
compared once; a null ``doc_id`` counts as the smallest id and is returned as
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, blocks, id_key, mix, staged, texts_of
from .simhash import _shingles, _vote, components, near_links

SHINGLE = 5
#: In hundredths, so that the comparison is one of whole numbers.
MIN_PERCENT = 80
BANDS = 32
ROWS = 4
#: Groups in which shingles are counted to bound an intersection.
GROUPS = 32
_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(_shingles(text, SHINGLE), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``MIN_PERCENT`` or more."""
    if 100 * min(len(a), len(b)) < MIN_PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= MIN_PERCENT * (len(a) + len(b) - both)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash per band over the minima of its rows; an empty set has the bands of the single hash zero."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in np.array_split(shingles if len(shingles) else np.zeros(1, np.uint64), len(shingles) // 4096 + 1):
        least = np.minimum(least, ((part[None, :] ^ _OFFSETS[:, None]) * _MULTIPLIERS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, prints = np.zeros((batch.num_rows, BANDS), dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
        for block in blocks(batch.column(3)):
            for i in range(block.n):
                hashes = _shingles(block.text(i), SHINGLE)
                keys[block.rows.start + i] = bands(np.unique(np.array(hashes, dtype=np.uint64)))
                if hashes:
                    prints[block.rows.start + i] = _vote(hashes)[0]
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
        listed = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), listed, pa.array(prints.view(np.int64))], ["doc_id", "key", "unit", "bands", "fp"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, node, text, text): the pairs of nodes whose texts are alike."""
    known = lru_cache(maxsize=64)(shingle_set)
    for batch in batches:
        near = [alike(known((a or "").encode()), known((b or "").encode())) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in range(2)], ["a", "b"])


def _unit() -> Column:
    """128 bits that stand for the text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct shingle of each text."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            sets = [shingle_set(block.text(i)) for i in range(block.n)]
            owner = np.repeat(np.arange(block.n) + block.rows.start, [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.concatenate(sets).view(np.int64))], ["unit", "shingle"])


def _strengths(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, size, shared, counts``: how many shingles each of the texts has, how many of them another one has too, and the latter by group."""
    rows = texts_of(docs).select(id_key().alias("key"), _unit().alias("unit"), "text")
    texts = rows.join(units.select("unit", F.col("node").alias("key")), ["unit", "key"], "left_semi").dropDuplicates(["unit"]).select("unit", "text")
    shingles = staged(texts.mapInArrow(_shingled, "unit binary, shingle long"), "near-shingles")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("unit").alias("unit")).where("n = 1").select("unit", "shingle", F.lit(-1).alias("v"))
    signed = shingles.select("unit", "shingle", F.lit(1).alias("v")).unionByName(alone).withColumn("g", F.pmod("shingle", F.lit(GROUPS)))
    counts = [F.coalesce(F.sum(F.when(F.col("g") == k, F.col("v"))), F.lit(0)).cast("int") for k in range(GROUPS)]
    return signed.groupBy("unit").agg(F.count_if(F.col("v") > 0).alias("size"), F.sum("v").alias("shared"), F.array(*counts).alias("counts"))


def _alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b`` (nodes) of the ``pairs`` (``unit_a, node_a, unit_b, node_b``) that are alike; texts are read for candidates only."""
    ends = pairs.select(F.col("unit_a").alias("unit"), F.col("node_a").alias("key")).unionByName(pairs.select(F.col("unit_b").alias("unit"), F.col("node_b").alias("key"))).distinct()
    rows = texts_of(docs).select(id_key().alias("key"), _unit().alias("unit"), "text")
    texts = staged(rows.join(ends, ["unit", "key"], "left_semi").dropDuplicates(["unit"]).select("unit", "text"), "near-texts")
    a, b = (texts.select(F.col("unit").alias(f"unit_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(b, "unit_b").join(a, "unit_a").select("node_a", "node_b", "text_a", "text_b")
    return staged(both.mapInArrow(_compared, "a long, b long").distinct(), "near-links")


def _simhash_links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``a, b`` (nodes): texts of one fingerprint, and links of the trie self-join over distinct fingerprints, that are alike."""
    least = staged(own.groupBy("fp").agg(F.min(F.struct("node", "unit")).alias("least")).select("fp", "least.*"), "near-prints")
    ends = [least.select(F.col("node").alias(side), F.col("unit").alias(f"unit_{side}")) for side in "ab"]
    # A node may stand for several texts (rows of one id): the links of its fingerprints name candidates, nothing more.
    found = near_links(least.select("fp", "node")).join(ends[0], "a").join(ends[1], "b").select("unit_a", F.col("a").alias("node_a"), "unit_b", F.col("b").alias("node_b"))
    same = own.join(least.select("fp", F.col("unit").alias("unit_a"), F.col("node").alias("node_a")), "fp").select("unit_a", "node_a", F.col("unit").alias("unit_b"), F.col("node").alias("node_b"))
    return _alike(docs, staged(found.unionByName(same).where("node_a <> node_b").distinct(), "near-simhash"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, component_id`` (the smallest ``doc_id`` reachable over near copies)."""
    rows = texts_of(docs).select("doc_id", id_key().alias("key"), _unit().alias("unit"), "text")
    signed = staged(rows.mapInArrow(_banded, "doc_id long, key long, unit binary, bands array<long>, fp long"), "near-rows")
    first = staged(signed.groupBy("unit").agg(F.min("key").alias("node")), "near-units")
    own = staged(signed.join(first, (signed["unit"] == first["unit"]) & (signed["key"] == first["node"]), "left_semi").dropDuplicates(["unit"]).select("unit", F.col("key").alias("node"), "bands", "fp"), "near-own")
    alike_by_print = _simhash_links(docs, own)
    met = staged(components(alike_by_print), "near-met")
    keyed = own.select("unit", "node", F.explode("bands").alias("band"))
    # Most bands hold one text: they are counted by themselves, and only members of the others travel.
    several = staged(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "near-bands")
    member = staged(keyed.join(several, "band"), "near-members")
    least = staged(member.groupBy("band").agg(F.min(F.struct("node", "unit")).alias("least")), "near-least")
    stars = member.join(least, "band").select(F.col("least.unit").alias("unit_a"), F.col("least.node").alias("node_a"), F.col("unit").alias("unit_b"), F.col("node").alias("node_b"))
    stars = staged(stars.where("node_a <> node_b").distinct(), "near-pairs")
    by_print = [met.select(F.col("node").alias(f"node_{side}"), F.col("component").alias(f"met_{side}")) for side in "ab"]
    rest = stars.join(by_print[0], "node_a", "left").join(by_print[1], "node_b", "left").where("met_a IS NULL OR met_b IS NULL OR met_a <> met_b")
    links = staged(alike_by_print.unionByName(_alike(docs, staged(rest.select(stars.columns), "near-rest"))), "near-linked")

    found = components(links)
    placed = member.join(found, "node", "left").select("band", "unit", "node", F.coalesce("component", "node").alias("component"))
    open_bands = staged(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "near-bands")
    rest = staged(placed.join(open_bands, "band"), "near-open")
    strong = _strengths(docs, rest.select("unit", "node").distinct()).where(100 * F.col("shared") >= MIN_PERCENT * F.col("size"))
    rest = staged(rest.join(staged(strong, "near-strengths"), "unit"), "near-open")
    x, y = (rest.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("unit", "node", "component", "size", "shared", "counts"))) for s in "ab")
    reaches = lambda most: 100 * most >= MIN_PERCENT * (F.col("size_a") + F.col("size_b") - most)
    by_group = F.aggregate(F.zip_with("counts_a", "counts_b", lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n)
    hopeful = (F.col("component_a") < F.col("component_b")) & reaches(F.least("shared_a", "shared_b")) & reaches(by_group)
    pairs = x.join(y, (x["band"] == y["band"]) & hopeful).select("unit_a", "node_a", "unit_b", "node_b").distinct()
    tried = stars.unionByName(stars.select(F.col("unit_b").alias("unit_a"), F.col("node_b").alias("node_a"), F.col("unit_a").alias("unit_b"), F.col("node_a").alias("node_b")))
    pairs = staged(pairs.join(tried, ["unit_a", "unit_b"], "left_anti").select("unit_a", "node_a", "unit_b", "node_b"), "near-pairs")
    more = _alike(docs, pairs)

    settled = components(links.unionByName(more))
    label = first.join(settled, "node", "left").select("unit", F.coalesce("component", "node").alias("component"))
    shown = F.when(F.col("component") == NULL_ID, F.lit(None)).otherwise(F.col("component"))
    return signed.select("doc_id", "unit").join(label, "unit").select("doc_id", shown.alias("component_id"))
