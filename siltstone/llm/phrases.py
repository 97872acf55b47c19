"""Phrase collocations by SETM: set-oriented mining over sorted occurrence relations.

Texts are split into pieces and words. The relation R of length k holds, in
order of (piece, position), each place where a frequent phrase of k words
begins, with the phrase's number. It is written as rows of some thousand
documents of one language: slots (positions with a gap after each piece, so
equal slots mean equal piece and position), kept as ``gaps`` from one to the
next, and ``ids``. A row is never cut, so:

1. Merge-join: R meets itself at the next position. Both sides are sorted by
   slot, so the join is one pass, and phrases of k + 1 words appear as pairs of
   overlapping phrases of k words. No occurrence is shuffled.
2. Group-count: each task counts its pairs and sends them packed, by parts of
   all pairs; a part's counts are added up in one stream. Only counts travel.
3. Semi-join: the pairs that reach the minimum get numbers, and only their
   occurrences go on into the next relation. If the frequent groups fit in
   ``MAX_SHARED``, each worker gets them all; beyond that every row is joined
   with just the groups that occur in it.

Scores are ratios of whole numbers, computed with 38 digits.

Edge cases: null and empty texts have no words; a null ``lang`` is ``und``;
repeated rows count each time; ties in the score go to the smallest first part,
ties in rank to the higher count, then to the phrase in byte order; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import blocks, mix, staged

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2_000
#: Frequent groups that every worker may hold (16 bytes each and the words of single ones).
MAX_SHARED = 2_000_000
_BLOCK = 250_000
#: Row groups of the relations are small, as a reader decodes a whole one at a time; pairs that a task counts before it sends them.
_WRITTEN = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}
_HELD = 1_500_000
#: Occurrences of a relation whose pairs are counted together after the shuffle.
_SLICE = 1_000_000
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _ENDS.copy()
_GAPS[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case, and their slots: one more than the slot before, two more across the end of a piece or text."""
    gap = _GAPS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[True, gap]
    starts = np.flatnonzero(~gap & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(~gap & (np.r_[gap[1:], True] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    cut = np.r_[0, np.cumsum(_ENDS[data])] + np.cumsum(edge)  # grows wherever a piece or a text ends
    lengths = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(_LOWER[data[~gap]]))
    split = np.r_[False, cut[starts[1:]] != cut[starts[:-1]]] if len(starts) else np.zeros(0, bool)
    return words, (np.arange(len(starts)) + np.cumsum(split)).astype(np.int32)


_FIRST = pa.schema([("block", pa.string()), ("lang", pa.string()), ("gaps", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per language and block: gaps and word codes of all its words, the distinct words and their counts."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lang in pc.unique(batch.column("lang")):
            for block in blocks(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"), _BLOCK):
                words, slots = _words(block.data, block.offsets)
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy()
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                row = [f"{part}-{number}", lang.as_py(), np.diff(slots, prepend=0), codes, coded.dictionary, counts]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _FIRST.types)], schema=_FIRST)
                number += 1


@contextmanager
def _few_rows_at_once(spark: SparkSession, rows: int = 16) -> Iterator[None]:
    """Rows of a relation are large: as many as this go to a worker at once, in what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _numbered(groups: DataFrame, name: str) -> DataFrame:
    """``groups``, written, with ``id``: distinct numbers from 0, without gaps between the rows of one file's task."""
    kept = staged(groups.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return kept.join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("at")).drop("part", "at", "start")


def _lookup(known: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The id of each wanted key, or -1; ``known`` is sorted."""
    if not len(known):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, ids[at], -1)


def _pairs(slots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of a relation with itself at the next position: slots, and both ids in one number."""
    beside = slots[1:] == slots[:-1] + 1
    return slots[:-1][beside], (ids[:-1][beside].astype(np.int64) << 32) | ids[1:][beside]


_RELATION = pa.schema([("block", pa.string()), ("gaps", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _slots(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.cumsum(_array(batch, "gaps", i))


def _kept(name: str, slots: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    there = ids >= 0
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, np.diff(slots[there], prepend=0), ids[there]), _RELATION.types)], schema=_RELATION)


def _semi_join(relation: DataFrame, groups: DataFrame, occurring: DataFrame, key: list[str], match: Callable, max_shared: int, name: str) -> DataFrame:
    """The next relation: ``match(known)`` gives a function of a batch and a row's place in it, to the row's slots and ids. The groups ``known`` come sorted by the last of ``key``.

    ``groups``: ``id`` and ``key``; ``occurring``: ``block`` and ``key``, each group of each row once.
    """
    fields = ["id", *key]
    n = groups.count()
    if n > 1 << 31:
        raise ValueError("phrase numbers have 31 bits: more than 2**31 frequent phrases of one length")
    if n <= max_shared:
        shared = relation.sparkSession.sparkContext.broadcast(groups.select(*fields).orderBy(key[-1]).toArrow())

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = match(shared.value)
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _kept(batch.column("block")[i].as_py(), *found(batch, i))

        return staged(relation.mapInArrow(small, "block string, gaps array<int>, ids array<int>"), name, **_WRITTEN)
    here = occurring.join(groups.select(*fields), key).groupBy("block").agg(F.array_sort(F.collect_list(F.struct(key[-1], *(f for f in fields if f != key[-1])))).alias("known"))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = match(pa.Table.from_struct_array(batch.column("known")[i].values))
                yield _kept(batch.column("block")[i].as_py(), *found(batch, i))

    return staged(relation.join(here, "block").mapInArrow(large, "block string, gaps array<int>, ids array<int>"), name, **_WRITTEN)


_Found = Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]


def _match_words(known: pa.Table) -> _Found:
    numbers: dict[str, dict[str, int]] = {}  # of each language that came up

    def found(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        lang = batch.column("lang")[i].as_py()
        if lang not in numbers:
            own = known.filter(pc.equal(known["lang"], lang))
            numbers[lang] = dict(zip(own["phrase"].to_pylist(), own["id"].to_pylist()))
        number = numbers[lang]
        words = batch.column("words")[i].values.to_pylist()
        by_code = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
        return _slots(batch, i), by_code[_array(batch, "codes", i)]

    return found


def _match_pairs(known: pa.Table) -> _Found:
    pairs, ids = known["pair"].to_numpy(), known["id"].to_numpy()

    def found(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        slots, own = _pairs(_slots(batch, i), _array(batch, "ids", i))
        return slots, _lookup(pairs, ids, own)

    return found


class _Counts:
    """Keys with counts, summed whenever ``_HELD`` have come together."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > _HELD:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys, place = np.unique(np.concatenate(self.keys or [np.zeros(0, np.int64)]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate(self.counts or [np.zeros(0)]), minlength=len(keys)).astype(np.int64)
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.keys[0], self.counts[0]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed with like bytes side by side."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data.as_buffer(), 8 * n, "zstd"), np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.int64)


_PACKED = {"slice": pa.int32(), "n": pa.int32(), "pairs": pa.binary(), "counts": pa.binary()}


def _count_pairs(slices: int) -> Callable:
    """For ``mapInArrow`` over a relation: the task's pairs with their counts, a row for each of ``slices`` parts of all pairs: sorted, differences packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def rows() -> Iterator[pa.RecordBatch]:
            pairs, counts = held.sum()
            part = (mix(pairs.view(np.uint64)) % np.uint64(slices)).astype(np.int32)
            order = np.argsort(part, kind="stable")  # pairs stay sorted in each part
            pairs, counts, part = pairs[order], counts[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
            for lo in range(0, len(cuts) - 1, 256):
                some = list(zip(cuts[:-1], cuts[1:]))[lo : lo + 256]
                columns = [part[cuts[:-1]][lo : lo + 256], [b - a for a, b in some], [_packed(np.diff(pairs[a:b], prepend=0)) for a, b in some], [_packed(counts[a:b]) for a, b in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED.values())], names=list(_PACKED))

        for batch in batches:
            for i in range(batch.num_rows):
                held.add(*np.unique(_pairs(_slots(batch, i), _array(batch, "ids", i))[1], return_counts=True))
                if held.size > _HELD // 2 and len(held.keys) == 1:
                    yield from rows()
                    held = _Counts()
        yield from rows()

    return run


def _frequent_pairs(least: int) -> Callable:
    """For ``mapInArrow`` over rows of :func:`_count_pairs` in order of their part: the pairs that come ``least`` times, one part in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, _Counts()

        def done() -> pa.RecordBatch:
            pairs, counts = held.sum()
            enough = counts >= least
            return pa.RecordBatch.from_arrays([pa.array(pairs[enough], pa.int64()), pa.array(counts[enough], pa.int64())], names=["pair", "a"])

        for batch in batches:
            numbers, sizes = batch.column("slice").to_pylist(), batch.column("n").to_pylist()
            for i, number in enumerate(numbers):
                if number != part:
                    if part is not None:
                        yield done()
                    part, held = number, _Counts()
                held.add(np.cumsum(_unpacked(batch.column("pairs")[i], sizes[i])), _unpacked(batch.column("counts")[i], sizes[i]))
        yield done()

    return run


def _pairs_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of each row once."""
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = np.unique(_pairs(_slots(batch, i), _array(batch, "ids", i))[1])
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(pairs), pa.string()), pa.array(pairs, pa.int64())], names=["block", "pair"])


def _levels(docs: DataFrame, min_count: int, max_words: int, max_shared: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1, 2 ... words as ``id, lang, phrase, last, a, firsts, rests, g1, g2``; and ``lang, n``.

    ``firsts`` and ``rests`` have the counts of the first and last 1, 2 ... words; ``g1, g2`` are the phrases without the last and the first word.
    """
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    first = staged(texts.mapInArrow(_tokenized, "block string, lang string, gaps array<int>, codes array<int>, words array<string>, counts array<long>"), "phrase-words", **_WRITTEN)
    occurring = first.select("block", "lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("block", "lang", F.col("x.words").alias("phrase"), F.col("x.counts").alias("n"))
    totals = first.select("lang", F.size("codes").cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<long>")
    frequent = occurring.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    level = _numbered(frequent, "phrases-1").select("id", "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("firsts"), none.alias("rests"), F.lit(None).cast("long").alias("g1"), F.lit(None).cast("long").alias("g2"))
    with _few_rows_at_once(docs.sparkSession):
        return _extended(first, level, occurring, max_words, min_count, max_shared), totals


def _extended(first: DataFrame, level: DataFrame, occurring: DataFrame, max_words: int, min_count: int, max_shared: int) -> list[DataFrame]:
    """All levels, from the frequent words on."""
    levels = [level]
    relation = _semi_join(first, level, occurring, ["lang", "phrase"], _match_words, max_shared, "relation-1")
    for k in range(2, max_words + 1):
        slices = max(16, relation.agg(F.sum(F.size("ids"))).first()[0] // _SLICE) if relation.take(1) else 16
        counted = relation.mapInArrow(_count_pairs(slices), "slice int, n int, pairs binary, counts binary").repartition("slice").sortWithinPartitions("slice")
        groups = _numbered(counted.mapInArrow(_frequent_pairs(min_count), "pair long, a long"), f"pairs-{k}")
        below = levels[-1]
        left = below.select(F.col("id").alias("g1"), "lang", F.col("phrase").alias("head"), F.array_append("firsts", F.col("a")).alias("firsts"))
        right = below.select(F.col("id").alias("g2"), F.col("last"), F.array_append("rests", F.col("a")).alias("rests"))
        pair = groups.select("id", "a", F.shiftrightunsigned("pair", 32).alias("g1"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("g2"))
        named = pair.join(left, "g1").join(right, "g2")
        levels.append(staged(named.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "firsts", "rests", "g1", "g2"), f"phrases-{k}"))
        if k < max_words:
            relation = _semi_join(relation, groups, relation.mapInArrow(_pairs_of_rows, "block string, pair long"), ["pair"], _match_pairs, max_shared, f"relation-{k}")
    return levels


def _cuts() -> Column:
    """The lowest score of all cuts, with its parts: the smallest struct of (score, words in the first part)."""
    big = "cast({} as decimal(18,0))"
    score = f"cast(1000 as decimal(4,0)) * {big.format('a')} * {big.format('n')} div ({big.format('firsts[k - 1]')} * {big.format('rests[size(rests) - k]')})"
    return F.expr(f"array_min(transform(sequence(1, size(firsts)), k -> named_struct('score', {score}, 'k', k, 'l', firsts[k - 1], 'r', rests[size(rests) - k])))")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, max_shared: int = MAX_SHARED) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase that always stands inside one longer candidate is left out. It is enough to look one word further: if a longer
    phrase is as frequent, so is every phrase between the two.
    """
    levels, totals = _levels(docs, min_count, max_words, max_shared)
    kept = []
    for level, above in zip(levels[1:], [*levels[2:], None]):
        if above is not None:
            longer = F.col("firsts")[F.size("firsts") - 1], F.col("rests")[F.size("rests") - 1]
            covered = above.where(longer[0] == F.col("a")).select(F.col("g1").alias("id")).unionByName(above.where(longer[1] == F.col("a")).select(F.col("g2").alias("id")))
            level = level.join(covered, "id", "left_anti")
        kept.append(level.select("lang", "phrase", "a", "firsts", "rests"))
    scored = reduce(DataFrame.unionByName, kept).join(totals, "lang").withColumn("cut", _cuts())
    ranked = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
