"""Exact substring dedup: bytes under any ``MATCH``-byte string that starts in two places.

Every window of ``MATCH`` bytes has an anchor, the least of its first byte
8-grams by hash, so equal windows have equal anchors at equal distances. One
row per anchor stands for the run of windows that share it.

1. Coarse: a row has the hash of the core that all its windows contain, and of
   its whole piece. Cores that occur once end here, without their text. Pieces
   that occur twice are repeats as a whole. Counts are aggregated before they
   are shuffled, so a passage in a third of all documents is a handful of rows.
2. Fine: distinct pieces that share a core but differ (the edges of repeats)
   fetch their text once and are anchored again, at up to ``FINE`` windows a row.
3. Suffix arrays: each group of fine pieces with one core becomes strings of
   the bytes left of the core, one symbol for the core, and the bytes right of
   it. Suffix sorting by linear grouping (:mod:`gsaca`) brings equal windows
   together: a window repeats if a neighbour shares all its symbols.
   A group of more than ``HOT`` different pieces (a common passage between
   unlike neighbours) is split first: of its windows, those that begin in the
   half of the places nearer to the core share a longer core, and so do the
   others. Halves are groups of their own, and are split again if need be; a
   half of one place has one piece only.
4. The repeated windows of a document meet its text again and are cut out.

Hashes that decide equality are 128 bits (two independent 64-bit hashes), and
so are the keys by which a row finds its text again.

Edge cases: null or empty text has nothing to remove; texts shorter than
``MATCH`` bytes stay whole; rows that repeat are two places, so long equal rows
lose everything; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, staged, texts_of
from .gsaca import suffix_array

MATCH = 400
GRAM = 8
#: Windows per anchor at most: in the first pass, and for the edges.
COARSE, FINE = 256, 32
#: Different pieces of one core that a suffix array takes; larger groups are split.
HOT = 512
#: Contested pieces per task.
TASK_PIECES = 5_000
#: Bytes of coarse pieces that are anchored at once.
FINE_BYTES = 2_000_000
#: Symbols of one suffix array.
ARRAY_SYMBOLS = 200_000


def _anchors(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each run; windows start in ``starts[k]:stops[k]`` (of one text each)."""
    n = len(data) - GRAM + 1
    if n < run or not len(starts):
        return (np.zeros(0, np.int64),) * 3
    code = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        code |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    least = (mix(code) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < run:  # run is a power of two: minima over 2, 4, 8 ... grams
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.maximum(stops - starts, 0)
    shift = np.repeat(starts - (np.cumsum(size) - size), size)
    window = shift + np.arange(len(shift))
    text = np.repeat(np.arange(len(starts)), size)
    anchor = at[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return window[first], window[last], anchor[first]


_COARSE_ROWS = "doc_key long, text_key long, lo int, hi int, h long, p long"


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    core = MATCH - COARSE + 1
    for batch in batches:
        doc_key, text_key = (batch.column(k).to_numpy() for k in (0, 1))
        for block in blocks(batch.column(2)):
            lo, hi, anchor = _anchors(block.data, block.offsets[:-1], block.offsets[1:] - MATCH + 1, COARSE)
            raw = block.data.tobytes()
            cores = [xxhash.xxh64_intdigest(raw[a : a + core]) for a in anchor.tolist()]
            pieces = [xxhash.xxh3_64_intdigest(raw[a : b + MATCH], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), anchor.tolist())]
            doc = np.searchsorted(block.offsets, lo, side="right") - 1
            row, base = doc + block.rows.start, block.offsets[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_key[row]), pa.array(text_key[row]), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(np.array(pieces, np.uint64).view(np.int64))],
                [c.split()[0] for c in _COARSE_ROWS.split(", ")],
            )


_FINE_ROWS = "doc_key long, text_key long, weight int, lo int, size int, h long, p long, left binary, right binary"


def _fine_batch(work: list[tuple]) -> pa.RecordBatch:
    """Fine pieces of coarse pieces (doc_key, text_key, weight, lo, bytes), anchored in one go."""
    core = MATCH - FINE + 1
    raw = b"".join(w[4] for w in work)
    ends = np.cumsum([len(w[4]) for w in work])
    begins = ends - [len(w[4]) for w in work]
    first, last, anchor = _anchors(np.frombuffer(raw, np.uint8), begins, ends - MATCH + 1, FINE)
    owner = np.searchsorted(ends, first, side="right")
    h, p, left, right = [], [], [], []
    for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist()):
        h.append(xxhash.xxh3_64_intdigest(raw[c : c + core]))
        p.append(xxhash.xxh64_intdigest(raw[a : b + MATCH], c - a))
        left.append(raw[a:c])
        right.append(raw[c + core : b + MATCH])
    column = lambda k, kind: pa.array([w[k] for w in work], kind).take(pa.array(owner))
    lo = np.array([w[3] for w in work], dtype=np.int64)[owner] + first - begins[owner]
    hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, p)]
    values = [column(0, pa.int64()), column(1, pa.int64()), column(2, pa.int32()), pa.array(lo.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), *hashes, pa.array(left, pa.binary()), pa.array(right, pa.binary())]
    return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _FINE_ROWS.split(", ")])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fine pieces of each document's unresolved coarse pieces (``reps``: array of lo, hi, weight)."""
    work: list[tuple] = []
    held = 0
    for batch in batches:
        for doc_key, text_key, text, reps in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            for rep in reps:
                work.append((doc_key, text_key, rep["weight"], rep["lo"], data[rep["lo"] : rep["hi"] + MATCH]))
                held += len(work[-1][4])
                if held > FINE_BYTES:
                    yield _fine_batch(work)
                    work, held = [], 0
    if work:
        yield _fine_batch(work)


def repeated_windows(groups: list[int], lefts: list[bytes], rights: list[bytes], width: int = FINE) -> list[list[int]]:
    """For each piece: the windows of ``width`` symbols (by number) that another place among the pieces repeats, by a suffix array."""
    cores = {h: i for i, h in enumerate(dict.fromkeys(groups))}
    low = len(lefts) + 256  # symbols: ends of strings (all different), bytes, cores
    text: list[int] = []
    begins = []
    for i, (h, left, right) in enumerate(zip(groups, lefts, rights)):
        begins.append(len(text))
        text += [b + len(lefts) for b in left]
        text.append(low + cores[h])
        text += [b + len(lefts) for b in right]
        text.append(i)
    sa = np.array(suffix_array(text))
    symbols = np.concatenate((np.array(text), -1 - np.arange(width)))
    alike = np.ones(len(sa) - 1, dtype=bool)
    for k in range(width):
        alike &= symbols[sa[:-1] + k] == symbols[sa[1:] + k]
    again = np.zeros(len(text) + 1, dtype=bool)
    again[sa[:-1][alike]] = True
    again[sa[1:][alike]] = True
    return [np.flatnonzero(again[b : b + len(left) + 1]).tolist() for b, left in zip(begins, lefts)]


_RANGES = "h long, p long, first int, last int"


def _suffix_groups(width: int):
    """Rows (h, p, left, right), whole groups per partition, sorted by h: the repeated windows as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows(*(list(c) for c in zip(*((h, left, right) for h, _, left, right in held))), width)
            rows = []
            for (h, p, *_), windows in zip(held, found):
                for w in windows:
                    if rows and rows[-1][:2] == [h, p] and rows[-1][3] == w - 1:
                        rows[-1][3] = w
                    else:
                        rows.append([h, p, w, w])
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "p", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if symbols > ARRAY_SYMBOLS and row[0] != held[-1][0]:
                    yield flush()
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[2]) + len(row[3]) + 2
        if held:
            yield flush()

    return run


def _halves(pieces: DataFrame, width: int) -> DataFrame:
    """``h, p, h2, p2, shift, size, n, left, right``: each piece's windows in two parts, by their distance d to the core.

    Windows with d < half share the first bytes right of the core, the others the last bytes left of it.
    Window w of a part is window ``shift + w`` of the piece.
    """
    half = width // 2
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    nearest = width - 1 - n_right  # the least d
    near_left = F.least(n_left, F.lit(half - 1))
    near = F.struct(
        F.xxhash64("h", F.lit(0), F.substr("right", F.lit(1), F.lit(half))).alias("h2"), (n_left - near_left).alias("shift"),
        F.substr("left", n_left - near_left + 1, near_left).alias("left"), F.substr("right", F.lit(half + 1)).alias("right"),
    )
    far = F.struct(
        F.xxhash64("h", F.lit(1), F.substr("left", n_left - half + 1, F.lit(half))).alias("h2"), F.lit(0).alias("shift"),
        F.substr("left", F.lit(1), n_left - half).alias("left"), F.substr("right", F.lit(1), half - 1 - F.greatest(nearest - half, F.lit(0))).alias("right"),
    )
    parts = F.filter(F.array(F.when(nearest < half, near), F.when(n_left >= half, far)), lambda x: x.isNotNull())
    each = pieces.select("h", "p", "n", F.explode(parts).alias("part")).select("h", "p", "n", "part.*")
    size = F.octet_length("left") + F.octet_length("right") - half + 2
    return each.withColumn("p2", F.xxhash64(F.lit(17), "left", F.lit(0), "right", F.octet_length("left"))).withColumn("size", size)


def _contested_windows(pieces: DataFrame, width: int) -> DataFrame:
    """``h, p, first, last``: the repeated windows of different pieces (``h, p, n, pieces, left, right``) that share cores."""
    few = pieces.where(F.col("pieces") <= HOT)
    # Sorting suffixes costs far more than its bytes suggest, so rows, not bytes, set the number of tasks.
    tasks = 1 + few.count() // TASK_PIECES
    found = few.select("h", "p", "left", "right").repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(_suffix_groups(width), _RANGES)
    if width == 1 or not pieces.where(F.col("pieces") > HOT).take(1):
        return found
    half = width // 2
    parts = staged(_halves(pieces.where(F.col("pieces") > HOT), width), "repeats-halves")
    alike = parts.groupBy("h2", "p2").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    alike = staged(alike.select(F.col("h2").alias("h"), F.col("p2").alias("p"), "n", "left", "right"), "repeats-parts")
    several = staged(alike.groupBy("h").agg(F.count("*").alias("pieces")).where("pieces > 1"), "repeats-several")
    inner = staged(alike.join(several, "h"), "repeats-contested")
    ranges = alike.where("n > 1").select("h", "p", F.lit(0).alias("first"), F.lit(half - 1).alias("last")).unionByName(_contested_windows(inner, half))
    ranges = staged(ranges.select(F.col("h").alias("h2"), F.col("p").alias("p2"), "first", "last"), "repeats-ranges")
    back = parts.select("h", "p", "h2", "p2", "shift", "size").join(ranges, ["h2", "p2"])
    return found.unionByName(back.select("h", "p", (F.col("first") + F.col("shift")).alias("first"), (F.least(F.col("last"), F.col("size") - 1) + F.col("shift")).alias("last")))


def _edge_windows(fine: DataFrame) -> DataFrame:
    """``doc_key, text_key, lo, hi``: the repeated windows inside fine pieces.

    Counting shuffles hashes only; bytes beside the core travel for the cores that different pieces share.
    """
    counted = staged(fine.groupBy("h", "p").agg(F.sum("weight").alias("n")), "repeats-fine")
    groups = staged(counted.groupBy("h").agg(F.count("*").alias("pieces")).where("pieces > 1"), "repeats-groups")
    contested = fine.select("h", "p", "weight", "left", "right").join(groups, "h").groupBy("h", "p")
    contested = staged(contested.agg(F.sum("weight").alias("n"), F.first("pieces").alias("pieces"), F.first("left").alias("left"), F.first("right").alias("right")), "repeats-contested")
    whole = counted.where("n > 1").select("h", "p", F.lit(0).alias("first"), F.lit(FINE - 1).alias("last"))
    ranges = whole.unionByName(_contested_windows(contested, FINE))
    ranges = staged(ranges, "repeats-ranges")
    found = fine.select("h", "p", "doc_key", "text_key", "lo", "size").join(ranges, ["h", "p"])
    last = F.least(F.col("last"), F.col("size") - 1)
    return found.select("doc_key", "text_key", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + last).alias("hi"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the bytes under repeated windows from each text."""
    for batch in batches:
        n_bytes, removed, spans, kept = [], [], [], []
        texts = pc.fill_null(batch.column(1), "")
        for text, ranges in zip(texts, batch.column(2)):
            raw = text.as_buffer()
            size = raw.size
            if not ranges.is_valid:
                n_bytes.append(size), removed.append(0), spans.append([]), kept.append(raw.to_pybytes())
                continue
            rows = ranges.values
            edge = np.zeros(size + 1, dtype=np.int32)
            np.add.at(edge, rows.field("lo").to_numpy(), 1)
            np.add.at(edge, rows.field("hi").to_numpy() + MATCH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            n_bytes.append(size), removed.append(int(gone.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, spans`` (byte runs) and ``kept`` (binary)."""
    text = F.coalesce("text", F.lit(""))
    # Rows without an id are told apart by 128 bits of their text.
    rows = texts_of(docs).select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit(11), text)).alias("doc_key"), F.xxhash64(text, F.lit(7)).alias("text_key"), text.alias("text"))
    anchors = staged(rows.where(F.octet_length("text") >= MATCH).select("doc_key", "text_key", "text").mapInArrow(_coarse, _COARSE_ROWS), "repeats-anchors")
    cores = staged(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats-cores")
    shared = staged(anchors.join(cores, "h"), "repeats-shared")
    pieces = staged(shared.groupBy("h", "p").agg(F.count("*").cast("int").alias("n"), F.first("doc_key").alias("doc_key"), F.first("text_key").alias("text_key"), F.first("lo").alias("lo"), F.first("hi").alias("hi")), "repeats-pieces")
    whole = shared.join(pieces.where("n > 1").select("h", "p"), ["h", "p"]).select("doc_key", "text_key", "lo", "hi")
    several = staged(pieces.groupBy("h").agg(F.count("*").alias("pieces")).where("pieces > 1").select("h"), "repeats-several")
    reps = pieces.join(several, "h").select("doc_key", "text_key", F.struct("lo", "hi", F.least("n", F.lit(2)).alias("weight")).alias("rep"))
    reps = reps.groupBy("doc_key", "text_key").agg(F.collect_list("rep").alias("reps")).hint("shuffle_hash")
    one = rows.select("doc_key", "text_key", "text").join(reps, ["doc_key", "text_key"])
    # Equal rows of one id fetch the same text twice; their windows are places already counted in the weight.
    fine = one.mapInArrow(_fine, _FINE_ROWS).dropDuplicates(["doc_key", "text_key", "lo", "h", "p"]) if _has_repeated_ids(rows) else one.mapInArrow(_fine, _FINE_ROWS)
    fine = staged(fine, "repeats-edges")
    ranges = whole.unionByName(_edge_windows(fine)).groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")).hint("shuffle_hash")
    joined = rows.join(ranges, ["doc_key", "text_key"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def _has_repeated_ids(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_key").agg(F.count("*").alias("n")).where("n > 1").take(1))
