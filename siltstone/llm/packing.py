"""Packing by multiway differencing (Karmarkar-Karp).

Every document becomes token ids plus the closing id. Full windows are cut off
first; what remains is cut into pieces of at most ``cut`` tokens. Pieces are
dealt by hash into groups of about ``group_tokens`` tokens (the number of
groups follows from the counted total; equal pieces beyond ``MAX_EQUAL`` are
dealt row by row, so that a row repeated a million times fills no group), and each group is packed on its own:
partial partitions into k windows, the two with the largest spread first, are
merged with opposing imbalances (largest window on smallest) until one is
left. k starts at the least number that could hold the group and rises while
the fullest window exceeds the capacity.

Edge cases: a null or empty text is one piece, the closing id alone; equal
rows give equal pieces, each placed once; null ids are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, id_key, staged, texts_of
from .tokens import BLOCK_BYTES, WordBpe

WINDOW = 2048
CUT = 512
GROUP_TOKENS = 200 * WINDOW
#: Equal pieces (same id, place and tokens) that one group takes.
MAX_EQUAL = 100
CLOSING = 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = _PIECES + ", sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


def _cuts(n: int, window: int, cut: int) -> list[int]:
    """Where a document of ``n`` ids is cut: full windows, then pieces of at most ``cut``."""
    edges = list(range(0, n + 1, window))
    edges += range(edges[-1] + cut, n, cut)
    return edges if edges[-1] == n else [*edges, n]


def _cut_documents(path: str, window: int, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "")
            for block in blocks(texts, BLOCK_BYTES):
                ids, counts = bpe.encode_block(block.data, block.offsets)
                out: list[tuple] = []
                for i, end in enumerate(np.cumsum(counts)):
                    own = np.append(ids[end - counts[i] : end], CLOSING).astype("<u4")
                    edges = _cuts(len(own), window, cut)
                    for a, b in zip(edges, edges[1:]):
                        out.append((doc_ids[block.rows.start + i], a, b - a, zlib.crc32(own[a:b].tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in _PIECES.split(", ")])

    return run


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """The window of each size among ``k`` near-equal windows, and the fullest window's total."""
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, tie, b, b_nodes = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # windows in which both partitions have something
        alone = len(a) - both
        met = b[::-1][: both]
        sums = np.concatenate((a[:alone], a[alone:] + met, b[: len(b) - both]))
        made = np.arange(len(left), len(left) + both)
        left += a_nodes[alone:].tolist()
        right += b_nodes[::-1][:both].tolist()
        nodes = np.concatenate((a_nodes[:alone], made, b_nodes[: len(b) - both]))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), tie, sums, nodes))
    window = np.zeros(len(left), dtype=np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(len(left) - 1, len(sizes) - 1, -1):  # children were made before their parents
        window[left[node]] = window[right[node]] = window[node]
    return window[: len(sizes)], int(heap[0][2][0])


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size; no window exceeds ``capacity``."""
    if not sizes:
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, fullest = differencing(sizes, k)
        if fullest <= capacity:
            return window
        k += 1


def _pack_group(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        full = int((pdf["length"] == window).sum())
        place = np.concatenate((np.arange(full), full + pack(pdf["length"].iloc[full:].tolist(), window)))
        pdf["sequence_id"] = (int(pdf["group"].iloc[0]) << 24) + place
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="group")

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, cut: int = CUT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    cutter = _cut_documents(vocabulary or default_vocabulary(), window, cut)
    pieces = staged(texts_of(docs).mapInArrow(cutter, _PIECES), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    same = [id_key().alias("key"), "start", "ids_crc32"]
    hot = staged(pieces.groupBy(*same).agg(F.count("*").alias("equal")).where(F.col("equal") > MAX_EQUAL), "equal-pieces")
    # Row numbers of a written table: a task that runs again finds the same.
    rows = pieces.withColumn("key", id_key()).withColumn("row", F.monotonically_increasing_id()).join(hot, ["key", "start", "ids_crc32"], "left")
    spread = F.when(F.col("equal").isNotNull(), F.col("row"))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", spread), F.lit(groups)))
    dealt = dealt.select(*(c.split()[0] for c in _PIECES.split(", ")), "group")
    return dealt.groupBy("group").applyInPandas(_pack_group(window), _PLACED)
