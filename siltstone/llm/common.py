"""Pieces that the operators of this subpackage share.

* :func:`staged` cuts lineage by a table in the folder that the session names
  in ``spark.checkpoint.dir`` (all executors see that folder).
* :class:`Block` turns Arrow text columns into numpy byte blocks of bounded
  size, so that the per-document work inside a task is vectorised.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of the operators' contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null document id where ids are compared or grouped.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. If the session names none: a local one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once into the shared folder (with ``options`` of the writer) and read it back: later uses survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) only; with ``carry``, also those columns as the struct ``carried``.

    Other columns, whatever their names, stay outside, so they cannot clash with an operator's own.
    """
    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    return docs.select(*columns, *([F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []))


def id_key(column: Column | str = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID))


@dataclass
class Block:
    """Some documents' bytes end to end. ``offsets[i]:offsets[i + 1]`` is document ``i``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each document."""
        run = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = 2_000_000) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes (one document at least) from a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(slice(first, last), whole[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def word_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of non-blank bytes inside a document), and two per-byte masks."""
    blank = _IS_BLANK[block.data]
    edge = np.zeros(len(blank) + 1, dtype=bool)
    edge[block.offsets] = True
    before = np.ones(len(blank) + 1, dtype=bool)
    before[1:] = blank
    starts = np.flatnonzero(~blank & (before[:-1] | edge[:-1]))
    after = np.ones(len(blank), dtype=bool)
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, blank, edge


_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS.encode())] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """1, r, r*r, ... modulo 2**64 for the base of the rolling hash, or for its inverse."""
    if len(_POWERS.get(kind, ())) < n:
        step = np.full(1 << max(19, (n - 1).bit_length()), _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        _POWERS[kind] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """64-bit polynomial hashes of any byte ranges of a block, after one pass over it."""

    def __init__(self, data: np.ndarray):
        weighed = (data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data))
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)))
        self.back = _powers("down", len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        body = (self.run[ends] - self.run[starts]) * self.back[starts]
        return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
