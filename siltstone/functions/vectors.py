"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def usable(a: Column) -> Column:
    """Finite throughout and longer than the tolerance."""
    odd = F.exists(a, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return ~odd & (norm(a) > EPSILON)


def decode(dims: int, encoding: str):
    """A pandas UDF from little-endian bytes (``f32le`` or ``f16le``) to values; null if the length is wrong."""
    kind = {"f32le": "<f4", "f16le": "<f2"}[encoding]
    size = dims * np.dtype(kind).itemsize

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield raw.map(lambda b: np.frombuffer(b, kind).astype("<f4") if b is not None and len(b) == size else None)

    return run


def encode(encoding: str):
    """The inverse of :func:`decode`."""
    kind = {"f32le": "<f4", "f16le": "<f2"}[encoding]

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: np.asarray(v, dtype=kind).tobytes() if v is not None else None)

    return run
