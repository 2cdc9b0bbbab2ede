"""Vectors of whole numbers and their exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components from here on do not fit a long.
TOO_LARGE = 2.0**63


def floors(vector: Column, scale: float, name: Column) -> Column:
    """Components as ``floor(scale * x)``; null where one is null or not finite.

    A component that fits no long is an error, which tells the vector's ``name``.
    """
    doubles = vector.cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    large = F.exists(doubles, lambda x: F.abs(x * scale) >= TOO_LARGE)
    error = F.raise_error(F.concat(F.lit("a component of vector "), name.cast("string"), F.lit(" fits no long")))
    whole = F.transform(doubles, lambda x: F.floor(x * scale))
    return F.when(sound, F.when(large, error.cast("array<bigint>")).otherwise(whole))


def matrix(vectors: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """A list column as rows of longs, shorter vectors filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    found = np.zeros((len(vectors), dimensions), np.int64)
    if len(vectors):
        lengths = np.asarray(vectors.value_lengths())
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        found[row, np.arange(len(row)) - first] = vectors.flatten().to_numpy(zero_copy_only=False)
    return found


def _largest(rows: np.ndarray) -> int:
    return max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0


def products(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of longs.

    Sums below 2^53 go through doubles, those below 2^63 through longs. Beyond that
    they are Python integers, and a product that fits no long is an error, which tells
    the ids of its vectors.
    """
    most = _largest(left) * _largest(right) * left.shape[1]
    if most < 2**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if most < 2**63:
        return left @ right.T
    wide = left.astype(object) @ right.astype(object).T
    beyond = np.argwhere((wide >= 2**63) | (wide < -(2**63)))
    if len(beyond):
        a, b = beyond[0]
        raise OverflowError(f"the product of vectors {left_ids[a]} and {right_ids[b]} fits no long")
    return wide.astype(np.int64)
