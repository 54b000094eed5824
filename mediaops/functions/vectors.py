"""Vector scores, computed per Arrow batch on the flat value buffer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_matrix(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array as a float64 matrix, with a mask of the null rows.

    Works on the flat buffer; all non-null rows must have one length.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    null = np.asarray(arr.is_null())
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    live = int((~null).sum())
    if live == 0:
        return np.zeros((len(arr), 1)), null
    if flat.size % live:
        raise ValueError("vectors of different length in one column")
    out = np.zeros((len(arr), flat.size // live))
    out[~null] = flat.reshape(live, -1)
    return out, null


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine is 0."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosine_to(column: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity of each vector to one fixed vector; zero vectors give 0, null gives null."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(q))
    q = q / norm if norm > 0 else q

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        matrix, null = batch_matrix(vectors)
        if null.all():
            return pa.nulls(len(null), pa.float64())
        return pa.array(unit_rows(matrix) @ q, mask=null)

    return score(column)


def cosine_between(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vector columns of the same row."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        x, nx = batch_matrix(left)
        y, ny = batch_matrix(right)
        null = nx | ny
        if null.all():
            return pa.nulls(len(null), pa.float64())
        return pa.array(np.einsum("ij,ij->i", unit_rows(x), unit_rows(y)), mask=null)

    return score(a, b)
