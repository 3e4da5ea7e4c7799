"""Arrow record batches to numpy and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """list<double> column as an (n, width) float matrix; missing rows and elements are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out = np.full((n, width), np.nan)
    valid = np.asarray(column.is_valid())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size:
        out[valid] = flat.astype(float, copy=False).reshape(-1, width)
    return out


def vector(column: pa.Array, default: float = np.nan) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False).astype(float, copy=False)
    return np.where(np.isnan(values), default, values)


def width(column: pa.Array) -> int:
    """Length of the lists of a column whose lists all have the same length (0 if all are missing)."""
    lengths = column.value_lengths().drop_null()
    return int(lengths[0].as_py()) if len(lengths) else 0


def groups(ids: np.ndarray):
    """(id, its rows) of a batch, from one sort: the work is linear in the rows, however many ids there are."""
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ids) else np.zeros(0, int)
    for v, rows in zip(ordered[first], np.split(order, first[1:])):
        yield int(v), rows


def list_array(values: np.ndarray) -> pa.Array:
    """(n, width) matrix as a list<double> column; NaN elements become NULL."""
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values, dtype=float).ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), flat)


def softmax_rows(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def log_softmax_rows(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return a - top - np.log(np.exp(a - top).sum(axis=-1, keepdims=True))
