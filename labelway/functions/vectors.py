"""Arrow batches of vectors as NumPy matrices, inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Packed sparse vectors: indices and values, 4 bytes each.
PACKED = T.StructType([T.StructField("i", T.BinaryType()), T.StructField("v", T.BinaryType())])


def binary_parts(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a binary or string array ends, from 0 on, and all bytes."""
    n = len(x)
    large = pa.types.is_large_binary(x.type) or pa.types.is_large_string(x.type)
    size = np.dtype(np.int64 if large else np.int32)
    if not n or x.buffers()[2] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(x.buffers()[1], dtype=size)[x.offset : x.offset + n + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(x.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]


def as_bytes(values: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Runs of ``lengths`` of 4-byte values as a binary array, null where not ``valid``."""
    offsets = np.r_[0, np.cumsum(4 * lengths)].astype(np.int32)
    bits = np.packbits(valid, bitorder="little")
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [pa.py_buffer(b.tobytes()) for b in (bits, offsets, np.ascontiguousarray(values))]
    )


def packed(index: np.ndarray, value: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Sparse rows ``struct<i:binary,v:binary>`` of 4-byte indices and values."""
    parts = [as_bytes(x, lengths, valid) for x in (index, value)]
    return pa.StructArray.from_arrays(parts, names=["i", "v"], mask=pa.array(~valid))


def entries(x: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each packed sparse row ends, from 0 on, all indices, and all values of type ``kind``."""
    index, value = x.flatten()
    ends, index = binary_parts(index)
    return ends // 4, index.view("<i4"), binary_parts(value)[1].view(kind)


def _columns(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indices in order, and the place of each index among them."""
    most = int(index.max(initial=-1)) + 1
    if most > 8 * len(index):
        return np.unique(index, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[index] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[index]


def chunks(x: pa.Array, size: int = 128) -> Iterator[tuple[slice, np.ndarray | None, np.ndarray]]:
    """(rows, columns, matrix) of parts of ``x``: all columns (None) of packed or listed dense
    vectors, or the columns that occur in a part of packed sparse ones. So products
    with weights cost what the vectors hold, and a matrix of ``size`` rows stays in the core's cache."""
    if not pa.types.is_struct(x.type):
        matrix = to_matrix(x)
        for at in range(0, len(x), size):
            part = slice(at, min(at + size, len(x)))
            yield part, None, matrix[part]
        return
    ends, index, value = entries(x, "<f4")
    for at in range(0, len(x), size):
        part = slice(at, min(at + size, len(x)))
        lo, hi = ends[part.start], ends[part.stop]
        columns, place = _columns(index[lo:hi])
        matrix = np.zeros((part.stop - part.start, len(columns)))
        matrix[np.repeat(np.arange(len(matrix)), np.diff(ends[part.start : part.stop + 1])), place] = value[lo:hi]
        yield part, columns, matrix


def to_matrix(x: pa.Array) -> np.ndarray:
    """Rows of equal length, packed or as lists, to [n, dim] float64."""
    n = len(x)
    if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type):
        flat = binary_parts(x)[1].view("<f4")
    else:
        flat = x.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def logits(x: pa.Array, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of packed, listed or sparse vectors under class weights."""
    if not pa.types.is_struct(x.type):
        return to_matrix(x) @ w.T + b
    parts = [matrix @ w[:, columns].T + b for _, columns, matrix in chunks(x)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)))
