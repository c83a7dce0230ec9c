"""Vectors as integers, shared by the code and whitening operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """Length of the longest vector (0 without any)."""
    return df.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0


def floor_matrix(column, scale: float, dims: int, limit: int):
    """Arrow list column -> floor(scale * x) as int64, shorter vectors filled up with zeros, values held to +-limit."""
    import numpy as np
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(column), dims))
    x[np.arange(dims)[None, :] < column.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -limit, limit).astype(np.int64)


def packed(matrix):
    """int64 matrix -> Arrow binary column of little-endian int32 rows."""
    import numpy as np
    import pyarrow as pa
    m = np.ascontiguousarray(matrix, dtype="<i4")
    step = m.shape[1] * 4
    offsets = np.arange(len(m) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(m.tobytes())])


def unpacked(column, dims: int):
    """Arrow binary column of int32 rows -> int64 matrix."""
    import numpy as np
    import pyarrow as pa
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype="<i4", count=(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])) if data else \
        np.zeros(0, "<i4")
    return body.reshape(len(column), dims).astype(np.int64)


def slices(batches, cells: int, dims: int):
    """Arrow batches cut so that a piece holds at most ``cells`` numbers (one row at least)."""
    step = max(1, cells // max(dims, 1))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)
