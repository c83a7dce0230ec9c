"""Whitening of embeddings from exact integer cross-products of bit planes.

Components become integers, every dimension is shifted by its smallest value,
and the bits of a block of rows are packed plane by plane into 64-bit words, one
bit a row.  The popcount of the AND of two planes, weighted by the two bits'
powers of two, is their share of a cross-product, so the sums of products are
exact integers; they are centred as integers before the eigenvectors are taken.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise
from tracefeat.llm.vectors import finite, floor_matrix, packed, slices, unpacked, width

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
LIMIT = 1 << 30              # floor(64 * c) is held to this range
BLOCK_CELLS = 1 << 20        # numbers of a block: 16,384 rows of 64 dimensions


def bit_planes(y, bits):
    """Planes of a non-negative integer matrix, packed across rows: (words per plane, dimension and bit of each)."""
    import numpy as np
    rows = -(-len(y) // 64) * 64
    planes, dim, bit = [], [], []
    for d, b in enumerate(bits):
        for k in range(b):
            plane = np.zeros(rows, dtype=np.uint8)
            plane[:len(y)] = (y[:, d] >> k) & 1
            planes.append(np.packbits(plane).view(np.uint64))
            dim.append(d)
            bit.append(k)
    words = np.array(planes, dtype=np.uint64).reshape(len(planes), rows // 64)
    return words, np.array(dim, dtype=np.int64), np.array(bit, dtype=np.int64)


def plane_counts(words):
    """Popcounts of the AND of every two planes (upper triangle)."""
    import numpy as np
    out = np.zeros((len(words), len(words)), dtype=np.int64)
    for a in range(len(words)):
        out[a, a:] = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64)
    return out


def weighted(counts, dim, bit, dims):
    """Cross-products (upper triangle, Python integers) from the popcounts of plane pairs."""
    import numpy as np
    total = np.zeros((dims, dims), dtype=object)
    i, j = np.triu_indices(len(counts))
    power = bit[i] + bit[j]
    for s in np.unique(power):
        at = power == s
        flat = np.bincount(dim[i[at]] * dims + dim[j[at]], weights=None, minlength=dims * dims) * 0
        np.add.at(flat, dim[i[at]] * dims + dim[j[at]], counts[i[at], j[at]])
        # two planes of one dimension occur once in the triangle, but twice in its square
        twice = at & (dim[i] == dim[j]) & (i != j)
        np.add.at(flat, dim[i[twice]] * dims + dim[j[twice]], counts[i[twice], j[twice]])
        total += flat.reshape(dims, dims).astype(object) << int(s)
    return total


def _column_sums(fit: DataFrame, dims: int):
    """Row count and per dimension sum, smallest and largest value, as Python integers."""
    def sums(batches):
        import numpy as np
        for b in slices(batches, BLOCK_CELLS, dims):
            x = unpacked(b.column(0), dims) + OFFSET
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(range(dims), pa.int32()), "n": pa.array(np.full(dims, len(x)), pa.int64()),
                "s": pa.array(x.sum(axis=0), pa.int64()), "lo": pa.array(x.min(axis=0), pa.int64()),
                "hi": pa.array(x.max(axis=0), pa.int64())})

    rows = (fit.mapInArrow(sums, "d int, n long, s long, lo long, hi long").groupBy("d")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("lo").alias("lo"),
                 F.max("hi").alias("hi")).orderBy("d").collect())                    # one row a dimension
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows], [r["lo"] for r in rows], [r["hi"] for r in rows]


def cross_products(fit: DataFrame, dims: int, low, bits):
    """Exact sums of products of the shifted dimensions over all rows: a full matrix of Python integers."""
    import numpy as np

    def products(batches):
        import numpy as np
        counts = dim = bit = None
        for b in slices(batches, BLOCK_CELLS, dims):
            y = unpacked(b.column(0), dims) + OFFSET - np.array(low)
            words, dim, bit = bit_planes(y, bits)
            found = plane_counts(words)
            counts = found if counts is None else counts + found
        if counts is not None:
            total = weighted(counts, dim, bit, dims)
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                "v": pa.array([Decimal(int(total[a, b])) for a, b in zip(i, j)], pa.decimal128(38, 0))})

    out = np.zeros((dims, dims), dtype=object)
    for r in (fit.mapInArrow(products, "i int, j int, v decimal(38,0)").groupBy("i", "j")
              .agg(F.sum("v").alias("v")).collect()):                                # half a matrix
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["v"])
    return out


def _identity_error(fit: DataFrame, dims: int, low, mean, matrix, n: int) -> float:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, summed over the rows themselves."""
    import numpy as np
    live = np.flatnonzero(np.abs(matrix).max(axis=0) > 0)
    w = matrix[:, live]
    k = len(live)

    def squares(batches):
        import numpy as np
        total = None
        for b in slices(batches, BLOCK_CELLS, dims):
            z = (unpacked(b.column(0), dims) + OFFSET - np.array(low) - mean) @ w
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None and k:
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                              "v": pa.array(total.reshape(-1), pa.float64())})

    cov = np.zeros((k, k))
    for r in fit.mapInArrow(squares, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        cov[r["i"], r["j"]] = r["v"] / n
    return round(float(np.abs(cov - np.eye(k)).max()), 12) if k else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS):
    """(rows, model): a table id, deviation decimal(38,0), whitened array<double>, and a dict of the fitted numbers.

    Vectors that are null or hold null or non-finite entries are left out.  Entry
    c counts as floor(64 * c) + 1000000 (floor(64 * c) is held to +-2^30); shorter
    vectors are filled up with zeros.  The model is fitted to the distinct
    integer vectors; every row, copies included, is whitened.  Components are
    numbered by falling eigenvalue, the largest entry of each is positive, and
    there are no more than dimensions.  A component without variance (fewer
    distinct vectors than dimensions) gives 0 and stays out of the identity
    error.  An empty table gives an empty one.  ``deviation`` is null beyond 38
    digits.
    """
    import numpy as np
    v = F.col(f"`{vector}`")
    kept = df.where(finite(v)).select(F.col(f"`{id_col}`").alias("id"), v.alias("__v"))
    dims = width(kept, "__v")
    kind = kept.schema["id"].dataType.simpleString()

    def encode(batches):
        for b in slices(batches, BLOCK_CELLS, dims):
            yield pa.RecordBatch.from_arrays([b.column(0), packed(floor_matrix(b.column(1), SCALE, dims, LIMIT))],
                                             names=["id", "__x"])

    rows = materialise(kept.mapInArrow(encode, f"id {kind}, __x binary"), "whiten-rows")
    fit = materialise(rows.select("__x").distinct(), "whiten-fit")
    n, sums, low, high = _column_sums(fit, dims)
    if not n or not dims:
        empty = df.sparkSession.createDataFrame([], f"id {kind}, deviation decimal(38,0), whitened array<double>")
        return empty, {"n": n, "sums": sums, "covariance": np.zeros((dims, dims)), "values": np.zeros(0),
                       "vectors": np.zeros((dims, 0)), "explained": [], "identity_error": 0.0}
    bits = [int(h - lo).bit_length() for lo, h in zip(low, high)]
    products = cross_products(fit, dims, low, bits)
    shifted = [s - n * lo for s, lo in zip(sums, low)]
    centred = [[n * products[i, j] - shifted[i] * shifted[j] for j in range(dims)] for i in range(dims)]
    cov = np.array([[c / (n * n) for c in row] for row in centred])      # integers divided once, correctly rounded
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    live = values > max(trace, 0.0) * dims * np.finfo(float).eps
    matrix = vectors * np.where(live, 1.0 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    mean = np.array([s / n for s in shifted])
    reach = max(max(abs(n * (h - lo) - s), abs(s)) for lo, h, s in zip(low, high, shifted))
    narrow = reach * reach * dims < 1 << 63

    def apply(batches):
        import numpy as np
        base = np.array(low)
        for b in slices(batches, BLOCK_CELLS, dims):
            y = unpacked(b.column(1), dims) + OFFSET - base
            if narrow:
                d = y * n - np.array(shifted)
                far = [Decimal(int(t)) for t in (d * d).sum(axis=1)]
            else:
                sq = [sum((int(c) * n - s) ** 2 for c, s in zip(r, shifted)) for r in y]
                far = [Decimal(t) if t < 10 ** 38 else None for t in sq]
            z = (y - mean) @ matrix
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far, pa.decimal128(38, 0)),
                                              pa.array(list(z), pa.list_(pa.float64()))],
                                             names=["id", "deviation", "whitened"])

    out = rows.mapInArrow(apply, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    model = {"n": n, "sums": sums, "covariance": cov, "values": values, "vectors": vectors,
             "explained": [float(e / trace) if trace else 0.0 for e in values],
             "identity_error": _identity_error(fit, dims, low, mean, matrix, n)}
    return out, model
