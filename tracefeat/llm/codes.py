"""Vector codes: integer parts assigned to codebook entries through per-dimension value dictionaries.

For a block of vectors every dimension is dictionary coded: its distinct
integers, sorted, and each vector's place among them.  The squared differences
of every distinct integer to that dimension in all entries are tabulated once,
and the distance of a part to all entries is a gather of table rows by code and
an addition over the part's dimensions.  Dictionaries belong to blocks of a
bounded number of cells, so they stay small whatever values the table holds.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise
from tracefeat.llm.vectors import finite, floor_matrix, packed, slices, unpacked, width

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
BLOCK_CELLS = 1 << 18        # numbers of a block: 4096 vectors of 64 dimensions
SALTS = 32                   # a label's rows are joined to its total in this many groups


def assign(x, books):
    """(index of the nearest entry per part, its squared distance per part) of every row; ties to the lower index.

    ``x`` is an integer matrix (rows, dimensions), ``books`` an integer array
    (parts, entries, dimensions of a part).
    """
    import numpy as np
    parts, entries, step = books.shape
    index = np.zeros((len(x), parts), dtype=np.int64)
    cost = np.zeros((len(x), parts), dtype=np.int64)
    for p in range(parts):
        total = np.zeros((len(x), entries), dtype=np.int64)
        for q in range(step):
            values, code = np.unique(x[:, p * step + q], return_inverse=True)
            table = values[:, None] - books[p, :, q][None, :]
            total += np.take(table * table, code, axis=0)
        index[:, p] = total.argmin(axis=1)
        cost[:, p] = total[np.arange(len(x)), index[:, p]]
    return index, cost


def _refined(vectors: DataFrame, books, dims: int):
    """One round: assign every part and replace each used entry by the componentwise floor of its parts' mean."""
    import numpy as np
    parts, entries, step = books.shape

    def sums(batches):
        import numpy as np
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, step), dtype=object)
        for b in slices(batches, BLOCK_CELLS, dims):
            x = unpacked(b.column(0), dims)
            index, _ = assign(x, books)
            for p in range(parts):
                count[p] += np.bincount(index[:, p], minlength=entries)
                part = np.zeros((entries, step), dtype=np.int64)
                np.add.at(part, index[:, p], x[:, p * step:(p + 1) * step])
                total[p] += part
        p, e = np.nonzero(count)
        if len(p):
            rows = [(int(i), int(j), q, int(count[i, j]), int(total[i, j, q])) for i, j in zip(p, e) for q in range(step)]
            yield pa.RecordBatch.from_pydict({
                "p": pa.array([r[0] for r in rows], pa.int32()), "e": pa.array([r[1] for r in rows], pa.int32()),
                "q": pa.array([r[2] for r in rows], pa.int32()), "n": pa.array([r[3] for r in rows], pa.int64()),
                "s": pa.array([r[4] for r in rows], pa.int64())})

    new = books.copy()
    for r in (vectors.select("__x").mapInArrow(sums, "p int, e int, q int, n long, s long")
              .groupBy("p", "e", "q").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
              .collect()):                                       # parts x entries x step rows at most
        new[r["p"], r["e"], r["q"]] = int(r["s"]) // r["n"]
    return np.ascontiguousarray(new)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(coded rows, codebooks): a table id, label, code, error, label_error and the final entries.

    Vectors that are null or hold null or non-finite components are left out.
    Component x counts as floor(256 * x), held to a range in which squared
    distances fit a long (2^27 for 64 dimensions).  Shorter vectors are filled up
    with zeros to the longest one, and all to a multiple of ``parts``.  The
    codebooks start as the parts of the ``entries`` smallest ids (null ids last,
    equal ids by vector) and are numpy arrays (parts, entries, step).  Repeated
    ids are rows of their own.  An empty table gives an empty one and empty
    codebooks.  ``label_error`` sums the error over equal labels, nulls together.
    """
    import numpy as np
    v = F.col(f"`{vector}`")
    kept = df.where(finite(v)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"),
                                      v.alias("__v"))
    dims = -(-width(kept, "__v") // parts) * parts
    limit = math.isqrt((1 << 62) // max(dims, 1)) // 2
    step = dims // parts
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def encode(batches):
        for b in slices(batches, BLOCK_CELLS, dims):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(
                floor_matrix(b.column(2), SCALE, dims, limit))], names=["id", "label", "__x"])

    vectors = materialise(kept.mapInArrow(encode, f"id {types['id']}, label {types['label']}, __x binary"), "codes-vectors")
    seed = vectors.orderBy(F.col("id").asc_nulls_last(), "__x").limit(entries).select("__x").collect()
    start = np.array([np.frombuffer(r["__x"], "<i4") for r in seed], dtype=np.int64).reshape(len(seed), parts, step)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if len(seed):
        for _ in range(rounds):
            books = _refined(vectors, books, dims)

    def code(batches):
        import numpy as np
        for b in slices(batches, BLOCK_CELLS, dims):
            index, cost = assign(unpacked(b.column(2), dims), books)
            wide = 2 if books.shape[1] <= 256 else 4
            text = [bytes(r).hex() for r in index.astype(">u1" if wide == 2 else ">u2").view(np.uint8).reshape(len(index), -1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                                              pa.array(cost.sum(axis=1), pa.int64())],
                                             names=["id", "label", "code", "error"])

    coded = materialise(vectors.mapInArrow(
        code, f"id {types['id']}, label {types['label']}, code string, error long"), "codes")
    # a label may hold a third of all rows: totals are pre-aggregated, then met by salted groups of rows
    totals = coded.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error")) \
        .withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    out = coded.withColumn("__t", salt).join(
        totals, F.col("label").eqNullSafe(F.col("__l")) & (F.col("__t") == F.col("__s"))).drop("__t", "__l", "__s")
    return out, books


def codebooks_sha256(books) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def decode(books, code: str):
    """The integer vector that a code stands for."""
    import numpy as np
    wide = 2 if books.shape[1] <= 256 else 4
    return np.concatenate([books[p, int(code[p * wide:(p + 1) * wide], 16)] for p in range(books.shape[0])])
