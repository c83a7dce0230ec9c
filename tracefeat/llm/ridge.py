"""Partition-summed normal equations, shared by the two kernel models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PARTITIONS = 32          # the (bounded) training sample is fitted in this many pieces


def normal_equations(sample: DataFrame, features, n_features: int, n_targets: int):
    """(Z'Z, Z'T) over all rows of ``sample``; numpy arrays on the driver.

    ``features(batch) -> (Z, T)`` turns an Arrow batch into double matrices.
    Every partition adds up its own products and sends one row per matrix row;
    the sums of those rows are summed again per matrix row, so what reaches the
    driver is one matrix whatever the number of rows.
    """
    import numpy as np

    width = n_features + n_targets

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((n_features, width))
        seen = False
        for b in batches:
            if b.num_rows:
                z, t = features(b)
                total += z.T @ np.concatenate([z, t], axis=1)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(n_features), pa.int32()),
                                              "v": pa.array(list(total), pa.list_(pa.float64()))})

    def summed(table):
        import numpy as np
        import pyarrow as pa
        col = table.column("v").combine_chunks()
        v = col.flatten().to_numpy().reshape(len(col), -1).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    rows = (sample.repartition(FIT_PARTITIONS).mapInArrow(partial, "i int, v array<double>")
            .groupBy("i").applyInArrow(summed, "i int, v array<double>").collect())
    total = np.zeros((n_features, width))
    for r in rows:
        total[r["i"]] = r["v"]
    return total[:, :n_features], total[:, n_features:]


def share_below(key, share):
    """Deterministic sample: rows whose 30-bit content key falls under ``share`` of its range."""
    return F.pmod(key, F.lit(1 << 30)) < share * float(1 << 30)
