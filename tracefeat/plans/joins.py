"""Join helpers: broadcast only behind a size check, shuffle join beyond it.

Two checks are used:

* ``dim_join(..., max_rows=N)`` - for dimension tables read from files
  (questions, lectures): a bounded ``limit(N + 1).count()`` proves the row
  count before the broadcast hint is given; beyond it the join shuffles.
* ``dim_join(...)`` without ``max_rows`` - for tables derived in the same plan
  (encoders, per-key aggregates): no hint; Catalyst broadcasts only when the
  plan statistics are under ``spark.sql.autoBroadcastJoinThreshold``, and AQE
  re-plans to a broadcast only when the materialised shuffle is under its
  threshold.  Counting such a table up front would compute it twice.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension up to this many rows is shipped to every task (a few MB at most).
MAX_BROADCAST_ROWS = 1_000_000

# frame -> verdict, for as long as the frame lives; a new frame over the same files is counted again.
_checked: weakref.WeakKeyDictionary[DataFrame, bool] = weakref.WeakKeyDictionary()


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows of ``df`` (a bounded job) to prove its size."""
    if df not in _checked:
        _checked[df] = df.limit(max_rows + 1).count() <= max_rows
    return _checked[df]


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "left", max_rows: int | None = None) -> DataFrame:
    """Join a fact table to a dimension or a derived lookup table (see module doc)."""
    if max_rows is not None and fits_broadcast(dim, max_rows):
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)
