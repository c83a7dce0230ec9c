"""Distributed global ranking and prefix sums without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Instead the rows are range-partitioned and sorted on the full key (group, order
columns), written to the shared folder with their range number and their place
in the range, and a small table of per-range totals gives every range (and
group) its offset.  Spark samples the range bounds from the whole key, whatever
its type, so neither a tie on the first column nor a string key gathers rows in
one task, and the number of ranges is the number of shuffle partitions.  The
checkpoint fixes which row is in which range for every later branch of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.plans.joins import dim_join
from tracefeat.session import cut_lineage

UNB = Window.unboundedPreceding


def _ordered(cols, descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def sorted_ranges(df: DataFrame, order_cols, partition_cols=(), descending: bool = False,
                  n_parts: int | None = None) -> DataFrame:
    """``df`` with ``_bk`` (range number) and ``_at`` (increasing place within the range)."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*[F.col(c).asc() for c in partition_cols], *_ordered(order_cols, descending)]
    s = df.repartitionByRange(n, *key).sortWithinPartitions(*key)
    return cut_lineage(s.withColumns({"_bk": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def _attach_offsets(local: DataFrame, offs: DataFrame, partition_cols) -> DataFrame:
    """Without group columns the offsets table has one row per range (at most the
    shuffle-partition count): broadcast by construction.  With group columns its
    size follows their cardinality, so the planner decides."""
    if not partition_cols:
        return dim_join(local, F.broadcast(offs), ["_bk"], "inner")
    same = ["_bk", *partition_cols]                 # a null group is a group, as in a window
    offs = offs.withColumnsRenamed({c: f"_k_{c}" for c in same})
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return dim_join(local, offs, on, "inner").drop(*[f"_k_{c}" for c in same])


def global_rank(df: DataFrame, order_cols, partition_cols=(), descending: bool = False,
                name: str = "rank", total_name: str | None = None, n_parts: int | None = None) -> DataFrame:
    """Add a 1-based position ``name`` in the order ``order_cols`` (unique keys
    expected; end the key with row_id), per ``partition_cols`` group; optionally
    the group size as ``total_name``."""
    if total_name in ("_n", "_bk", "_off", "_at", "_first"):
        raise ValueError("reserved column name")
    partition_cols, order_cols = list(partition_cols), list(order_cols)
    r = sorted_ranges(df, order_cols, partition_cols, descending, n_parts)
    counts = r.groupBy("_bk", *partition_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    groups = Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy(F.lit(0))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(groups.orderBy("_bk").rowsBetween(UNB, -1)), F.lit(0)))
    if total_name:
        offs = offs.withColumn(total_name, F.sum("_n").over(groups))
    out = _attach_offsets(r, offs.drop("_n"), partition_cols)
    return out.withColumn(name, F.col("_off") + F.col("_at") - F.col("_first") + 1).drop("_bk", "_off", "_at", "_first")


def global_cumsum(df: DataFrame, order_col: str, value_cols, partition_cols=(), n_parts: int | None = None,
                  prefix: str = "cum_") -> DataFrame:
    """Exclusive running sums of ``value_cols`` in ``order_col`` order (per
    ``partition_cols`` group); ``order_col`` must be unique within a group."""
    partition_cols, value_cols = list(partition_cols), list(value_cols)
    r = sorted_ranges(df, [order_col], partition_cols, n_parts=n_parts)
    tot = r.groupBy("_bk", *partition_cols).agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w = (Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy(F.lit(0))).orderBy("_bk")
    offs = tot.select("_bk", *partition_cols, *[
        F.coalesce(F.sum(f"_t_{v}").over(w.rowsBetween(UNB, -1)), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    wl = Window.partitionBy("_bk", *partition_cols).orderBy("_at").rowsBetween(UNB, -1)
    local = r.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(wl), F.lit(0)) for v in value_cols})
    out = _attach_offsets(local, offs, partition_cols)
    return out.withColumns({f"{prefix}{v}": F.col(f"_o_{v}") + F.col(f"_l_{v}") for v in value_cols}).drop(
        "_bk", "_at", *[f"_o_{v}" for v in value_cols], *[f"_l_{v}" for v in value_cols])
