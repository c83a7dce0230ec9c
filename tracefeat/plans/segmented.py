"""Skew-safe per-user windows: a user's history is cut into segments of a fixed
number of rows, so that no task holds more than one segment of any user,
however large that user is.

1. Each row gets its 1-based position in its user's history from
   ``global_rank`` (sorted ranges; no per-user task).
2. ``seg = (pos - 1) // seg_rows``.  Every segment receives copies, flagged
   ``_halo``, of the ``halo`` rows in front of it, and of the ``halo`` rows of
   each content type in front of it, however many segments back those lie
   (found by their rank within the type, so sparse types are exact too).
3. The frame is repartitioned by ``(user, seg)`` and checkpointed, so that every
   running aggregate reads it instead of ranking again.  Windows partitioned by
   ``(user, [key,] seg)`` see at least ``halo`` earlier rows for every real row:
   lags and rolling frames up to ``halo`` rows are exact, per content type too.
4. Running (unbounded) aggregates are local aggregates over real rows plus the
   aggregate of the same group's earlier segments (``running``).
5. Halo copies are dropped at the end (``finish``).

Operators ask for their windows and running aggregates through ``w_by`` /
``running`` in ``operators.windows``; inside ``segmented_plan()`` those add the
segment key and the offsets.  Outside it they are the plain per-user windows.
"""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.plans.ranking import global_rank
from tracefeat.session import cut_lineage

ORDER = ("timestamp", "row_id")
SEG_ROWS = 1_000_000
HALO = 128
UNB = Window.unboundedPreceding

_ACTIVE = contextvars.ContextVar("tracefeat_segmented", default=False)
_BASE = contextvars.ContextVar("tracefeat_segmented_base", default=None)


def active() -> bool:
    return bool(_ACTIVE.get())


@contextlib.contextmanager
def segmented_plan(seg_rows: int = SEG_ROWS, halo: int = HALO):
    """Build operators in segmented form inside this block; ``segmented_input`` cuts by these sizes."""
    tok = _ACTIVE.set((seg_rows, halo))
    try:
        yield
    finally:
        _ACTIVE.reset(tok)


def segmented_input(df: DataFrame) -> DataFrame:
    """``df`` cut into segments inside ``segmented_plan``, else as it is."""
    return segment(df, seg_rows=_ACTIVE.get()[0], halo=_ACTIVE.get()[1]) if active() else df


def segment(df: DataFrame, key: str = "user_id", seg_rows: int = SEG_ROWS, halo: int = HALO,
            kind_col: str | None = "content_type_id", n_parts: int | None = None) -> DataFrame:
    if halo > seg_rows:
        raise ValueError("halo must not exceed seg_rows")
    r = global_rank(df, list(ORDER), partition_cols=[key], name="_pos", total_name="_total")
    r = r.withColumn("_seg", F.floor((F.col("_pos") - 1) / seg_rows).cast("long"))
    nxt = F.col("_seg") + 1
    copies = (r.filter((F.col("_pos") > nxt * seg_rows - halo) & (F.col("_total") > nxt * seg_rows))
              .withColumn("_seg", nxt))
    if kind_col:
        copies = copies.unionByName(_far_of_kind(r, key, kind_col, seg_rows, halo))
    out = r.withColumn("_halo", F.lit(False)).unionByName(copies.withColumn("_halo", F.lit(True))).drop("_total")
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(n, key, "_seg")
    if active():
        out = cut_lineage(out)
        _BASE.set(out)
    return out


def _far_of_kind(r: DataFrame, key: str, kind: str, seg_rows: int, halo: int) -> DataFrame:
    """Copies, for every segment, of the last ``halo`` rows of each kind in front of it
    that are not among the last ``halo`` rows of any kind (at most ``halo`` per segment and kind).
    Only users longer than a segment take part."""
    big = r.filter(F.col("_total") > seg_rows)
    per = big.groupBy(key, kind, "_seg").agg(F.count(F.lit(1)).alias("_c"))
    grid = big.groupBy(key, kind).agg(F.max("_total").alias("_t")).select(
        key, kind, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t") - 1) / seg_rows).cast("long")))
        .alias("_seg"))
    before = Window.partitionBy(key, kind).orderBy("_seg").rowsBetween(UNB, -1)
    start = (grid.join(per, [key, kind, "_seg"], "left")
             .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)).cast("long")).drop("_c"))
    place = F.row_number().over(Window.partitionBy(key, kind, "_seg").orderBy(*ORDER))
    ranked = big.join(start, [key, kind, "_seg"]).withColumn("_kr", F.col("_before") + place).drop("_before")
    wanted = start.filter("_before > 0").select(
        key, kind, F.col("_seg").alias("_to"),
        F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_before") - halo + 1), F.col("_before"))).alias("_kr"))
    far = ranked.join(wanted, [key, kind, "_kr"])
    near = (F.col("_to") == F.col("_seg") + 1) & (F.col("_pos") > F.col("_to") * seg_rows - halo)
    return far.filter(~near).withColumn("_seg", F.col("_to")).select(*r.columns)


def real(c) -> Column:
    """``c`` on real rows, NULL on halo copies (so they add nothing to aggregates)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.col("_halo"), c) if active() else c


def running(df: DataFrame, exprs: dict[str, Column], keys=("user_id",), inclusive: bool = False,
            fn: str = "sum", prep=None) -> DataFrame:
    """Running ``sum`` / ``max`` of each expression over the group's earlier rows
    (and the current one when ``inclusive``), in (timestamp, row_id) order.
    NULL when no row contributes, as a window aggregate over an empty frame.

    In segmented form the segment totals are aggregated from the segmented base
    frame (``prep(base)`` adds the derived columns the expressions need), not
    from ``df``: every running step then refers to the shared base once, and
    the plan grows linearly with the number of operators."""
    keys = list(keys)
    agg = F.sum if fn == "sum" else F.max
    hi = 0 if inclusive else -1
    if not active():
        w = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(UNB, hi)
        return df.withColumns({n: agg(e).over(w) for n, e in exprs.items()})
    w = Window.partitionBy(*keys, "_seg").orderBy(*ORDER).rowsBetween(UNB, hi)
    df = df.withColumns({f"_loc_{n}": agg(real(e)).over(w) for n, e in exprs.items()})
    base = _BASE.get()
    src = base if base is not None else df
    if prep is None and not set(keys) <= set(src.columns):
        src = df                                    # the key was derived after segmenting
    if prep is not None:
        src = prep(src)
    tot = src.filter(~F.col("_halo")).groupBy(*keys, "_seg").agg(*[agg(e).alias(f"_t_{n}") for n, e in exprs.items()])
    wo = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(UNB, -1)
    offs = (tot.select(*keys, "_seg", *[agg(f"_t_{n}").over(wo).alias(f"_o_{n}") for n in exprs])
            .filter(F.col("_seg") > 0))
    same = [*keys, "_seg"]                          # null keys are a group, as in a window
    offs = offs.select(*[F.col(k).alias(f"_k_{k}") for k in same], *[f"_o_{n}" for n in exprs])
    on = F.lit(True)
    for k in same:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    df = df.join(offs, on, "left").drop(*[f"_k_{k}" for k in same])
    if fn == "sum":
        comb = {n: F.when(F.col(f"_loc_{n}").isNull() & F.col(f"_o_{n}").isNull(), F.lit(None))
                .otherwise(F.coalesce(F.col(f"_loc_{n}"), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
                for n in exprs}
    else:
        comb = {n: F.greatest(F.col(f"_loc_{n}"), F.col(f"_o_{n}")) for n in exprs}
    return df.withColumns(comb).drop(*[f"_loc_{n}" for n in exprs], *[f"_o_{n}" for n in exprs])


def finish(df: DataFrame) -> DataFrame:
    _BASE.set(None)
    return df.filter(~F.col("_halo")).drop("_halo", "_seg", "_pos")


def whole_group_median(df: DataFrame, value: str, keys=("user_id",), name: str = "median") -> DataFrame:
    """Exact median per group from distributed ranks (no group buffered in one task):
    the mean of the values at the middle position(s)."""
    keys = list(keys)
    g = df.filter(F.col(value).isNotNull() & (~F.col("_halo") if active() else F.lit(True)))
    ties = ["row_id"] if "row_id" in df.columns else []          # spreads a value that many rows share
    g = g.select(*keys, F.col(value).alias("_v"), *ties)
    r = global_rank(g, ["_v", *ties], partition_cols=keys, name="_r", total_name="_cnt")
    mid = r.filter((F.col("_r") == F.floor((F.col("_cnt") + 1) / 2))
                   | (F.col("_r") == F.ceil((F.col("_cnt") + 1) / 2)))
    return mid.groupBy(*keys).agg(F.avg("_v").alias(name))


def flagship(df: DataFrame, seg_rows: int = SEG_ROWS, halo: int = HALO) -> DataFrame:
    """W1 + W4 + W5 in skew-safe form (same values as the per-user windows)."""
    from tracefeat.operators import windows as W
    with segmented_plan():
        s = segment(df, seg_rows=seg_rows, halo=halo)
        s = W.time_diffs(W.rolling_prior_mean(W.user_running(s)), (1, 2, 3, 4, 5))
        return finish(s)
