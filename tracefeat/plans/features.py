"""Compose many per-user operators into one lazy plan.

All window operators are keyed by ``user_id`` (optionally with a second key),
so after the first exchange every later window reuses the same hash
partitioning: the composed plan has one shuffle of the log plus local sorts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tracefeat.operators import windows as W
from tracefeat.plans import segmented as SG

WINDOW_OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "W1": W.user_running,
    "W2": W.attempt_count,
    "W3": W.equal_prior_item,
    "W4": W.rolling_prior_mean,
    "W4b": W.rolling_prior_mean_padded,
    "W4c": W.rolling_ratios,
    "W5": W.time_diffs,
    "W5c": W.time_diffs_padded,
    "W6": W.rolling_over_gap,
    "W7": W.seq_to_decimal,
    "W7b": W.seq_to_decimal_padded,
    "W8": W.gap_vs_user,
    "W9": W.gap_vs_rolling,
    "W11": W.abs_change,
    "W12": W.order_in_task,
    "W13": W.prior_gap,
    "W14": W.since_last_incorrect,
    "W15": W.task_nunique,
    "W16": W.part_share,
    "W17": W.gap_median_100,
    "W18": W.run_length,
    "W19": W.same_part_recent,
    "W21": W.current_counters,
    "W22": W.history_window,
    "W23": W.task_gated_running,
    "W24": W.cumcount,
}


# Rows of history each operator looks back through a bounded frame (the halo
# of the segmented form must cover them); operators not listed use running
# aggregates only.
LOOKBACK = {"W3": 1, "W4": 7, "W4b": 3, "W4c": 9, "W5": 5, "W5c": 5, "W6": 7, "W7": 7, "W7b": 7, "W9": 9,
            "W11": 1, "W13": 2, "W15": 10, "W17": 100, "W18": 1, "W19": 30, "W22": 5, "W23": 1, "W25": 1}


def features(df: DataFrame, names=None, skew_safe: bool = False, seg_rows: int = SG.SEG_ROWS,
             halo: int = SG.HALO, prefix: str = "") -> DataFrame:
    """Apply the named window operators (all by default) in one plan.

    ``skew_safe=True`` builds them in segmented form (users cut into segments of
    ``seg_rows`` rows with a ``halo`` of history): the same values, for logs
    where one user may outgrow a task.  The caller decides; nothing switches
    by the size of the data.

    ``prefix`` is put before the names of the new columns, so that features of
    another source (the task-deduplicated log) can stand beside these."""
    names, source = list(names or WINDOW_OPERATORS), df.columns

    def named(out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed({c: prefix + c for c in out.columns if c not in source}) if prefix else out

    if not skew_safe:
        for n in names:
            df = WINDOW_OPERATORS[n](df)
        return named(df)
    need = max([LOOKBACK.get(n, 0) for n in names] + [0])
    if need > halo:
        raise ValueError(f"operators look back {need} rows; the halo holds {halo}")
    with SG.segmented_plan():
        s = SG.segment(df, seg_rows=seg_rows, halo=halo)
        for n in names:
            s = WINDOW_OPERATORS[n](s)
        return named(SG.finish(s))
