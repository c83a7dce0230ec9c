"""Causal per-user window operators.

Every operator takes a log frame and returns it with new columns.  All use
``partitionBy(user_id [, key]).orderBy(timestamp, row_id)``: the first
exchange hashes on ``user_id`` and every later window (also those keyed by
``(user_id, content_id)``, ``(user_id, task)``, ``(user_id, part)``) reuses it,
so a chain of operators costs one shuffle plus local sorts.  "Prior" frames
end at row -1 and never see the current row.

Unbounded running aggregates go through ``running`` and window specs through
``w_by``: built inside ``plans.segmented.segmented_plan()`` the same operators
run per (user, segment) with halo rows and segment offsets, which keeps a user
of any size out of a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.functions.columns import EPS_GAP, safe_div
from tracefeat.plans import segmented as SG
from tracefeat.plans.ranking import global_rank
from tracefeat.plans.segmented import real, running

ORDER = ("timestamp", "row_id")
UNB = Window.unboundedPreceding


def w_by(*keys: str, order=ORDER) -> Window:
    part = [*keys, "_seg"] if SG.active() else list(keys)
    return Window.partitionBy(*part).orderBy(*order)


def w_u() -> Window:
    return w_by("user_id")


def prior() -> Window:
    return w_u().rowsBetween(UNB, -1)


def upto() -> Window:
    return w_u().rowsBetween(UNB, 0)


def last_rows(n: int, w: Window | None = None, include_current: bool = False) -> Window:
    return (w or w_u()).rowsBetween(-n, 0 if include_current else -1)


def is_question() -> Column:
    return F.col("content_type_id") == 0


# W1 ------------------------------------------------------------------------
def user_running(df: DataFrame, target: str = "answered_correctly") -> DataFrame:
    """Prior sum of the target (lecture -1 included), prior row count, their ratio."""
    df = running(df, {"_s": F.col(target), "_c": F.lit(1)})
    df = df.withColumns({"prior_correct_sum": F.coalesce(F.col("_s"), F.lit(0)),
                         "prior_count": F.coalesce(F.col("_c"), F.lit(0))}).drop("_s", "_c")
    return df.withColumn("prior_correct_rate", safe_div("prior_correct_sum", "prior_count"))


# W2 / W2b / W24 --------------------------------------------------------------
def attempt_count(df: DataFrame, key: str = "content_id", name: str = "attempt",
                  base: int = 1) -> DataFrame:
    """n-th meeting of (user, key); ``base=1`` counts from 1, ``base=0`` from 0."""
    return running(df, {name: F.lit(1)}, ("user_id", key), inclusive=True).withColumn(
        name, F.col(name) - 1 + base)


def cumcount(df: DataFrame) -> DataFrame:
    """0-based position in the user and in the (user, task)."""
    df = running(df, {"user_cumcount": F.lit(1)}, ("user_id",), inclusive=True)
    df = running(df, {"task_cumcount": F.lit(1)}, ("user_id", "task_container_id"), inclusive=True)
    return df.withColumns({"user_cumcount": F.col("user_cumcount") - 1, "task_cumcount": F.col("task_cumcount") - 1})


# W3 ------------------------------------------------------------------------
def equal_prior_item(df: DataFrame, key: str = "content_id", name: str = "same_as_prior_item") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.lag(key).over(w_u()) == F.col(key), F.lit(False)).cast("int"))


# W4 / W4b / W4c --------------------------------------------------------------
def rolling_prior_mean(df: DataFrame, windows=(3, 5, 7), target: str = "answered_correctly") -> DataFrame:
    """Mean of the previous w targets; NULL unless w previous rows exist."""
    cols = {}
    for w in windows:
        fr = last_rows(w)
        cols[f"{target}_rolling{w}"] = F.when(F.count(F.lit(1)).over(fr) == w, F.sum(target).over(fr) / w)
    return df.withColumns(cols)


def rolling_prior_mean_padded(df: DataFrame, k: int = 3, target: str = "answered_correctly") -> DataFrame:
    """Mean of the last k flags ``target == 1`` with zero padding (lectures count 0)."""
    flag = (F.col(target) == 1).cast("int")
    return df.withColumn(f"correct_last{k}_padded", F.coalesce(F.sum(flag).over(last_rows(k)), F.lit(0)) / k)


def rolling_ratios(df: DataFrame, ks=(3, 5, 7, 9), target: str = "answered_correctly") -> DataFrame:
    """Latest-k zero-padded rates and their ratios (+1e-3 in the denominator)."""
    flag = (F.col(target) == 1).cast("int")
    df = df.withColumns({f"acr{k}": F.coalesce(F.sum(flag).over(last_rows(k)), F.lit(0)) / k for k in ks})
    pairs = [(3, 9), (5, 9), (7, 9), (3, 5), (5, 7), (3, 7)]
    return df.withColumns({f"acr{a}_div_acr{b}": F.col(f"acr{a}") / (F.col(f"acr{b}") + EPS_GAP)
                           for a, b in pairs if a in ks and b in ks})


# W5 / W5b / W5c / W13 -------------------------------------------------------
def time_diffs(df: DataFrame, lags=(1, 2, 3, 4, 5)) -> DataFrame:
    """timestamp - lag k (NULL when short) and all ratios diff_i / (diff_j + 1e-3), i < j."""
    df = df.withColumns({f"timestamp_diff{k}": F.col("timestamp") - F.lag("timestamp", k).over(w_u()) for k in lags})
    ratios = {}
    for i, a in enumerate(lags):
        for b in lags[i + 1:]:
            ratios[f"timestamp_diff{a}_div_timestamp_diff{b}"] = (
                F.col(f"timestamp_diff{a}") / (F.col(f"timestamp_diff{b}") + EPS_GAP))
    return df.withColumns(ratios)


def time_diffs_padded(df: DataFrame, lags=(1, 2, 3, 4, 5)) -> DataFrame:
    """timestamp - lag k, with 0 for missing history (the raw timestamp)."""
    return df.withColumns({f"timestamp_diff{k}_padded":
                           F.col("timestamp") - F.coalesce(F.lag("timestamp", k).over(w_u()), F.lit(0))
                           for k in lags})


def prior_gap(df: DataFrame) -> DataFrame:
    """The previous row's gap (diff(1).shift(1))."""
    return df.withColumn("timestamp_lag_shift1",
                         F.lag("timestamp", 1).over(w_u()) - F.lag("timestamp", 2).over(w_u()))


def with_gap(df: DataFrame, name: str = "gap") -> DataFrame:
    return df.withColumn(name, F.col("timestamp") - F.lag("timestamp").over(w_u()))


# W6 ------------------------------------------------------------------------
def rolling_over_gap(df: DataFrame, windows=(3, 5, 7), target: str = "answered_correctly") -> DataFrame:
    """W4 / log1p(gap); a zero gap gives NULL instead of +-inf."""
    df = rolling_prior_mean(with_gap(df, "_gap"), windows, target)
    df = df.withColumns({f"{target}_rolling{w}_div_elapsed_from_prior":
                         F.try_divide(F.col(f"{target}_rolling{w}"), F.log1p("_gap")) for w in windows})
    return df.drop("_gap", *[f"{target}_rolling{w}" for w in windows])


# W7 / W7b ------------------------------------------------------------------
def seq_to_decimal(df: DataFrame, windows=(3, 5, 7), target: str = "answered_correctly") -> DataFrame:
    """sum_k lag_k * 10^-(k-1), k = 1..w; NULL when fewer than w previous rows."""
    cols = {}
    for w in windows:
        terms = [F.lag(target, k).over(w_u()) * (10.0 ** -(k - 1)) for k in range(1, w + 1)]
        e = terms[0]
        for t in terms[1:]:
            e = e + t
        cols[f"seq2dec_w{w}"] = e
    return df.withColumns(cols)


def seq_to_decimal_padded(df: DataFrame, windows=(5, 7), target: str = "answered_correctly") -> DataFrame:
    """Same with missing history as 0 and the flag ``target == 1``."""
    flag = (F.col(target) == 1).cast("int")
    cols = {}
    for w in windows:
        e = F.lit(0.0)
        for k in range(1, w + 1):
            e = e + F.coalesce(F.lag(flag, k).over(w_u()), F.lit(0)) * (10.0 ** -(k - 1))
        cols[f"seq2dec_w{w}_padded"] = e
    return df.withColumns(cols)


# W8 / W9 / W10 ---------------------------------------------------------------
def gap_vs_user(df: DataFrame) -> DataFrame:
    """Gap against the user's whole-history mean and median gap (uses the future by design)."""
    df = with_gap(df, "_gap")
    if SG.active():
        # whole-history statistics as aggregates: sums combine partially, the
        # median comes from distributed ranks, so no user is held by one task
        st = (df.filter(~F.col("_halo")).groupBy("user_id")
              .agg((F.sum("_gap") / F.count("_gap")).alias("timestamp_lag_mean")))
        med = SG.whole_group_median(df, "_gap", ("user_id",), "timestamp_lag_median")
        df = df.join(st, "user_id", "left").join(med, "user_id", "left")
    else:
        whole = Window.partitionBy("user_id")
        df = df.withColumns({"timestamp_lag_mean": F.sum("_gap").over(whole) / F.count("_gap").over(whole),
                             "timestamp_lag_median": F.median("_gap").over(whole)})
    return df.withColumns({
        "timestamp_lag_diff_mean_each_user": F.col("_gap") - F.col("timestamp_lag_mean"),
        "timestamp_lag_div_mean_each_user": F.col("_gap") / (F.col("timestamp_lag_mean") + EPS_GAP),
        "timestamp_lag_diff_median_each_user": F.col("_gap") - F.col("timestamp_lag_median"),
        "timestamp_lag_div_median_each_user": F.col("_gap") / (F.col("timestamp_lag_median") + EPS_GAP),
    }).drop("_gap")


def gap_vs_rolling(df: DataFrame, windows=(3, 5, 7)) -> DataFrame:
    """Gap - mean of the previous w gaps; W10: gap - median of the last w+1 gaps (incl. this)."""
    df = with_gap(df, "_gap")
    cols = {}
    for w in windows:
        prev = last_rows(w)
        incl = w_u().rowsBetween(-w, 0)
        cols[f"timestamp_lag_diff_rolling{w}_mean_each_user"] = F.when(
            F.count("_gap").over(prev) == w, F.col("_gap") - F.sum("_gap").over(prev) / w)
        cols[f"timestamp_lag_diff_rolling{w}_median_each_user"] = F.when(
            F.count("_gap").over(incl) == w + 1, F.col("_gap") - F.percentile("_gap", 0.5).over(incl))
    return df.withColumns(cols).drop("_gap")


# W11 -----------------------------------------------------------------------
def abs_change(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "content_id_diff_abs": F.abs(F.col("content_id") - F.lag("content_id").over(w_u())),
        "task_container_id_diff_abs": F.abs(F.col("task_container_id") - F.lag("task_container_id").over(w_u())),
    })


# W12 -----------------------------------------------------------------------
def order_in_task(df: DataFrame) -> DataFrame:
    """Rank of content_id inside (user, task), ties by row_id, and rank / size.

    In segmented form rank and size come from the distributed rank of the real
    rows, so neither a user nor one of its tasks has to fit a window group."""
    keys = ["user_id", "task_container_id"]
    if SG.active():
        rows = df.filter(~F.col("_halo")).select(*keys, "content_id", "row_id")
        r = global_rank(rows, ["content_id", "row_id"], partition_cols=keys, name="_order", total_name="_size")
        df = df.join(r.select("row_id", "_order", "_size"), "row_id", "left")
    else:
        wt = Window.partitionBy(*keys)
        one = F.lit(1)
        df = df.withColumns({"_order": F.count(one).over(wt.orderBy("content_id", "row_id").rowsBetween(UNB, 0)),
                             "_size": F.count(one).over(wt)})
    return df.withColumns({
        "order_content_id_by_task_container_id": F.col("_order"),
        "order_content_id_div_max_by_task_container_id": F.col("_order") / F.col("_size"),
    }).drop("_order", "_size")


# W14 -----------------------------------------------------------------------
def since_last_incorrect(df: DataFrame) -> DataFrame:
    """timestamp - time of the last prior incorrect answer (0 when none)."""
    df = running(df, {"_t": F.when(F.col("answered_correctly") == 0, F.col("timestamp"))}, fn="max")
    return df.withColumn("since_last_incorrect", F.col("timestamp") - F.coalesce(F.col("_t"), F.lit(0))).drop("_t")


# W15 -----------------------------------------------------------------------
def task_nunique(df: DataFrame, windows=(5, 10)) -> DataFrame:
    return df.withColumns({f"u_hist_task_nunique{n}": F.size(F.collect_set("task_container_id").over(last_rows(n)))
                           for n in windows})


# W16 -----------------------------------------------------------------------
def part_share(df: DataFrame) -> DataFrame:
    df = running(df, {"_c2": (F.col("part") == 2).cast("int"), "_c5": (F.col("part") == 5).cast("int"),
                      "_n": F.lit(1)}, inclusive=True)
    df = df.withColumns({"count_part2": F.coalesce(F.col("_c2"), F.lit(0)),
                         "count_part5": F.coalesce(F.col("_c5"), F.lit(0))}).drop("_c2", "_c5")
    return df.withColumns({
        "rate_part2": F.col("count_part2") / F.col("_n"),
        "rate_part5": F.col("count_part5") / F.col("_n"),
        "rate_part2_5": (F.col("count_part2") + F.col("count_part5")) / F.col("_n"),
    }).drop("_n")


# W17 -----------------------------------------------------------------------
def gap_median_100(df: DataFrame, n: int = 100) -> DataFrame:
    """Median of the gaps among the previous n rows (n-1 gaps); this gap / and - it."""
    df = with_gap(df, "_gap")
    med = F.percentile("_gap", 0.5).over(w_u().rowsBetween(-(n - 1), -1))
    df = df.withColumn("user_difftime_median100", med)
    return df.withColumns({
        "user_difftime_div_median100": F.try_divide(F.col("_gap").cast("double"), F.col("user_difftime_median100")),
        "user_difftime_diff_median100": F.col("_gap") - F.col("user_difftime_median100"),
    }).drop("_gap")


# W18 -----------------------------------------------------------------------
def run_length(df: DataFrame, key: str = "part", name: str = "user_part_continous_count") -> DataFrame:
    """Length so far of the current run of equal ``key`` (gaps and islands); NULL key -> 1."""
    def flags(d: DataFrame) -> DataFrame:
        same = F.coalesce(F.lag(key).over(w_u()) == F.col(key), F.lit(False))
        d = d.withColumn("_chg", ~same)
        # the row's position in the user's history
        return d.withColumn("_p", F.col("_pos")) if SG.active() else running(d, {"_p": F.lit(1)}, inclusive=True)

    df = flags(df)
    df = running(df, {"_start": F.when(F.col("_chg"), F.col("_p"))}, inclusive=True, fn="max", prep=flags)
    return df.withColumn(name, F.col("_p") - F.col("_start") + 1).drop("_chg", "_p", "_start")


# W19 -----------------------------------------------------------------------
def same_part_recent(df: DataFrame, windows=(10, 20, 30), key: str = "part") -> DataFrame:
    return df.withColumns({
        f"user_part_count{n}": F.size(F.filter(F.collect_list(key).over(last_rows(n)), lambda x: x == F.col(key)))
        for n in windows})


# W20 -----------------------------------------------------------------------
def class_repeat(df: DataFrame, class_col: str = "content_class_id") -> DataFrame:
    """W2 and W3 applied to an item class column."""
    df = attempt_count(df, class_col, f"attempt_{class_col}")
    return equal_prior_item(df, class_col, f"same_as_prior_{class_col}")


# W21 -----------------------------------------------------------------------
def current_counters(df: DataFrame) -> DataFrame:
    """log1p of prior correct / incorrect counts over question rows, overall and per part.

    Lecture rows get 0 and do not move the counters.  The windows are keyed by
    ``(user, content_type_id)`` so lecture rows fall into their own partition.
    """
    q = is_question()
    corr = F.col("answered_correctly")
    df = running(df, {"log_prior_correct": corr, "log_prior_incorrect": 1 - corr},
                 ("user_id", "content_type_id"))
    df = running(df, {"log_prior_correct_part": corr, "log_prior_incorrect_part": 1 - corr},
                 ("user_id", "content_type_id", "part"))
    names = ["log_prior_correct", "log_prior_incorrect", "log_prior_correct_part", "log_prior_incorrect_part"]
    return df.withColumns({k: F.when(q, F.log1p(F.coalesce(F.col(k), F.lit(0)))).otherwise(F.lit(0.0))
                           for k in names})


# W22 -----------------------------------------------------------------------
def history_window(df: DataFrame, n: int = 5, n_parts: int = 7) -> DataFrame:
    """Last n question rows: part codes and correctness (-1 padded on the left), and
    the n x (n_parts + 1) one-hot tensor flattened row-major (padding -> zeros,
    last slot the correctness, -1 for padding).  Lecture rows get empty history."""
    wq = w_by("user_id", "content_type_id").rowsBetween(-n, -1)
    parts = F.collect_list(F.coalesce(F.col("part"), F.lit(-1))).over(wq)
    corr = F.collect_list("answered_correctly").over(wq)
    pad = lambda a: F.concat(F.array_repeat(F.lit(-1), F.lit(n) - F.size(a)), a)
    df = df.withColumns({"hist_parts": F.when(is_question(), pad(parts)).otherwise(F.array_repeat(F.lit(-1), n)),
                         "hist_correct": F.when(is_question(), pad(corr)).otherwise(F.array_repeat(F.lit(-1), n))})
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    one_hot = F.flatten(F.transform(idx, lambda i: F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(n_parts)),
                    lambda p: (F.element_at("hist_parts", i + 1) == p).cast("int")),
        F.array(F.element_at("hist_correct", i + 1)))))
    return df.withColumn("hist_tensor", one_hot)


# W23 -----------------------------------------------------------------------
def task_gated_running(df: DataFrame, target: str = "answered_correctly") -> DataFrame:
    """Running sum / count advanced only by the first row of each new task."""
    def first(d: DataFrame) -> DataFrame:
        f = F.coalesce(F.lag("task_container_id").over(w_u()) != F.col("task_container_id"), F.lit(True))
        return d.withColumn("_first", f.cast("int"))

    df = first(df)
    df = running(df, {"answered_correctly_sum_user": F.col("_first") * F.col(target), "count_user": F.col("_first")},
                 prep=first)
    df = running(df, {"attempt_content": F.col("_first")}, ("user_id", "content_id"), prep=first)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0))
                         for c in ("answered_correctly_sum_user", "count_user", "attempt_content")})
    return df.withColumn("answered_correctly_avg_user",
                         F.col("answered_correctly_sum_user") / (F.col("count_user") + EPS_GAP)).drop("_first")


# W25 -----------------------------------------------------------------------
def _change(d: DataFrame) -> DataFrame:
    c = F.coalesce(F.lag("task_container_id").over(w_u()) != F.col("task_container_id"), F.lit(False))
    return d.withColumn("_chg", c.cast("int"))


def _grouped(d: DataFrame) -> DataFrame:
    return running(_change(d), {"group_num": F.col("_chg")}, inclusive=True, prep=_change)


def _placed(df: DataFrame) -> DataFrame:
    """``group_num`` (task changes so far) and ``user_task_count`` (rows of the group in front of this one)."""
    df = running(_grouped(df).drop("_chg"), {"user_task_count": F.lit(1)}, ("user_id", "group_num"), inclusive=True,
                 prep=_grouped)
    return df.withColumn("user_task_count", F.col("user_task_count") - 1)


def _answer_parts(placed: DataFrame, part_rows: int) -> DataFrame:
    rows = placed.filter(~F.col("_halo")) if SG.active() else placed
    part = F.floor(F.col("user_task_count") / part_rows).cast("long")
    cells = rows.groupBy("user_id", "group_num", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("user_task_count", "answered_correctly"))).alias("_g"))
    return cells.select("user_id", "group_num", "part",
                        F.transform("_g", lambda s: s["answered_correctly"]).alias("answers"))


def group_answer_parts(df: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """(user_id, group_num, part, answers): the answers of every group in order, ``part_rows`` a row at most.

    Places in the group come from running counts that carry over segments, so
    in segmented form a group of any size is spread over tasks and rows.  A
    table of its own: there are no halo copies to drop."""
    return _answer_parts(_placed(df), part_rows)


def group_number(df: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Task-change counter within the user, the previous group's answers, position in group.

    The list of a group is put together from its numbered parts, so only whole
    parts meet, in order; the list itself is one cell by what the column is."""
    df = _placed(df)
    parts = _answer_parts(df, part_rows)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "answers"))), lambda s: s["answers"]))
    groups = parts.groupBy("user_id", "group_num").agg(whole.alias("prior_group_answers_correct"))
    groups = groups.withColumn("group_num", F.col("group_num") + 1)
    return df.join(groups, ["user_id", "group_num"], "left")
