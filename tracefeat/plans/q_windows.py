"""Registered queries for the window operators W1-W25 with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import windows as W
from tracefeat.plans import segmented as SG
from tracefeat.plans.registry import REGISTRY, register
from tracefeat.sources.binding import interaction_log, question_log

WU = "PARTITION BY user_id ORDER BY timestamp, row_id"


def _fr(a, b, w=WU):
    lo = "UNBOUNDED PRECEDING" if a is None else f"{a} PRECEDING"
    hi = "CURRENT ROW" if b == 0 else f"{b} PRECEDING"
    return f"OVER ({w} ROWS BETWEEN {lo} AND {hi})"


PRIOR = _fr(None, 1)


def _log(spark, d):
    return SG.segmented_input(interaction_log(spark, d))


def _qlog(spark, d):
    return SG.segmented_input(question_log(spark, d))


@register("W1_user_running", "row_id:i, prior_correct_sum:i, prior_count:i, prior_correct_rate:f", f"""
SELECT row_id, coalesce(sum(answered_correctly) {PRIOR}, 0) AS prior_correct_sum,
       count(*) {PRIOR} AS prior_count,
       sum(answered_correctly) {PRIOR} / nullif(count(*) {PRIOR}, 0) AS prior_correct_rate
FROM log""")
def q_w1(spark, d):
    """Prior running sum, count and rate of answered_correctly per user."""
    return W.user_running(_log(spark, d))


@register("W2_attempt_count", "row_id:i, attempt:i, attempt_prior:i, attempt_bin_prior:i", """
SELECT row_id,
  row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id) AS attempt,
  row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id) - 1 AS attempt_prior,
  row_number() OVER (PARTITION BY user_id, content_id // 30 ORDER BY timestamp, row_id) - 1 AS attempt_bin_prior
FROM log""")
def q_w2(spark, d):
    """N-th meeting of (user, item) from 1 and from 0; by item bin of 30."""
    df = _log(spark, d).withColumn("content_bin", (F.col("content_id") / 30).cast("int"))
    df = W.attempt_count(df, "content_id", "attempt", 1)
    df = W.attempt_count(df, "content_id", "attempt_prior", 0)
    df = W.attempt_count(df, "content_bin", "attempt_bin_prior", 0)
    return df


@register("W3_equal_prior_item", "row_id:i, same_as_prior_item:i", f"""
SELECT row_id, CAST(coalesce(lag(content_id) OVER ({WU}) = content_id, false) AS INTEGER) AS same_as_prior_item
FROM log""")
def q_w3(spark, d):
    return W.equal_prior_item(_log(spark, d))


@register("W4_rolling_prior_mean",
          "row_id:i, answered_correctly_rolling3:f, answered_correctly_rolling5:f, answered_correctly_rolling7:f",
          "SELECT row_id, " + ", ".join(
              f"CASE WHEN count(*) {_fr(w, 1)} = {w} THEN sum(answered_correctly) {_fr(w, 1)} / {w} END "
              f"AS answered_correctly_rolling{w}" for w in (3, 5, 7)) + " FROM log")
def q_w4(spark, d):
    return W.rolling_prior_mean(_log(spark, d))


@register("W4b_rolling_prior_mean_padded", "row_id:i, correct_last3_padded:f", f"""
SELECT row_id, coalesce(sum(CAST(answered_correctly = 1 AS INTEGER)) {_fr(3, 1)}, 0) / 3 AS correct_last3_padded
FROM log""")
def q_w4b(spark, d):
    return W.rolling_prior_mean_padded(_log(spark, d))


_W4C_PAIRS = [(3, 9), (5, 9), (7, 9), (3, 5), (5, 7), (3, 7)]


@register("W4c_rolling_ratios",
          "row_id:i, " + ", ".join(f"acr{k}:f" for k in (3, 5, 7, 9)) + ", "
          + ", ".join(f"acr{a}_div_acr{b}:f" for a, b in _W4C_PAIRS),
          "WITH r AS (SELECT row_id, " + ", ".join(
              f"coalesce(sum(CAST(answered_correctly = 1 AS INTEGER)) {_fr(k, 1)}, 0) / {k} AS acr{k}"
              for k in (3, 5, 7, 9)) + " FROM log) SELECT *, " + ", ".join(
              f"acr{a} / (acr{b} + 0.001) AS acr{a}_div_acr{b}" for a, b in _W4C_PAIRS) + " FROM r")
def q_w4c(spark, d):
    return W.rolling_ratios(_log(spark, d))


_LAGS = (1, 2, 3, 4, 5)
_LAG_PAIRS = [(a, b) for i, a in enumerate(_LAGS) for b in _LAGS[i + 1:]]


@register("W5_time_diffs",
          "row_id:i, " + ", ".join(f"timestamp_diff{k}:i" for k in _LAGS) + ", "
          + ", ".join(f"timestamp_diff{a}_div_timestamp_diff{b}:f" for a, b in _LAG_PAIRS),
          "WITH t AS (SELECT row_id, " + ", ".join(
              f"timestamp - lag(timestamp, {k}) OVER ({WU}) AS timestamp_diff{k}" for k in _LAGS)
          + " FROM log) SELECT *, " + ", ".join(
              f"timestamp_diff{a} / (timestamp_diff{b} + 0.001) AS timestamp_diff{a}_div_timestamp_diff{b}"
              for a, b in _LAG_PAIRS) + " FROM t")
def q_w5(spark, d):
    """Time since the k-th previous row and their ratios."""
    return W.time_diffs(_log(spark, d))


@register("W5c_time_diffs_padded", "row_id:i, " + ", ".join(f"timestamp_diff{k}_padded:i" for k in _LAGS),
          "SELECT row_id, " + ", ".join(
              f"timestamp - coalesce(lag(timestamp, {k}) OVER ({WU}), 0) AS timestamp_diff{k}_padded"
              for k in _LAGS) + " FROM log")
def q_w5c(spark, d):
    return W.time_diffs_padded(_log(spark, d))


@register("W6_rolling_over_gap",
          "row_id:i, " + ", ".join(f"answered_correctly_rolling{w}_div_elapsed_from_prior:f" for w in (3, 5, 7)),
          f"WITH t AS (SELECT *, timestamp - lag(timestamp) OVER ({WU}) AS gap FROM log) SELECT row_id, "
          + ", ".join(f"CASE WHEN count(*) {_fr(w, 1)} = {w} THEN sum(answered_correctly) {_fr(w, 1)} / {w} END "
                      f"/ nullif(ln(1 + gap), 0) AS answered_correctly_rolling{w}_div_elapsed_from_prior"
                      for w in (3, 5, 7)) + " FROM t")
def q_w6(spark, d):
    return W.rolling_over_gap(_log(spark, d))


def _seq2dec_sql(w, padded):
    terms = []
    for k in range(1, w + 1):
        v = f"lag(answered_correctly, {k}) OVER ({WU})"
        if padded:
            v = f"coalesce(lag(CAST(answered_correctly = 1 AS INTEGER), {k}) OVER ({WU}), 0)"
        terms.append(f"{v} * {10.0 ** -(k - 1)!r}")
    name = f"seq2dec_w{w}_padded" if padded else f"seq2dec_w{w}"
    return " + ".join(terms) + f" AS {name}"


@register("W7_seq_to_decimal", "row_id:i, seq2dec_w3:f, seq2dec_w5:f, seq2dec_w7:f",
          "SELECT row_id, " + ", ".join(_seq2dec_sql(w, False) for w in (3, 5, 7)) + " FROM log")
def q_w7(spark, d):
    return W.seq_to_decimal(_log(spark, d))


@register("W7b_seq_to_decimal_padded", "row_id:i, seq2dec_w5_padded:f, seq2dec_w7_padded:f",
          "SELECT row_id, " + ", ".join(_seq2dec_sql(w, True) for w in (5, 7)) + " FROM log")
def q_w7b(spark, d):
    return W.seq_to_decimal_padded(_log(spark, d))


@register("W8_gap_vs_user",
          "row_id:i, timestamp_lag_mean:f2, timestamp_lag_median:f2, timestamp_lag_diff_mean_each_user:f2, "
          "timestamp_lag_div_mean_each_user:f, timestamp_lag_diff_median_each_user:f2, "
          "timestamp_lag_div_median_each_user:f", f"""
WITH g AS (SELECT *, timestamp - lag(timestamp) OVER ({WU}) AS gap FROM log),
m AS (SELECT *, sum(gap) OVER (PARTITION BY user_id) / count(gap) OVER (PARTITION BY user_id) AS timestamp_lag_mean,
             quantile_cont(gap, 0.5) OVER (PARTITION BY user_id) AS timestamp_lag_median FROM g)
SELECT row_id, timestamp_lag_mean, timestamp_lag_median,
  gap - timestamp_lag_mean AS timestamp_lag_diff_mean_each_user,
  gap / (timestamp_lag_mean + 0.001) AS timestamp_lag_div_mean_each_user,
  gap - timestamp_lag_median AS timestamp_lag_diff_median_each_user,
  gap / (timestamp_lag_median + 0.001) AS timestamp_lag_div_median_each_user
FROM m""")
def q_w8(spark, d):
    """User mean / median gap over the whole history (leaks the future by design)."""
    return W.gap_vs_user(_log(spark, d))


@register("W9_W10_gap_vs_rolling",
          "row_id:i, " + ", ".join(f"timestamp_lag_diff_rolling{w}_mean_each_user:f2, "
                                   f"timestamp_lag_diff_rolling{w}_median_each_user:f2" for w in (3, 5, 7)),
          f"WITH g AS (SELECT *, timestamp - lag(timestamp) OVER ({WU}) AS gap FROM log) SELECT row_id, "
          + ", ".join(
              f"CASE WHEN count(gap) {_fr(w, 1)} = {w} THEN gap - sum(gap) {_fr(w, 1)} / {w} END "
              f"AS timestamp_lag_diff_rolling{w}_mean_each_user, "
              f"CASE WHEN count(gap) {_fr(w, 0)} = {w + 1} THEN gap - quantile_cont(gap, 0.5) {_fr(w, 0)} END "
              f"AS timestamp_lag_diff_rolling{w}_median_each_user" for w in (3, 5, 7)) + " FROM g")
def q_w9(spark, d):
    return W.gap_vs_rolling(_log(spark, d))


@register("W11_abs_change", "row_id:i, content_id_diff_abs:i, task_container_id_diff_abs:i", f"""
SELECT row_id, abs(content_id - lag(content_id) OVER ({WU})) AS content_id_diff_abs,
       abs(task_container_id - lag(task_container_id) OVER ({WU})) AS task_container_id_diff_abs
FROM log""")
def q_w11(spark, d):
    return W.abs_change(_log(spark, d))


@register("W12_order_in_task",
          "row_id:i, order_content_id_by_task_container_id:i, order_content_id_div_max_by_task_container_id:f", """
SELECT row_id,
  row_number() OVER (PARTITION BY user_id, task_container_id ORDER BY content_id, row_id)
    AS order_content_id_by_task_container_id,
  row_number() OVER (PARTITION BY user_id, task_container_id ORDER BY content_id, row_id)
    / count(*) OVER (PARTITION BY user_id, task_container_id) AS order_content_id_div_max_by_task_container_id
FROM log""")
def q_w12(spark, d):
    return W.order_in_task(_log(spark, d))


@register("W13_prior_gap", "row_id:i, timestamp_lag_shift1:i", f"""
SELECT row_id, lag(timestamp, 1) OVER ({WU}) - lag(timestamp, 2) OVER ({WU}) AS timestamp_lag_shift1 FROM log""")
def q_w13(spark, d):
    return W.prior_gap(_log(spark, d))


@register("W14_since_last_incorrect", "row_id:i, since_last_incorrect:i", f"""
SELECT row_id, timestamp - coalesce(last(CASE WHEN answered_correctly = 0 THEN timestamp END IGNORE NULLS)
  {PRIOR}, 0) AS since_last_incorrect FROM log""")
def q_w14(spark, d):
    return W.since_last_incorrect(_log(spark, d))


@register("W15_task_nunique", "row_id:i, u_hist_task_nunique5:i, u_hist_task_nunique10:i",
          "SELECT row_id, " + ", ".join(
              f"count(DISTINCT task_container_id) {_fr(n, 1)} AS u_hist_task_nunique{n}" for n in (5, 10))
          + " FROM log")
def q_w15(spark, d):
    return W.task_nunique(_log(spark, d))


@register("W16_part_share", "row_id:i, count_part2:i, count_part5:i, rate_part2:f, rate_part5:f, rate_part2_5:f", f"""
WITH c AS (SELECT row_id,
  coalesce(sum(CAST(part = 2 AS INTEGER)) {_fr(None, 0)}, 0) AS count_part2,
  coalesce(sum(CAST(part = 5 AS INTEGER)) {_fr(None, 0)}, 0) AS count_part5,
  row_number() OVER ({WU}) AS n FROM qlog)
SELECT row_id, count_part2, count_part5, count_part2 / n AS rate_part2, count_part5 / n AS rate_part5,
  (count_part2 + count_part5) / n AS rate_part2_5 FROM c""")
def q_w16(spark, d):
    return W.part_share(_qlog(spark, d))


@register("W17_gap_median_100",
          "row_id:i, user_difftime_median100:f2, user_difftime_div_median100:f, user_difftime_diff_median100:f2", f"""
WITH g AS (SELECT *, timestamp - lag(timestamp) OVER ({WU}) AS gap FROM log),
m AS (SELECT row_id, gap, quantile_cont(gap, 0.5) {_fr(99, 1)} AS med FROM g)
SELECT row_id, med AS user_difftime_median100, gap / nullif(med, 0) AS user_difftime_div_median100,
       gap - med AS user_difftime_diff_median100 FROM m""")
def q_w17(spark, d):
    return W.gap_median_100(_log(spark, d))


@register("W18_run_length", "row_id:i, user_part_continous_count:i", f"""
WITH f AS (SELECT *, CASE WHEN coalesce(lag(part) OVER ({WU}) = part, false) THEN 0 ELSE 1 END AS chg FROM qlog),
i AS (SELECT *, sum(chg) {_fr(None, 0)} AS island FROM f)
SELECT row_id, row_number() OVER (PARTITION BY user_id, island ORDER BY timestamp, row_id)
  AS user_part_continous_count FROM i""")
def q_w18(spark, d):
    return W.run_length(_qlog(spark, d))


@register("W19_same_part_recent", "row_id:i, user_part_count10:i, user_part_count20:i, user_part_count30:i",
          "SELECT row_id, " + ", ".join(
              f"coalesce(len(list_filter(list(part) {_fr(n, 1)}, lambda p: p = part)), 0) AS user_part_count{n}"
              for n in (10, 20, 30)) + " FROM qlog")
def q_w19(spark, d):
    return W.same_part_recent(_qlog(spark, d))


@register("W20_class_repeat", "row_id:i, attempt_content_class_id:i, same_as_prior_content_class_id:i", f"""
WITH c AS (SELECT *, part AS content_class_id FROM qlog)
SELECT row_id,
  row_number() OVER (PARTITION BY user_id, content_class_id ORDER BY timestamp, row_id) AS attempt_content_class_id,
  CAST(coalesce(lag(content_class_id) OVER ({WU}) = content_class_id, false) AS INTEGER)
    AS same_as_prior_content_class_id
FROM c""")
def q_w20(spark, d):
    """W2/W3 on an item class; the class here is the question's part."""
    return W.class_repeat(_qlog(spark, d).withColumn("content_class_id", F.col("part")))


_WQ = "PARTITION BY user_id, content_type_id ORDER BY timestamp, row_id"
_WQP = "PARTITION BY user_id, content_type_id, part ORDER BY timestamp, row_id"


@register("W21_current_counters",
          "row_id:i, log_prior_correct:f, log_prior_incorrect:f, log_prior_correct_part:f, log_prior_incorrect_part:f",
          "SELECT row_id, " + ", ".join(
              f"CASE WHEN content_type_id = 0 THEN ln(1 + coalesce(sum({e}) {_fr(None, 1, w)}, 0)) ELSE 0 END AS {n}"
              for n, e, w in [("log_prior_correct", "answered_correctly", _WQ),
                              ("log_prior_incorrect", "1 - answered_correctly", _WQ),
                              ("log_prior_correct_part", "answered_correctly", _WQP),
                              ("log_prior_incorrect_part", "1 - answered_correctly", _WQP)]) + " FROM qlog")
def q_w21(spark, d):
    return W.current_counters(_qlog(spark, d))


@register("W22_history_window", "row_id:i, hist_parts:ai, hist_correct:ai, hist_tensor:ai", f"""
WITH h AS (SELECT row_id, content_type_id,
    coalesce(list(coalesce(part, -1)) {_fr(5, 1, _WQ)}, []) AS p,
    coalesce(list(answered_correctly) {_fr(5, 1, _WQ)}, []) AS c FROM qlog),
pad AS (SELECT row_id,
    CASE WHEN content_type_id = 0 THEN list_concat(list_transform(range(5 - len(p)), lambda x: -1), p)
         ELSE [-1, -1, -1, -1, -1] END AS hist_parts,
    CASE WHEN content_type_id = 0 THEN list_concat(list_transform(range(5 - len(c)), lambda x: -1), c)
         ELSE [-1, -1, -1, -1, -1] END AS hist_correct FROM h)
SELECT row_id, hist_parts, hist_correct,
  flatten(list_transform(range(5), lambda i: list_concat(
      list_transform(range(1, 8), lambda q: CAST(hist_parts[i + 1] = q AS INTEGER)), [hist_correct[i + 1]])))
    AS hist_tensor
FROM pad""")
def q_w22(spark, d):
    return W.history_window(_qlog(spark, d))


@register("W23_task_gated_running",
          "row_id:i, answered_correctly_sum_user:i, count_user:i, attempt_content:i, answered_correctly_avg_user:f", f"""
WITH f AS (SELECT *, CAST(coalesce(lag(task_container_id) OVER ({WU}) <> task_container_id, true) AS INTEGER) AS fst
           FROM log),
s AS (SELECT row_id, coalesce(sum(fst * answered_correctly) {PRIOR}, 0) AS answered_correctly_sum_user,
        coalesce(sum(fst) {PRIOR}, 0) AS count_user,
        coalesce(sum(fst) {_fr(None, 1, 'PARTITION BY user_id, content_id ORDER BY timestamp, row_id')}, 0)
          AS attempt_content FROM f)
SELECT *, answered_correctly_sum_user / (count_user + 0.001) AS answered_correctly_avg_user FROM s""")
def q_w23(spark, d):
    return W.task_gated_running(_log(spark, d))


@register("W24_cumcount", "row_id:i, user_cumcount:i, task_cumcount:i", f"""
SELECT row_id, row_number() OVER ({WU}) - 1 AS user_cumcount,
  row_number() OVER (PARTITION BY user_id, task_container_id ORDER BY timestamp, row_id) - 1 AS task_cumcount
FROM log""")
def q_w24(spark, d):
    return W.cumcount(_log(spark, d))


@register("W25_group_number", "row_id:i, group_num:i, prior_group_answers_correct:ai, user_task_count:i", f"""
WITH c0 AS (SELECT *, CAST(coalesce(lag(task_container_id) OVER ({WU}) <> task_container_id, false) AS INTEGER)
             AS chg FROM log),
c AS (SELECT *, sum(chg) {_fr(None, 0)} AS group_num FROM c0),
g AS (SELECT user_id, group_num + 1 AS group_num,
             list(answered_correctly ORDER BY timestamp, row_id) AS prior_group_answers_correct
      FROM c GROUP BY user_id, group_num)
SELECT c.row_id, c.group_num, g.prior_group_answers_correct,
  row_number() OVER (PARTITION BY c.user_id, c.group_num ORDER BY c.timestamp, c.row_id) - 1 AS user_task_count
FROM c LEFT JOIN g ON c.user_id = g.user_id AND c.group_num = g.group_num""")
def q_w25(spark, d):
    return W.group_number(_log(spark, d))


# Answers of a part on the fixture: groups of more rows have several.
PART_ANSWERS = 2


@register("W25b_group_answer_parts", "user_id:i, group_num:i, part:i, answers:ai", f"""
WITH c0 AS (SELECT *, CAST(coalesce(lag(task_container_id) OVER ({WU}) <> task_container_id, false) AS INTEGER)
             AS chg FROM log),
c1 AS (SELECT *, sum(chg) {_fr(None, 0)} AS group_num FROM c0),
c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, group_num ORDER BY timestamp, row_id) - 1)
             // {PART_ANSWERS} AS part FROM c1)
SELECT user_id, group_num, part, list(answered_correctly ORDER BY timestamp, row_id) AS answers
FROM c GROUP BY user_id, group_num, part""")
def q_w25b(spark, d):
    """The answers of every task group in numbered parts; the log is cut into segments."""
    with SG.segmented_plan(TWIN_SEG, TWIN_HALO):
        return W.group_answer_parts(_log(spark, d), PART_ANSWERS)


@register("F0_flagship",
          "row_id:i, user_id:i, prior_correct_sum:i, prior_count:i, prior_correct_rate:f, "
          "answered_correctly_rolling3:f, answered_correctly_rolling5:f, answered_correctly_rolling7:f, "
          "timestamp_diff1:i, timestamp_diff2:i, timestamp_diff3:i, timestamp_diff4:i, timestamp_diff5:i",
          f"""
SELECT row_id, user_id, coalesce(sum(answered_correctly) {PRIOR}, 0) AS prior_correct_sum,
  count(*) {PRIOR} AS prior_count,
  sum(answered_correctly) {PRIOR} / nullif(count(*) {PRIOR}, 0) AS prior_correct_rate, """
          + ", ".join(f"CASE WHEN count(*) {_fr(w, 1)} = {w} THEN sum(answered_correctly) {_fr(w, 1)} / {w} END "
                      f"AS answered_correctly_rolling{w}" for w in (3, 5, 7)) + ", "
          + ", ".join(f"timestamp - lag(timestamp, {k}) OVER ({WU}) AS timestamp_diff{k}" for k in _LAGS)
          + " FROM log")
def q_flagship(spark, d):
    """W1 + W4 + W5 in one pass: one exchange on user_id, one sort."""
    df = _log(spark, d)
    df = W.user_running(df)
    df = W.rolling_prior_mean(df)
    return W.time_diffs(df, _LAGS)


def _register_skew_safe():
    f0 = REGISTRY["F0_flagship"]

    def q_f1(spark, d):
        """F0 computed with skew-safe segments (16 rows per segment, 8-row halo on the
        fixture so that every user is cut into several segments)."""
        return SG.flagship(interaction_log(spark, d), seg_rows=16, halo=8)
    register("F1_flagship_skew_safe", ", ".join(f"{n}:{k}" for n, k in f0.spec), f0.sql)(q_f1)


_register_skew_safe()


# Rows of a segment and of its halo for the segmented twins: every fixture user is cut into two segments or more.
TWIN_SEG, TWIN_HALO = 40, 32
TWIN_SIZES = {"W17": (104, 104)}        # looks back 100 rows, so its halo is longer
OWN_FORM = ("W25b",)                    # segmented already, with rows of its own


def _register_twins():
    for name, q in list(REGISTRY.items()):
        number = name.split("_")[0]
        if name.startswith("W") and number not in OWN_FORM:
            def twin(spark, d, build=q.build, sizes=TWIN_SIZES.get(number, (TWIN_SEG, TWIN_HALO))):
                """The query on users cut into segments: the same result."""
                with SG.segmented_plan(*sizes):
                    return SG.finish(build(spark, d))
            register(f"{name}_segmented", ", ".join(f"{n}:{k}" for n, k in q.spec), q.sql)(twin)


_register_twins()
