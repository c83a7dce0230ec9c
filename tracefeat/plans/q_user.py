"""Registered queries for the user-state features U1-U14 (question rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import splits as V
from tracefeat.operators import user_state as U
from tracefeat.plans import segmented as SG
from tracefeat.plans.registry import REGISTRY, register
from tracefeat.sources.binding import interaction_log, question_log

WU = "PARTITION BY user_id ORDER BY timestamp, row_id"
WQ = "PARTITION BY user_id, content_type_id ORDER BY timestamp, row_id"
WQP = f"{WQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SESSION_MS = 43_200_000   # fixture threshold (12 h); the operator default is the reference's 600,000

UB = """
ub AS (SELECT *, coalesce(prior_question_elapsed_time, -1) AS et,
         CAST(coalesce(prior_question_had_explanation, false) AS INTEGER) AS hexp, answered_correctly AS ans,
         row_number() OVER (PARTITION BY user_id ORDER BY timestamp, row_id) AS seq FROM qlog),
mn AS (SELECT avg(answered_correctly) AS train_mn FROM log WHERE content_type_id = 0)"""


def _base(spark, d):
    log = U.prepare(question_log(spark, d))
    mean = log.filter(U.is_q()).agg(F.avg("ans")).scalar()
    return U.with_seq(SG.segmented_input(log)), mean


def _q(sql_select):
    return f"WITH {UB},\nf AS ({sql_select})\nSELECT * FROM f WHERE content_type_id = 0"


@register("U1_U2_counts", "row_id:i, u_cnt:i, u_corr_cnt:i, u_corr_rate:f, u_corr_rate_smooth:f, u_hade_cnt:i, "
          "u_hade_corr_cnt:i, u_hade_corr_rate:f, u_hade_rate:f, u_hade_div_corr_cnt:f", _q(f"""
SELECT row_id, content_type_id, u_cnt, u_corr_cnt, u_corr_cnt / nullif(u_cnt, 0) AS u_corr_rate,
  (u_cnt * (u_corr_cnt / nullif(u_cnt, 0)) + 5 * (SELECT train_mn FROM mn)) / (u_cnt + 5) AS u_corr_rate_smooth,
  u_hade_cnt, u_hade_corr_cnt, u_hade_corr_cnt / nullif(u_hade_cnt, 0) AS u_hade_corr_rate,
  u_hade_cnt / nullif(u_cnt, 0) AS u_hade_rate, u_hade_cnt / nullif(u_corr_cnt, 0) AS u_hade_div_corr_cnt
FROM (SELECT row_id, content_type_id, count(*) OVER ({WQP}) AS u_cnt, coalesce(sum(ans) OVER ({WQP}), 0) AS u_corr_cnt,
        coalesce(sum(hexp) OVER ({WQP}), 0) AS u_hade_cnt, coalesce(sum(hexp * ans) OVER ({WQP}), 0) AS u_hade_corr_cnt
      FROM ub)"""))
def q_u1(spark, d):
    """Prior question counts, correct counts, smoothed rate and explanation counters."""
    df, mean = _base(spark, d)
    return U.questions_only(U.counts(df, mean))


_U3_K = (3, 5, 10, 30, 100)


@register("U3_latest_k_rate", "row_id:i, u_latest1_corr_rate:f, " + ", ".join(f"u_latest{k}_corr_rate:f" for k in _U3_K),
          _q(f"SELECT row_id, content_type_id, coalesce(lag(ans) OVER ({WQ}), 0) AS u_latest1_corr_rate, " + ", ".join(
              f"avg(ans) OVER ({WQ} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS u_latest{k}_corr_rate"
              for k in _U3_K) + " FROM ub"))
def q_u3(spark, d):
    df, _ = _base(spark, d)
    return U.questions_only(U.latest_k_rate(df))


_U5_SPEC = ("row_id:i, u_hist_ques_num:i, u_hist_ques_ansed:i, u_hist_part_num:i, u_hist_part_corr_num:i, "
            "u_hist_part_num_corr_rate:f, " + ", ".join(f"u_part_{p}_cnt:i, u_part_{p}_corr_rate:f" for p in range(1, 8)))
_WQPP = "PARTITION BY user_id, content_type_id, part ORDER BY timestamp, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@register("U4_U5_item_part_history", _U5_SPEC, _q(f"""
SELECT row_id, content_type_id,
  row_number() OVER (PARTITION BY user_id, content_type_id, content_id ORDER BY timestamp, row_id) - 1 AS u_hist_ques_num,
  CAST(row_number() OVER (PARTITION BY user_id, content_type_id, content_id ORDER BY timestamp, row_id) > 1 AS INTEGER)
    AS u_hist_ques_ansed,
  count(*) OVER ({_WQPP}) AS u_hist_part_num, coalesce(sum(ans) OVER ({_WQPP}), 0) AS u_hist_part_corr_num,
  coalesce(sum(ans) OVER ({_WQPP}), 0) / nullif(count(*) OVER ({_WQPP}), 0) AS u_hist_part_num_corr_rate, """
    + ", ".join(f"coalesce(sum(CAST(part = {p} AS INTEGER)) OVER ({WQP}), 0) AS u_part_{p}_cnt, "
                f"coalesce(sum(CAST(part = {p} AS INTEGER) * ans) OVER ({WQP}), 0) / "
                f"(coalesce(sum(CAST(part = {p} AS INTEGER)) OVER ({WQP}), 0) + 1.0) AS u_part_{p}_corr_rate"
                for p in range(1, 8)) + " FROM ub"))
def q_u4(spark, d):
    """Times this item was met before (and flag); prior count/correct for this part and for each part."""
    df, _ = _base(spark, d)
    return U.questions_only(U.item_part_history(df))


_TE_SQL = """
te AS (SELECT user_id, row_id, seq, ans, tag FROM (
        SELECT user_id, row_id, seq, ans,
          unnest(list_transform(string_split(coalesce(tags, '0'), ' '), lambda x: CAST(x AS INTEGER))) AS tag
        FROM ub WHERE content_type_id = 0) WHERE tag BETWEEN 0 AND 188)"""


@register("U6_tag_history", "row_id:i, u_hist_tag_num:i, u_hist_tag_corr_num:i, u_hist_tag_corr_rate_max:f, "
          "u_hist_tag_corr_rate_min:f, u_hist_tag_corr_rate_mn:f, u_hist_tag_num_corr_rate:f", f"""
WITH {UB}, {_TE_SQL},
tw AS (SELECT row_id, count(*) OVER w AS n, coalesce(sum(ans) OVER w, 0) AS c FROM te
       WINDOW w AS (PARTITION BY user_id, tag ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT row_id, sum(n) AS u_hist_tag_num, sum(c) AS u_hist_tag_corr_num, max(c / nullif(n, 0)) AS u_hist_tag_corr_rate_max,
  min(c / nullif(n, 0)) AS u_hist_tag_corr_rate_min, avg(c / nullif(n, 0)) AS u_hist_tag_corr_rate_mn,
  sum(c) / nullif(sum(n), 0) AS u_hist_tag_num_corr_rate FROM tw GROUP BY row_id""")
def q_u6(spark, d):
    """Prior counts / correct counts of the row's tags and per-tag rate max/min/mean."""
    df, _ = _base(spark, d)
    return U.questions_only(U.tag_history(df))


@register("U7_tag_rank", "row_id:i, u_hist_tag_rank_max:i, u_hist_tag_rank_min:i, u_hist_tag_rank_sum:i", f"""
WITH {UB}, {_TE_SQL},
cum AS (SELECT DISTINCT user_id, tag, seq, count(*) OVER (PARTITION BY user_id, tag ORDER BY seq
          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM te),
qr AS (SELECT DISTINCT user_id, row_id, seq FROM te),
grid AS (SELECT qr.user_id, qr.row_id, qr.seq, CAST(t.range AS INTEGER) AS u FROM qr, range(189) t),
cu AS (SELECT g.row_id, g.u, coalesce(c.cnt, 0) AS cnt FROM grid g ASOF LEFT JOIN cum c
         ON g.user_id = c.user_id AND g.u = c.tag AND g.seq > c.seq),
rk AS (SELECT e.row_id, e.tag, sum(CASE WHEN o.cnt < me.cnt OR (o.cnt = me.cnt AND o.u < e.tag) THEN 1 ELSE 0 END)
         AS r FROM (SELECT row_id, tag, row_number() OVER () AS k FROM te) e
       JOIN cu me ON me.row_id = e.row_id AND me.u = e.tag JOIN cu o ON o.row_id = e.row_id GROUP BY e.row_id, e.tag, e.k)
SELECT row_id, max(r) AS u_hist_tag_rank_max, min(r) AS u_hist_tag_rank_min, sum(r) AS u_hist_tag_rank_sum
FROM rk GROUP BY row_id""")
def q_u7(spark, d):
    """Rank of the row's tags among the user's 189 prior tag counters (tags listed by user and count)."""
    df, _ = _base(spark, d)
    return U.questions_only(U.tag_rank(df))


@register("U8_U11_lecture_elapsed", "row_id:i, u_hist_lec_cnt:i, u_hist_et_sum_div_cnt:f, u_hist_et_sum_div_corr_cnt:f",
          _q(f"""
SELECT row_id, content_type_id,
  coalesce(sum(CAST(content_type_id = 1 AS INTEGER)) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS u_hist_lec_cnt,
  coalesce(sum(et) OVER ({WQP}), 0) / (count(*) OVER ({WQP}) + 1) AS u_hist_et_sum_div_cnt,
  coalesce(sum(et) OVER ({WQP}), 0) / (coalesce(sum(ans) OVER ({WQP}), 0) + 1) AS u_hist_et_sum_div_corr_cnt FROM ub"""))
def q_u8(spark, d):
    """Prior lectures; prior elapsed-time sum over (count + 1) and (correct + 1)."""
    df, mean = _base(spark, d)
    return U.questions_only(U.lecture_and_elapsed(U.counts(df, mean)))


_U9_COLS = (["u_prev_difftime:i"] + [f"u_prev_difftime_{k}:i" for k in (2, 3, 4, 5)]
            + ["u_prev_lagtime:f2", "u_latest5_lagtime_max:f2", "u_latest5_lagtime_mn:f2", "u_latest5_difftime_max:i",
               "u_latest5_difftime_mn:f2", "u_latest5_et_mn:f2", "u_latest10_lagtime_max:f2", "u_latest10_lagtime_mn:f2",
               "u_latest10_difftime_max:i", "u_latest10_difftime_mn:f2", "u_latest10_et_max:f2", "u_latest10_et_mn:f2",
               "u_prev_difftime_incorr:i", "u_prev_et_diff_time:f", "u_prev_et_lag_time:f", "u_prev_diff_lag_time:f",
               "u_prev_lag_diff_time:f"]
            + [f"timestamp_lag_div_rolling{k}_median_each_user:f" for k in (5, 7, 10)]
            + [f"timestamp_lag_diff_rolling{k}_median_each_user:f2" for k in (5, 7, 10)])

_L10 = f"{WU} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"


def _last5(a):
    return f"list_slice({a}, greatest(len({a}) - 4, 1), len({a}))"


@register("U9_U10_time_history", "row_id:i, " + ", ".join(_U9_COLS), f"""
WITH {UB},
h0 AS (SELECT *, coalesce(list(timestamp) OVER ({_L10}), []) AS lts, coalesce(list(et) OVER ({_L10}), []) AS lets,
  last(CASE WHEN ans = 0 AND content_type_id = 0 THEN timestamp END IGNORE NULLS) OVER ({WQP}) AS lincorr,
  quantile_cont(timestamp, 0.5) OVER ({WU} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS med5,
  quantile_cont(timestamp, 0.5) OVER ({WU} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS med7,
  quantile_cont(timestamp, 0.5) OVER ({WU} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS med10 FROM ub),
h1 AS (SELECT *, len(lts) AS m,
  list_concat([CAST(0 AS BIGINT)], list_transform(range(2, len(lts) + 1), lambda i: lts[i] - lts[i - 1])) AS d,
  list_concat([-1.0, -1.0], list_transform(range(3, len(lts) + 1),
      lambda j: CAST(lts[j - 1] - lts[j - 2] AS DOUBLE) - lets[j])) AS g,
  CASE WHEN len(list_filter(lets, lambda x: x <> -1)) > 0 THEN list_filter(lets, lambda x: x <> -1)
       ELSE [0.0] END AS e FROM h0),
h2 AS (SELECT *,
  CASE WHEN m = 0 THEN -1 ELSE timestamp - lts[m] END AS u_prev_difftime,
  CASE WHEN m = 0 THEN -1.0 WHEN m >= 2 AND d[m] <> 0 THEN d[m] - et ELSE -1.0 END AS u_prev_lagtime FROM h1),
f AS (SELECT row_id, content_type_id, u_prev_difftime, """ + ", ".join(
    f"CASE WHEN m >= {k} THEN timestamp - lts[m - {k - 1}] ELSE -1 END AS u_prev_difftime_{k}" for k in (2, 3, 4, 5))
    + f""", u_prev_lagtime,
  CASE WHEN m = 0 THEN 0.0 ELSE list_max({_last5('g')}) END AS u_latest5_lagtime_max,
  CASE WHEN m > 0 THEN list_avg({_last5('g')}) END AS u_latest5_lagtime_mn,
  CASE WHEN m = 0 THEN 0 ELSE list_max({_last5('d')}) END AS u_latest5_difftime_max,
  CASE WHEN m > 0 THEN list_avg({_last5('d')}) END AS u_latest5_difftime_mn,
  CASE WHEN m > 0 THEN list_avg({_last5('e')}) END AS u_latest5_et_mn,
  CASE WHEN m = 0 THEN 0.0 ELSE list_max(g) END AS u_latest10_lagtime_max,
  CASE WHEN m > 0 THEN list_avg(g) END AS u_latest10_lagtime_mn,
  CASE WHEN m = 0 THEN 0 ELSE list_max(d) END AS u_latest10_difftime_max,
  CASE WHEN m > 0 THEN list_avg(d) END AS u_latest10_difftime_mn,
  CASE WHEN m = 0 THEN 0.0 ELSE list_max(e) END AS u_latest10_et_max,
  CASE WHEN m > 0 THEN list_avg(e) END AS u_latest10_et_mn,
  CASE WHEN m = 0 THEN 0 ELSE timestamp - coalesce(lincorr, 0) END AS u_prev_difftime_incorr,
  CASE WHEN m > 0 THEN et / nullif(u_prev_difftime, 0) END AS u_prev_et_diff_time,
  CASE WHEN m > 0 THEN et / nullif(u_prev_lagtime, 0) END AS u_prev_et_lag_time,
  u_prev_difftime / nullif(u_prev_lagtime, 0) AS u_prev_diff_lag_time,
  u_prev_lagtime / nullif(u_prev_difftime, 0) AS u_prev_lag_diff_time, """ + ", ".join(
    f"CASE WHEN m >= {k} THEN timestamp / med{k} END AS timestamp_lag_div_rolling{k}_median_each_user, "
    f"CASE WHEN m >= {k} THEN timestamp - med{k} END AS timestamp_lag_diff_rolling{k}_median_each_user"
    for k in (5, 7, 10)) + """ FROM h2)
SELECT * FROM f WHERE content_type_id = 0""")
def q_u9(spark, d):
    """Time history over the last 10 rows of any kind: gaps, lag times, elapsed times,
    k-th previous gaps, timestamp vs rolling medians."""
    df, _ = _base(spark, d)
    return U.questions_only(U.time_history(df))


@register("U12_session_features", "row_id:i, u_session_short_cnt:i, u_cnt_in_session_short:i, u_ts_in_session_short:i, "
          "u_corr_rate_in_session_short:f, u_cnt_in_session_short_density:f", f"""
WITH {UB},
b AS (SELECT *, CAST(coalesce(timestamp - lag(timestamp) OVER ({WU}) > {SESSION_MS}, false) AS INTEGER) AS brk FROM ub),
s AS (SELECT *, coalesce(sum(brk) OVER ({WQP}), 0) AS u_session_short_cnt,
        sum(brk) OVER ({WQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid,
        coalesce(last(CASE WHEN brk = 1 THEN timestamp END IGNORE NULLS)
          OVER ({WQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sts FROM b),
f AS (SELECT row_id, content_type_id, u_session_short_cnt,
  row_number() OVER (PARTITION BY user_id, content_type_id, sid ORDER BY timestamp, row_id) - 1 AS u_cnt_in_session_short,
  timestamp - sts AS u_ts_in_session_short,
  coalesce(sum(ans) OVER (PARTITION BY user_id, content_type_id, sid ORDER BY timestamp, row_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sc FROM s)
SELECT row_id, u_session_short_cnt, u_cnt_in_session_short, u_ts_in_session_short,
  sc / nullif(u_cnt_in_session_short, 0) AS u_corr_rate_in_session_short,
  CASE WHEN u_ts_in_session_short > 0 THEN u_cnt_in_session_short / u_ts_in_session_short * 1000 ELSE 0 END
    AS u_cnt_in_session_short_density
FROM f WHERE content_type_id = 0""")
def q_u12(spark, d):
    """Sessions (gap > 12 h on the fixture) counted, timed and scored within."""
    df, _ = _base(spark, d)
    return U.questions_only(U.session_features(df, SESSION_MS))


_U13_NAMES = ["prev_part_s1xxxpart__answered_correctly_sm10",
              "prev_part_s2xxxprev_part_s1xxxpart__answered_correctly_sm10",
              "prev_part_s3xxxprev_part_s2xxxprev_part_s1xxxpart__answered_correctly_sm10"]


@register("U13_part_sequence_te", "row_id:i, " + ", ".join(f"{n}:f" for n in _U13_NAMES), f"""
WITH {UB},
p AS (SELECT *, lag(part, 1) OVER ({WQ}) AS p1, lag(part, 2) OVER ({WQ}) AS p2, lag(part, 3) OVER ({WQ}) AS p3 FROM ub),
q AS (SELECT * FROM p WHERE content_type_id = 0),
pt AS (SELECT part, (sum(ans) + 10 * (SELECT train_mn FROM mn)) / (count(ans) + 10) AS te FROM q GROUP BY part),
t1 AS (SELECT p1, part, (sum(ans) + 10 * (SELECT train_mn FROM mn)) / (count(ans) + 10) AS te FROM q
       WHERE p1 IS NOT NULL GROUP BY p1, part),
t2 AS (SELECT p2, p1, part, (sum(ans) + 10 * (SELECT train_mn FROM mn)) / (count(ans) + 10) AS te FROM q
       WHERE p2 IS NOT NULL GROUP BY p2, p1, part),
t3 AS (SELECT p3, p2, p1, part, (sum(ans) + 10 * (SELECT train_mn FROM mn)) / (count(ans) + 10) AS te FROM q
       WHERE p3 IS NOT NULL GROUP BY p3, p2, p1, part)
SELECT q.row_id, coalesce(t1.te, pt.te) AS {_U13_NAMES[0]}, coalesce(t2.te, pt.te) AS {_U13_NAMES[1]},
  coalesce(t3.te, pt.te) AS {_U13_NAMES[2]}
FROM q LEFT JOIN pt ON q.part = pt.part
LEFT JOIN t1 ON q.p1 = t1.p1 AND q.part = t1.part
LEFT JOIN t2 ON q.p2 = t2.p2 AND q.p1 = t2.p1 AND q.part = t2.part
LEFT JOIN t3 ON q.p3 = t3.p3 AND q.p2 = t3.p2 AND q.p1 = t3.p1 AND q.part = t3.part""")
def q_u13(spark, d):
    """Smoothed encodings of the last 1-3 previous parts + this part, falling back to the part's."""
    df, mean = _base(spark, d)
    return U.questions_only(U.part_sequence_te(df, mean))


_TAIL = ("(SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, "
         "row_id DESC) AS rn FROM log) WHERE rn <= 5)")


@register("U14_score_without_update", "row_id:i, u_cnt:i, u_corr_cnt:i, u_corr_rate:f, u_hist_lec_cnt:i", f"""
WITH h AS (SELECT * FROM log WHERE row_id NOT IN {_TAIL}),
st AS (SELECT user_id, count(*) FILTER (WHERE content_type_id = 0) AS u_cnt,
         coalesce(sum(answered_correctly) FILTER (WHERE content_type_id = 0), 0) AS u_corr_cnt,
         sum(CAST(content_type_id = 1 AS INTEGER)) AS u_hist_lec_cnt FROM h GROUP BY user_id)
SELECT l.row_id, coalesce(st.u_cnt, 0) AS u_cnt, coalesce(st.u_corr_cnt, 0) AS u_corr_cnt,
  coalesce(st.u_corr_cnt, 0) / nullif(coalesce(st.u_cnt, 0), 0) AS u_corr_rate, coalesce(st.u_hist_lec_cnt, 0)
  AS u_hist_lec_cnt
FROM log l LEFT JOIN st USING (user_id) WHERE l.row_id IN {_TAIL}""")
def q_u14(spark, d):
    """A batch of new rows (each user's last 5) scored from the history state without updating it."""
    log = V.tail_split(interaction_log(spark, d))
    return U.score_without_update(log.filter("is_val = 0"), log.filter("is_val = 1"))


@register("U14b_update_without_score", "user_id:i, u_cnt:i, u_corr_cnt:i, u_hade_cnt:i, u_hade_corr_cnt:i, "
          "u_hist_lec_cnt:i", """
SELECT user_id, count(*) FILTER (WHERE content_type_id = 0) AS u_cnt,
  coalesce(sum(answered_correctly) FILTER (WHERE content_type_id = 0), 0) AS u_corr_cnt,
  coalesce(sum(CAST(coalesce(prior_question_had_explanation, false) AS INTEGER)) FILTER (WHERE content_type_id = 0), 0)
    AS u_hade_cnt,
  coalesce(sum(CAST(coalesce(prior_question_had_explanation, false) AS INTEGER) * answered_correctly)
    FILTER (WHERE content_type_id = 0), 0) AS u_hade_corr_cnt,
  sum(CAST(content_type_id = 1 AS INTEGER)) AS u_hist_lec_cnt FROM log GROUP BY user_id""")
def q_u14b(spark, d):
    """State after folding the new batch's answers into the history state."""
    log = V.tail_split(interaction_log(spark, d))
    return U.update_without_score(log.filter("is_val = 0"), log.filter("is_val = 1"))


# (segment, halo) rows of the segmented twins; U3 looks back 100 rows.  U14 has no window.
TWIN_ROWS = {"U3": (110, 104)}
UNSEGMENTED = ("U14", "U14b")


def _register_twins():
    for name, q in list(REGISTRY.items()):
        if not name.startswith("U") or name.split("_")[0] in UNSEGMENTED or name.endswith("_segmented"):
            continue

        def twin(spark, d, build=q.build, rows=TWIN_ROWS.get(name.split("_")[0], (40, 32))):
            """The query on users cut into segments: the same result."""
            with SG.segmented_plan(*rows):
                return SG.finish(build(spark, d))
        register(f"{name}_segmented", ", ".join(f"{n}:{k}" for n, k in q.spec), q.sql)(twin)


_register_twins()
