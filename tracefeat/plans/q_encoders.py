"""Registered queries for aggregations and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import encoders as A
from tracefeat.operators import prep as P
from tracefeat.operators import splits as V
from tracefeat.operators import windows as W
from tracefeat.plans import frames as FR
from tracefeat.plans.registry import register
from tracefeat.session import cut_lineage
from tracefeat.sources.binding import interaction_log, lectures, question_log, questions, read_table

WU = "PARTITION BY user_id ORDER BY timestamp, row_id"
X = FR.X_SQL


# A1 / A2 ---------------------------------------------------------------------
def _a1_sql(key_expr, key):
    c = "prior_question_elapsed_time"
    return f"""
WITH k AS (SELECT *, {key_expr} AS {key} FROM qlog),
t AS (SELECT {key}, sum({c}) / count({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median,
        stddev_samp({c}) AS {c}_std, max({c}) AS {c}_max, min({c}) AS {c}_min FROM k GROUP BY {key})
SELECT k.row_id, t.{c}_mean, t.{c}_median, t.{c}_std, t.{c}_max, t.{c}_min,
  k.{c} / (t.{c}_mean + 1e-05) AS {c}_div_mean_by_{key}, k.{c} / (t.{c}_median + 1e-05) AS {c}_div_median_by_{key},
  k.{c} - t.{c}_mean AS {c}_diff_mean_by_{key}, k.{c} - t.{c}_median AS {c}_diff_median_by_{key}
FROM k LEFT JOIN t ON k.{key} = t.{key}"""


def _a1_spec(key):
    c = "prior_question_elapsed_time"
    return (f"row_id:i, {c}_mean:f2, {c}_median:f2, {c}_std:f2, {c}_max:f2, {c}_min:f2, {c}_div_mean_by_{key}:f, "
            f"{c}_div_median_by_{key}:f, {c}_diff_mean_by_{key}:f2, {c}_diff_median_by_{key}:f2")


@register("A1_group_stats_user_part", _a1_spec("user_id_and_part"), _a1_sql(
    "CAST(user_id AS VARCHAR) || '_' || coalesce(CAST(part AS VARCHAR), 'nan')", "user_id_and_part"))
def q_a1(spark, d):
    """A1 + A2: elapsed-time stats by the user x part text key, attached with ratios."""
    df = question_log(spark, d).withColumn("user_id_and_part", P.composite_key("user_id", "part"))
    return A.group_stats_ratio(df, "user_id_and_part", "prior_question_elapsed_time")


@register("A1b_group_stats_content", _a1_spec("content_id"), _a1_sql("content_id", "content_id"))
def q_a1b(spark, d):
    return A.group_stats_ratio(question_log(spark, d), "content_id", "prior_question_elapsed_time")


@register("A2_group_stats_content_bin", _a1_spec("content_id_bin"), _a1_sql("content_id // 30", "content_id_bin"))
def q_a2(spark, d):
    df = question_log(spark, d).withColumn("content_id_bin", P.bin_id("content_id", 30))
    return A.group_stats_ratio(df, "content_id_bin", "prior_question_elapsed_time")


# A3 --------------------------------------------------------------------------
@register("A3_count_encoding", "row_id:i, lecture_tag_count:i", """
WITH k AS (SELECT l.row_id, lc.tag AS lecture_tag FROM log l LEFT JOIN lectures lc ON l.content_id = lc.lecture_id),
c AS (SELECT lecture_tag, count(*) AS n FROM k WHERE lecture_tag IS NOT NULL GROUP BY lecture_tag)
SELECT k.row_id, c.n AS lecture_tag_count FROM k LEFT JOIN c USING (lecture_tag)""")
def q_a3(spark, d):
    """Frequency of the lecture tag (NULL key -> NULL)."""
    df = P.join_lectures(interaction_log(spark, d), lectures(spark, d), literal=True)
    return A.attach(df, A.count_encoding(df, "lecture_tag"), "lecture_tag")


@register("A3b_count_encoding_add", "content_id:i, content_id_count:i",
          "SELECT content_id, count(*) AS content_id_count FROM log GROUP BY content_id")
def q_a3b(spark, d):
    """Encoder fitted on the training part, then the validation part added."""
    log = V.tail_split(interaction_log(spark, d))
    enc = A.count_encoding(log.filter("is_val = 0"), "content_id")
    return A.count_encoding_add(enc, log.filter("is_val = 1"), "content_id")


# A4 - A7 ---------------------------------------------------------------------
_TE_KEYS_SQL = """
k AS (SELECT l.row_id, l.row_id % 5 AS fold, l.answered_correctly AS t, l.content_id, lc.tag AS lecture_tag,
        CAST(l.content_id AS VARCHAR) || '_' || CAST(CASE WHEN a <= 3 THEN a ELSE 4 END AS VARCHAR)
          AS content_id_and_attempt_c
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id) AS a FROM log) l
      LEFT JOIN lectures lc ON l.content_id = lc.lecture_id)"""


def _oof_sql(src, key, name):
    return f"""(SELECT {src}.row_id, e.te AS {name} FROM {src} LEFT JOIN (
  SELECT fs.{key}, fs.fold, (tot.S - fs.s) / nullif(tot.N - fs.n, 0) AS te
  FROM (SELECT {key}, fold, sum(t) AS s, count(t) AS n FROM {src} GROUP BY {key}, fold) fs
  JOIN (SELECT {key}, sum(t) AS S, count(t) AS N FROM {src} GROUP BY {key}) tot ON fs.{key} = tot.{key}
  ) e ON {src}.{key} = e.{key} AND {src}.fold = e.fold)"""


@register("A4_target_encoding_oof",
          "row_id:i, te_content_id_by_answered_correctly:f, te_tag_by_answered_correctly:f, "
          "te_content_id_and_attempt_c_by_answered_correctly:f", f"""
WITH {_TE_KEYS_SQL}
SELECT a.row_id, a.te_content_id_by_answered_correctly, b.te_tag_by_answered_correctly,
       c.te_content_id_and_attempt_c_by_answered_correctly
FROM {_oof_sql('k', 'content_id', 'te_content_id_by_answered_correctly')} a
JOIN {_oof_sql('k', 'lecture_tag', 'te_tag_by_answered_correctly')} b USING (row_id)
JOIN {_oof_sql('k', 'content_id_and_attempt_c', 'te_content_id_and_attempt_c_by_answered_correctly')} c
  USING (row_id)""")
def q_a4(spark, d):
    """Out-of-fold target encoding by item, lecture tag and item x clipped attempt (5 folds)."""
    df = P.join_lectures(V.kfold(interaction_log(spark, d), 5, method="modulus"), lectures(spark, d), literal=True)
    df = W.attempt_count(df, "content_id", "_a").withColumn("tag", F.col("lecture_tag"))
    df = df.withColumn("content_id_and_attempt_c",
                       F.concat_ws("_", F.col("content_id").cast("string"),
                                   P.clip_attempt("_a", 3).cast("string")))
    for key in ("content_id", "tag", "content_id_and_attempt_c"):
        df = A.target_encoding_oof(df, key, "answered_correctly")
    return df


_FOLD_ENC_SQL = """
tr AS (SELECT row_id, row_id % 5 AS fold, content_id, answered_correctly AS t FROM log WHERE row_id NOT IN
  (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC)
   AS rn FROM log) WHERE rn <= 5)),
fs AS (SELECT content_id, fold, sum(t) AS s, count(t) AS n FROM tr GROUP BY content_id, fold),
tot AS (SELECT content_id, sum(t) AS S, count(t) AS N FROM tr GROUP BY content_id),
g AS (SELECT tot.content_id, f.fold, tot.S, tot.N FROM tot, (SELECT range AS fold FROM range(5)) f),
enc AS (SELECT g.content_id, g.fold, (g.S - coalesce(fs.s, 0)) / (g.N - coalesce(fs.n, 0)) AS te FROM g
        LEFT JOIN fs ON g.content_id = fs.content_id AND g.fold = fs.fold WHERE g.N - coalesce(fs.n, 0) > 0)"""


def _fold_enc_spark(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    tr = V.kfold(log.filter("is_val = 0"), 5, method="modulus")
    return log, A.fold_encoders(tr, "content_id", "answered_correctly", 5)


@register("A5_target_encoding_apply", "row_id:i, te_content_id_apply:f", f"""
WITH {_FOLD_ENC_SQL},
m AS (SELECT content_id, CASE WHEN count(te) = 5 THEN sum(te) / 5 END AS te_content_id_apply FROM enc
      GROUP BY content_id)
SELECT l.row_id, m.te_content_id_apply FROM log l LEFT JOIN m USING (content_id) WHERE l.row_id IN
  (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC)
   AS rn FROM log) WHERE rn <= 5)""")
def q_a5(spark, d):
    """Fold encoders fitted on the training part, applied to the held-out tail rows."""
    log, enc = _fold_enc_spark(spark, d)
    return A.target_encoding_apply(log.filter("is_val = 1"), enc, "content_id", 5, "te_content_id_apply")


@register("A6_encoder_mean_table", "content_id:i, te_mean:f",
          f"WITH {_FOLD_ENC_SQL} SELECT content_id, avg(te) AS te_mean FROM enc GROUP BY content_id")
def q_a6(spark, d):
    _, enc = _fold_enc_spark(spark, d)
    return A.encoder_mean_table(enc, "content_id")


@register("A7_shift_target_encoding",
          "row_id:i, te_content_id_prior_by_answered_correctly:f, te_content_id_next_by_answered_correctly:f", f"""
WITH k AS (SELECT row_id, row_id % 5 AS fold, answered_correctly AS t,
             lag(content_id) OVER ({WU}) AS content_id_prior, lead(content_id) OVER ({WU}) AS content_id_next FROM log)
SELECT a.row_id, a.te_content_id_prior_by_answered_correctly, b.te_content_id_next_by_answered_correctly
FROM {_oof_sql('k', 'content_id_prior', 'te_content_id_prior_by_answered_correctly')} a
JOIN {_oof_sql('k', 'content_id_next', 'te_content_id_next_by_answered_correctly')} b USING (row_id)""")
def q_a7(spark, d):
    """Out-of-fold TE on the previous and the next item (the next one leaks, by design)."""
    return A.shift_target_encoding(V.kfold(interaction_log(spark, d), 5, method="modulus"))


# A8 - A11 on the content key (building blocks of A25) -------------------------
def _entity(name, keys, parts, doc):
    cols = FR.entity_cols(keys, parts)

    def build(spark, d):
        x = FR.train_x(spark, d)
        rep = A.repeat_table(x) if any("repeat" in p for p in parts) else None
        et = A.elapsed_time_table(x) if "te_elapsed" in parts else None
        return A.entity_table(x, keys, parts, rep, et)
    build.__doc__ = doc
    register(name, FR.spec_text(cols), f"WITH {X}\n" + FR.entity_sql(keys, parts))(build)


_entity("A8_smoothed_te", "content_id", ["te", "te_repeat"],
        "Smoothed (s=5) encodings of three targets by item, on all answers and on repeats.")
_entity("A9_count_std", "content_id", ["count_std", "count_std_repeat"], "Count and sample std of the target by item.")
_entity("A10_unique_users", "content_id", ["unique_user"], "Distinct users per item.")
_entity("A11_entropy", "content_id", ["entropy_answer", "entropy_target"],
        "Entropy (nats) of the chosen answer and of the target by item.")
_entity("A26_part_feature_table", "part", ["count_std", "te", "te_repeat", "te_elapsed"],
        "Per-part table: count/std, smoothed encodings (3 targets, all and repeat), elapsed-time encoding.")
_entity("A27_content_x_explanation_table", ["content_id", "prior_question_had_explanation"],
        ["count_std", "te", "entropy_answer"], "Per (item, had_explanation) table.")
_entity("A28_content_x_user_count_bin_table", ["content_id", "u_cnt_cat"], ["count_std", "te_target", "entropy_answer"],
        "Per (item, user-experience bin) table.")
_entity("A28b_user_count_bin_table", "u_cnt_cat", ["count_std", "te_target", "entropy_answer"],
        "Per user-experience bin table.")
_entity("A29_content_x_seen_before_table", ["content_id", "u_hist_ques_ansed"],
        ["count_std", "te_target", "entropy_answer"], "Per (item, answered-before flag) table.")


# A12 -------------------------------------------------------------------------
_A12_SQL = """
qt AS (SELECT question_id, unnest(string_split(coalesce(tags, '999'), ' ')) AS tag FROM questions),
tm AS (SELECT qt.tag, sum(x.answered_correctly) / count(x.answered_correctly) AS m
       FROM x JOIN qt ON x.content_id = qt.question_id GROUP BY qt.tag),
a12 AS (SELECT qt.question_id AS content_id, max(tm.m) AS tags_max, min(tm.m) AS tags_min, count(*) AS tags_cnt,
          avg(tm.m) AS tags_mean, stddev_pop(tm.m) AS tags_std FROM qt LEFT JOIN tm USING (tag) GROUP BY qt.question_id)"""


@register("A12_tag_target_stats", "content_id:i, tags_max:f, tags_min:f, tags_cnt:i, tags_mean:f, tags_std:f",
          f"WITH {X}, {_A12_SQL} SELECT * FROM a12")
def q_a12(spark, d):
    """Per question: max/min/count/mean/population-std of its tags' mean target."""
    return A.tag_target_stats(FR.train_x(spark, d), questions(spark, d))


# A13 / A14 -------------------------------------------------------------------
_A13_SQL = f"""
sf0 AS (SELECT *, CAST(coalesce(timestamp - lag(timestamp) OVER ({WU}), 0) > {FR.SESSION_GAP_FIXTURE_MS} AS INTEGER)
          AS raw_start, row_number() OVER ({WU}) AS rn FROM x),
sf AS (SELECT content_id, CASE WHEN rn = 1 THEN 1 ELSE raw_start END AS user_session_start,
         coalesce(lead(raw_start) OVER ({WU}), 0) AS user_session_end FROM sf0),
a13 AS (SELECT content_id,
   (sum(user_session_start) + 10 * (SELECT avg(user_session_start) FROM sf)) / (count(*) + 10)
     AS user_session_start__mean_smooth,
   (sum(user_session_end) + 10 * (SELECT avg(user_session_end) FROM sf)) / (count(*) + 10)
     AS user_session_end__mean_smooth FROM sf GROUP BY content_id)"""


@register("A13_session_border_rate", "content_id:i, user_session_start__mean_smooth:f, user_session_end__mean_smooth:f",
          f"WITH {X}, {_A13_SQL} SELECT * FROM a13")
def q_a13(spark, d):
    """Smoothed (s=10) rate of session starts / ends per item (12 h gap on the fixture)."""
    return A.session_border_rate(FR.train_x(spark, d), FR.SESSION_GAP_FIXTURE_MS)


_A14_SQL = f"""
a14 AS (SELECT content_id, sum(o) / count(o) AS content_order_mean, quantile_cont(o, 0.5) AS content_order_median,
          max(o) AS content_order_max, min(o) AS content_order_min, stddev_samp(o) AS content_order_std
        FROM (SELECT content_id, row_number() OVER ({WU}) AS o FROM x) GROUP BY content_id)"""


@register("A14_content_order_stats", "content_id:i, content_order_mean:f, content_order_median:f, "
          "content_order_max:i, content_order_min:i, content_order_std:f", f"WITH {X}, {_A14_SQL} SELECT * FROM a14")
def q_a14(spark, d):
    return A.content_order_stats(FR.train_x(spark, d))


# A15 / A16 / A17 / A18 -------------------------------------------------------
@register("A15_choice_weights", "content_id:i, user_answer:i, count:i, c_count:i, choice_rate:f, "
          "answered_correctly:i, weighted_answered_correctly:f, weighted_score:f", f"""
WITH {X} SELECT content_id, user_answer, cnt AS count, c_count, choice_rate, ac AS answered_correctly,
  weighted_answered_correctly, weighted_score FROM cw""")
def q_a15(spark, d):
    return A.choice_weights(FR.answered(spark, d), questions(spark, d))


@register("A16_choice_weight_pivot", "content_id:i, ws_0:f, ws_1:f, ws_2:f, ws_3:f", f"""
WITH {X} SELECT content_id, """ + ", ".join(
    f"coalesce(max(CASE WHEN user_answer = {a} THEN weighted_score END), 0) AS ws_{a}" for a in range(4))
          + " FROM cw GROUP BY content_id")
def q_a16(spark, d):
    return A.choice_weight_pivot(A.choice_weights(FR.answered(spark, d), questions(spark, d)))


@register("A17_answer_crosstab", "content_id:i, n_lecture:i, n_wrong:i, n_right:i, lecture_share:f", """
SELECT content_id, count(*) FILTER (WHERE answered_correctly = -1) AS n_lecture,
  count(*) FILTER (WHERE answered_correctly = 0) AS n_wrong, count(*) FILTER (WHERE answered_correctly = 1) AS n_right,
  count(*) FILTER (WHERE answered_correctly = -1) / count(*) AS lecture_share FROM log GROUP BY content_id""")
def q_a17(spark, d):
    return A.answer_crosstab(interaction_log(spark, d))


@register("A18_count_over_union", "content_id:i, content_id_count_all:i",
          "SELECT content_id, count(*) AS content_id_count_all FROM log GROUP BY content_id")
def q_a18(spark, d):
    """Item frequency over the union of the training and validation parts."""
    log = V.tail_split(interaction_log(spark, d))
    return A.count_over_union(log.filter("is_val = 0"), log.filter("is_val = 1"))


# A19 - A24 -------------------------------------------------------------------
@register("A19_global_means", "answered_correctly_mean:f, weighted_answered_correctly_mean:f, weighted_score_mean:f, "
          "answered_correctly_mean_repeat:f, weighted_answered_correctly_mean_repeat:f, weighted_score_mean_repeat:f",
          f"""
WITH {X} SELECT gm.*, r.* FROM gm, (SELECT avg(answered_correctly) AS answered_correctly_mean_repeat,
  avg(weighted_answered_correctly) AS weighted_answered_correctly_mean_repeat,
  avg(weighted_score) AS weighted_score_mean_repeat FROM rep) r""")
def q_a19(spark, d):
    """Global target means on the answer table and on its repeat rows, in one pass."""
    x = FR.train_x(spark, d)
    rep = F.col("u_hist_ques_ansed") == 1
    return x.agg(*[F.avg(c).alias(f"{c}_mean") for c in A.TARGETS],
                 *[F.avg(F.when(rep, F.col(c))).alias(f"{c}_mean_repeat") for c in A.TARGETS])


@register("A20_content_mean", "row_id:i, content_mean:f", """
SELECT l.row_id, m.content_mean FROM log l LEFT JOIN
  (SELECT content_id, sum(answered_correctly) / count(*) AS content_mean FROM log WHERE content_type_id = 0
   GROUP BY content_id) m USING (content_id)""")
def q_a20(spark, d):
    """Mean target per item over question rows, attached to every row."""
    log = interaction_log(spark, d)
    return A.attach(log, A.content_mean(log.filter("content_type_id = 0")), "content_id")


@register("A21_user_lag_encoders", "user_id:i, user_lag_mean:f2, user_lag_median:f2", f"""
SELECT user_id, sum(g) / count(g) AS user_lag_mean, quantile_cont(g, 0.5) AS user_lag_median
FROM (SELECT user_id, timestamp - lag(timestamp) OVER ({WU}) AS g FROM log) GROUP BY user_id""")
def q_a21(spark, d):
    return A.user_lag_encoders(interaction_log(spark, d))


@register("A22_head_value", "row_id:i, head_part:i", f"""
SELECT row_id, first_value(part) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head_part
FROM qlog""")
def q_a22(spark, d):
    """The part of the user's first row (NULL when it is a lecture) on all rows."""
    return A.head_value(question_log(spark, d), "part")


@register("A23_repeat_table", "row_id:i", f"WITH {X} SELECT row_id FROM rep")
def q_a23(spark, d):
    return A.repeat_table(FR.answered(spark, d))


@register("A24_elapsed_time_table", "row_id:i, question_elapsed_time:f", f"""
WITH {X} SELECT row_id, question_elapsed_time FROM et""")
def q_a24(spark, d):
    return A.elapsed_time_table(FR.answered(spark, d))


# A25 -------------------------------------------------------------------------
_A25_PARTS = ["count_std", "count_std_repeat", "unique_user", "te", "te_repeat", "entropy_answer", "entropy_target",
              "te_elapsed"]
_A26_PARTS = ["count_std", "te", "te_repeat", "te_elapsed"]
_A25_COLS = (FR.entity_cols("content_id", _A25_PARTS)
             + [("tags_max", "f"), ("tags_min", "f"), ("tags_cnt", "i"), ("tags_mean", "f"), ("tags_std", "f"),
                ("user_session_start__mean_smooth", "f"), ("user_session_end__mean_smooth", "f"),
                ("content_order_mean", "f"), ("content_order_median", "f"), ("content_order_max", "i"),
                ("content_order_min", "i"), ("content_order_std", "f"), ("part", "i")]
             + FR.entity_cols("part", _A26_PARTS)[1:])


@register("A25_content_feature_table", FR.spec_text(_A25_COLS), f"""
WITH {X}, {_A12_SQL}, {_A13_SQL}, {_A14_SQL},
c AS ({FR.entity_sql('content_id', _A25_PARTS)}),
pt AS ({FR.entity_sql('part', _A26_PARTS)})
SELECT * FROM c LEFT JOIN a12 USING (content_id) LEFT JOIN a13 USING (content_id) LEFT JOIN a14 USING (content_id)
  LEFT JOIN (SELECT question_id AS content_id, part FROM questions) q USING (content_id)
  LEFT JOIN pt USING (part)""")
def q_a25(spark, d):
    """Wide item table: counts, encodings, entropies, tag stats, session borders,
    order stats and the item's part table, chained by joins on content_id."""
    x = cut_lineage(FR.train_x(spark, d))                                  # written once, read by every block
    qs = questions(spark, d)
    rep, et = A.repeat_table(x), cut_lineage(A.elapsed_time_table(x))
    c = A.entity_table(x, "content_id", _A25_PARTS, rep, et)
    for t in (A.tag_target_stats(x, qs), A.session_border_rate(x, FR.SESSION_GAP_FIXTURE_MS),
              A.content_order_stats(x), qs.select(F.col("question_id").alias("content_id"), "part")):
        c = c.join(t, "content_id", "left")
    return c.join(A.entity_table(x, "part", _A26_PARTS, rep, et), "part", "left")


_VEC_WIDTH = 64
_A25B_COLS = ([("content_id", "i"), ("answered", "i")] + [(f"emb_{j}", "f") for j in range(_VEC_WIDTH)]
              + [(f"tag_vec_mean_{j}", "f") for j in range(_VEC_WIDTH)])


@register("A25b_content_vectors", FR.spec_text(_A25B_COLS), f"""
WITH n AS (SELECT content_id, count(*) AS answered FROM log WHERE content_type_id = 0 GROUP BY content_id),
qt AS (SELECT question_id, CAST(unnest(string_split(tags, ' ')) AS BIGINT) AS vec_id FROM questions),
v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
      FROM embeddings),
tv AS (SELECT question_id AS content_id, dim, sum(x) / count(x) AS m FROM qt JOIN v USING (vec_id) GROUP BY question_id, dim),
tw AS (SELECT content_id, """ + ", ".join(f"max(CASE WHEN dim = {j} THEN m END) AS tag_vec_mean_{j}"
                                        for j in range(_VEC_WIDTH)) + """ FROM tv GROUP BY content_id)
SELECT n.content_id, n.answered, """ + ", ".join(f"CAST(e.embedding[{j + 1}] AS DOUBLE) AS emb_{j}"
                                                for j in range(_VEC_WIDTH)) + ", "
          + ", ".join(f"tw.tag_vec_mean_{j}" for j in range(_VEC_WIDTH)) + """
FROM n LEFT JOIN embeddings e ON n.content_id = e.vec_id LEFT JOIN tw USING (content_id)""")
def q_a25b(spark, d):
    """Item table with outer vectors: the item's own (embeddings.vec_id) and the mean of its tags' vectors, as columns."""
    log = interaction_log(spark, d).filter("content_type_id = 0")
    c = log.groupBy("content_id").agg(F.count(F.lit(1)).alias("answered"))
    emb = read_table(spark, d, "embeddings")
    stats = A.tag_vector_stats(A.questions_of(c, questions(spark, d)), emb)
    return A.attach_tag_vectors(A.attach_vectors(c, emb, "content_id", _VEC_WIDTH, "emb"), stats, _VEC_WIDTH)


# A30 / A31 -------------------------------------------------------------------
@register("A30_tag_vector_stats", "question_id:i, dim:i, tag_vec_mean:f, tag_vec_median:f, tag_vec_std:f, "
          "tag_vec_max:f, tag_vec_min:f", """
WITH qt AS (SELECT question_id, CAST(unnest(string_split(tags, ' ')) AS BIGINT) AS vec_id FROM questions),
v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
      FROM embeddings)
SELECT question_id, dim, sum(x) / count(x) AS tag_vec_mean, quantile_cont(x, 0.5) AS tag_vec_median,
  stddev_samp(x) AS tag_vec_std, max(x) AS tag_vec_max, min(x) AS tag_vec_min
FROM qt JOIN v USING (vec_id) GROUP BY question_id, dim""")
def q_a30(spark, d):
    """Per question and vector dimension, stats of its tags' vectors (tag t -> embeddings.vec_id t)."""
    return A.tag_vector_stats(questions(spark, d), read_table(spark, d, "embeddings"))


_A31_COLS = ["prior_correct_sum", "prior_count", "prior_correct_rate", "answered_correctly_rolling3"]


@register("A31_feature_profile", "feature:s, nunique:i, min_value:f, max_value:f, mean_value:f", f"""
WITH f AS (SELECT coalesce(sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS prior_correct_sum, count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_count,
           sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_correct_rate,
           CASE WHEN count(*) OVER ({WU} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN
            sum(answered_correctly) OVER ({WU} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / 3 END
            AS answered_correctly_rolling3 FROM log)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS nunique, CAST(min({c}) AS DOUBLE) AS min_value, "
    f"CAST(max({c}) AS DOUBLE) AS max_value, avg({c}) AS mean_value FROM f" for c in _A31_COLS))
def q_a31(spark, d):
    """nunique / min / max / mean of four window features in one aggregate pass."""
    f = W.rolling_prior_mean(W.user_running(interaction_log(spark, d)), (3,))
    return A.feature_profile(f, _A31_COLS)



@register("S12_write_encoders", "content_id:i, fold:i, te:f", f"WITH {_FOLD_ENC_SQL} SELECT content_id, fold, te FROM enc")
def q_s12(spark, d):
    """Fold encoders persisted as a parquet lookup table (partitioned by fold) and read back."""
    from tracefeat.sources import io
    _, enc = _fold_enc_spark(spark, d)
    path = io.write_partitioned(enc, io.fresh_path(spark, "encoders"), by=("fold",))
    return spark.read.parquet(path)
