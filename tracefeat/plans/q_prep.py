"""Registered queries: scans/sinks (S), row operators (P), joins (J), sorts and
sets (O, D, X), splits (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import prep as P
from tracefeat.operators import sets as O
from tracefeat.operators import splits as V
from tracefeat.operators import windows as W
from tracefeat.plans.registry import register
from tracefeat.sources import io
from tracefeat.sources.binding import (LOG_COLUMNS, interaction_log, lectures, question_log, questions,
                                       read_table)

WU = "PARTITION BY user_id ORDER BY timestamp, row_id"
LOG_SPEC = ("row_id:i, user_id:i, timestamp:i, content_id:i, content_type_id:i, task_container_id:i, "
            "user_answer:i, answered_correctly:i, prior_question_elapsed_time:f, prior_question_had_explanation:i")
LOG_SQL = ("SELECT row_id, user_id, timestamp, content_id, content_type_id, task_container_id, user_answer, "
           "answered_correctly, prior_question_elapsed_time, CAST(prior_question_had_explanation AS INTEGER) "
           "AS prior_question_had_explanation FROM log")


def _bool_int(df):
    return df.withColumn("prior_question_had_explanation", F.col("prior_question_had_explanation").cast("int"))


# ---------------------------------------------------------------- S ----------
@register("S1_scan_log", LOG_SPEC, LOG_SQL)
def q_s1(spark, d):
    """Typed read of the interaction log."""
    return _bool_int(interaction_log(spark, d))


@register("S2_scan_questions", "question_id:i, part:i, correct_answer:i, tags:s",
          "SELECT question_id, part, correct_answer, tags FROM questions")
def q_s2(spark, d):
    return questions(spark, d)


@register("S2b_scan_lectures", "lecture_id:i, tag:i, part:i, type_of:s",
          "SELECT lecture_id, tag, part, type_of FROM lectures")
def q_s2b(spark, d):
    return lectures(spark, d)


@register("S3_scan_head", "row_id:i, user_id:i, answered_correctly:i",
          "SELECT row_id, user_id, answered_correctly FROM log ORDER BY row_id LIMIT 5000")
def q_s3(spark, d):
    """First n rows by row_id (a debug read): the limit is the feature."""
    return interaction_log(spark, d).orderBy("row_id").limit(5000)


@register("S4_io_by_extension", LOG_SPEC, LOG_SQL)
def q_s4(spark, d):
    """Round trip of the log through csv, tsv and json writers/readers, back to parquet."""
    log = _bool_int(interaction_log(spark, d))
    schema = log.schema
    cur = log
    for ext in (".csv", ".tsv", ".json", ".parquet"):
        path = io.fresh_path(spark, "s4") + ext
        io.write_by_extension(cur, path)
        cur = io.read_by_extension(spark, path, schema=schema)
    return cur


@register("S5_feature_store_write", "feature:s, grp:s", """
SELECT * FROM (VALUES ('prior_correct_sum', 'w1'), ('prior_count', 'w1'), ('prior_correct_rate', 'w1'),
  ('answered_correctly_rolling3', 'w4'), ('answered_correctly_rolling5', 'w4'),
  ('answered_correctly_rolling7', 'w4')) AS t(feature, grp)""")
def q_s5(spark, d):
    """Write two feature groups and read back the registry (set union of names)."""
    log = interaction_log(spark, d)
    store = io.FeatureStore(spark, io.fresh_path(spark, "store"))
    store.save(W.user_running(log).select("row_id", "prior_correct_sum", "prior_count", "prior_correct_rate"), "w1")
    store.save(W.rolling_prior_mean(log).select("row_id", *[f"answered_correctly_rolling{w}" for w in (3, 5, 7)]),
               "w4")
    store.save(W.user_running(log).select("row_id", "prior_count"), "w1")
    return store.registry()


@register("S6_feature_store_assemble", "row_id:i, prior_correct_rate:f, answered_correctly_rolling5:f", f"""
SELECT row_id, sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_correct_rate,
  CASE WHEN count(*) OVER ({WU} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5
       THEN sum(answered_correctly) OVER ({WU} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / 5 END
    AS answered_correctly_rolling5
FROM log""")
def q_s6(spark, d):
    """Wide matrix from named features of two groups (n-way join on row_id, pruned scans)."""
    log = interaction_log(spark, d)
    store = io.FeatureStore(spark, io.fresh_path(spark, "store"))
    store.save(W.user_running(log).select("row_id", "prior_correct_sum", "prior_count", "prior_correct_rate"), "w1")
    store.save(W.rolling_prior_mean(log).select("row_id", *[f"answered_correctly_rolling{w}" for w in (3, 5, 7)]),
               "w4")
    return store.assemble(["prior_correct_rate", "answered_correctly_rolling5"])


@register("S7_extract_id_target", "row_id:i, answered_correctly:i", "SELECT row_id, answered_correctly FROM log")
def q_s7(spark, d):
    return interaction_log(spark, d).select("row_id", "answered_correctly")


@register("S8_write_submission", "row_id:i, answered_correctly:f", f"""
SELECT row_id, answered_correctly FROM (
SELECT row_id, content_type_id,
  coalesce(sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.5) AS answered_correctly
FROM log) WHERE content_type_id = 0""")
def q_s8(spark, d):
    """Predictions (prior rate, 0.5 when unknown) for question rows, written as gzip CSV, read back."""
    log = W.user_running(interaction_log(spark, d))
    preds = log.filter(F.col("content_type_id") == 0).select(
        "row_id", F.coalesce(F.col("prior_correct_rate"), F.lit(0.5)).alias("answered_correctly"))
    path = io.write_submission(preds, io.fresh_path(spark, "submission"))
    return spark.read.schema("row_id long, answered_correctly double").option("header", "true").csv(path)


@register("S9_append_warehouse_table", "row_id:i, user_id:i",
          "SELECT row_id, user_id FROM log UNION ALL SELECT row_id, user_id FROM log")
def q_s9(spark, d):
    """Append the same frame twice to one table."""
    path = io.fresh_path(spark, "append")
    log = interaction_log(spark, d).select("row_id", "user_id")
    io.append_table(log, path)
    io.append_table(log, path)
    return spark.read.parquet(path)


@register("S11_write_folds", "row_id:i, cv:i, split:s", """
SELECT row_id, 1 AS cv, CASE WHEN rn <= 5 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC) AS rn FROM log)""")
def q_s11(spark, d):
    """Persist a CV cut as one table partitioned by (cv, split)."""
    t = V.tail_split(interaction_log(spark, d)).select(
        "row_id", F.lit(1).alias("cv"), F.when(F.col("is_val") == 1, "valid").otherwise("train").alias("split"))
    path = io.write_partitioned(t, io.fresh_path(spark, "folds"))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- P ----------
@register("P1_base_features", "row_id:i, user_id:i, timestamp:i, content_id:i, content_type_id:i, "
          "task_container_id:i, prior_question_elapsed_time:f, prior_question_had_explanation:f", """
SELECT row_id, user_id, timestamp, content_id, content_type_id, task_container_id, prior_question_elapsed_time,
  CAST(prior_question_had_explanation AS DOUBLE) AS prior_question_had_explanation FROM log""")
def q_p1(spark, d):
    return P.base_features(interaction_log(spark, d))


@register("P2_drop_lectures", "row_id:i, user_id:i, content_id:i",
          "SELECT row_id, user_id, content_id FROM log WHERE content_type_id = 0")
def q_p2(spark, d):
    return P.drop_lectures(interaction_log(spark, d))


@register("P3_composite_key", "row_id:i, user_part_key:s, key_rows:i", """
SELECT row_id, user_part_key, count(*) OVER (PARTITION BY user_part_key) AS key_rows
FROM (SELECT row_id, CAST(user_id AS VARCHAR) || '_' || coalesce(CAST(part AS VARCHAR), 'nan') AS user_part_key
      FROM qlog)""")
def q_p3(spark, d):
    """'user_part' text key, a missing part is the group 'nan'; rows per key."""
    from pyspark.sql import Window
    df = question_log(spark, d).withColumn("user_part_key", P.composite_key("user_id", "part"))
    return df.withColumn("key_rows", F.count(F.lit(1)).over(Window.partitionBy("user_part_key")))


@register("P4_bin_id", "row_id:i, content_bin30:i, elapsed_bin10:i",
          "SELECT row_id, content_id // 30 AS content_bin30, "
          "CAST(floor(prior_question_elapsed_time / 10) AS BIGINT) AS elapsed_bin10 FROM log")
def q_p4(spark, d):
    return interaction_log(spark, d).select("row_id", P.bin_id("content_id", 30).alias("content_bin30"),
                                            P.bin_id("prior_question_elapsed_time", 10).alias("elapsed_bin10"))


@register("P4b_equal_width_bins", "content_id:i, n:i, n_bin:i", """
WITH c AS (SELECT content_id, count(*) AS n FROM log GROUP BY content_id),
b AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT content_id, n, CASE WHEN n = lo THEN 0 ELSE least(CAST(ceil((n - lo) / (hi - lo) * 200) AS BIGINT) - 1, 199) END
  AS n_bin FROM c, b""")
def q_p4b(spark, d):
    """200 equal-width, right-closed bins of item frequency."""
    c = interaction_log(spark, d).groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))
    return P.equal_width_bins(c, "n", 200, "n_bin")


@register("P5_clip_attempt", "row_id:i, attempt_clip3:i, attempt_clip2:i", """
SELECT row_id, CASE WHEN a <= 3 THEN a ELSE 4 END AS attempt_clip3, CASE WHEN a <= 2 THEN a ELSE 3 END AS attempt_clip2
FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id) AS a FROM log)""")
def q_p5(spark, d):
    df = W.attempt_count(interaction_log(spark, d), "content_id", "a")
    return df.select("row_id", P.clip_attempt("a", 3).alias("attempt_clip3"), P.clip_attempt("a", 2).alias("attempt_clip2"))


@register("P6_fill_defaults", "row_id:i, prior_question_elapsed_time:i, prior_question_had_explanation:i, part:i, tags:s",
          """
SELECT row_id, CAST(coalesce(prior_question_elapsed_time, -1) AS BIGINT) AS prior_question_elapsed_time,
  CAST(coalesce(prior_question_had_explanation, false) AS INTEGER) AS prior_question_had_explanation,
  coalesce(part, 0) AS part, coalesce(tags, '0') AS tags FROM qlog""")
def q_p6(spark, d):
    return P.fill_defaults(question_log(spark, d))


@register("P7_part_to_section", "row_id:i, section:i", """
SELECT row_id, CASE WHEN part BETWEEN 1 AND 4 THEN 0 WHEN part BETWEEN 5 AND 7 THEN 1 END AS section FROM qlog""")
def q_p7(spark, d):
    return question_log(spark, d).withColumn("section", P.part_to_section("part"))


def _tags_sql(pad, null_tag):
    arr = (f"coalesce(list_transform(string_split(tags, ' '), lambda x: CAST(x AS INTEGER)), [{null_tag}])")
    return (f"list_concat(list_transform(range(greatest(6 - len({arr}), 0)), lambda x: {pad}), {arr})")


@register("P8_parse_tags", "row_id:i, tags_pad0:ai, tags_pad188:ai",
          f"SELECT row_id, {_tags_sql(0, 0)} AS tags_pad0, {_tags_sql(188, 188)} AS tags_pad188 FROM qlog")
def q_p8(spark, d):
    return question_log(spark, d).withColumns({"tags_pad0": P.tag_array("tags", 0, 0),
                                               "tags_pad188": P.tag_array("tags", 188, 188)})


@register("P9_one_hot", "row_id:i, " + ", ".join(f"part_{i}:i" for i in range(1, 8)),
          "SELECT row_id, " + ", ".join(f"coalesce(CAST(part = {i} AS INTEGER), 0) AS part_{i}" for i in range(1, 8))
          + " FROM qlog")
def q_p9(spark, d):
    return question_log(spark, d).withColumns(P.one_hot("part", range(1, 8)))


@register("P10_lecture_type_code", "row_id:i, type_of_id:i, answered_correctly:i", """
SELECT l.row_id, coalesce(CASE lc.type_of WHEN 'concept' THEN 0 WHEN 'solving question' THEN 1
    WHEN 'intention' THEN 2 WHEN 'starter' THEN 3 END, 4) AS type_of_id,
  CASE WHEN l.content_type_id = 1 THEN 2 ELSE l.answered_correctly END AS answered_correctly
FROM log l LEFT JOIN lectures lc ON l.content_id = lc.lecture_id""")
def q_p10(spark, d):
    """Lecture kind code by id (literal map, any row), lecture target 2."""
    return P.lecture_type_code(interaction_log(spark, d), lectures(spark, d))


@register("P11_target_convert", "row_id:i, elapsed_log1p:f, elapsed_back:f2", """
SELECT row_id, ln(1 + prior_question_elapsed_time) AS elapsed_log1p,
  greatest(exp(ln(1 + prior_question_elapsed_time)) - 1, 0) AS elapsed_back FROM log""")
def q_p11(spark, d):
    df = interaction_log(spark, d).withColumn("elapsed_log1p", P.target_convert("prior_question_elapsed_time"))
    return df.withColumn("elapsed_back", P.target_reconvert("elapsed_log1p"))


_P12_COLS = [("row_id", True), ("user_id", True), ("timestamp", True), ("content_id", True),
             ("content_type_id", True), ("task_container_id", True), ("user_answer", True),
             ("answered_correctly", True), ("prior_question_elapsed_time", False)]


def _p12_type(c, is_int):
    if not is_int:
        return "'float'"
    return (f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
            f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
            f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END")


@register("P12_narrow_types", "column_name:s, min_value:f2, max_value:f2, narrow_type:s",
          " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, "
                             f"CAST(max({c}) AS DOUBLE) AS max_value, {_p12_type(c, i)} AS narrow_type FROM log"
                             for c, i in _P12_COLS))
def q_p12(spark, d):
    """Smallest type per numeric column from one min/max pass."""
    return P.narrow_types_table(interaction_log(spark, d))


@register("P13_standardize", "row_id:i, prior_question_elapsed_time:f, timestamp_diff1:f", f"""
WITH t AS (SELECT row_id, prior_question_elapsed_time AS e,
                  CAST(timestamp - lag(timestamp) OVER ({WU}) AS DOUBLE) AS g FROM log),
m AS (SELECT avg(e) AS me, avg(g) AS mg FROM t),
f AS (SELECT row_id, coalesce(e, me) AS e, coalesce(g, mg) AS g, me, mg FROM t, m),
s AS (SELECT stddev_samp(e) AS se, stddev_samp(g) AS sg FROM f)
SELECT row_id, (e - me) / se AS prior_question_elapsed_time, (g - mg) / sg AS timestamp_diff1 FROM f, s""")
def q_p13(spark, d):
    df = W.time_diffs(interaction_log(spark, d), (1,)).withColumn("timestamp_diff1",
                                                                   F.col("timestamp_diff1").cast("double"))
    return P.standardize(df, ["prior_question_elapsed_time", "timestamp_diff1"])


@register("P14_sample_down", "row_id:i, is_val:i")
def q_p14(spark, d):
    """Keep validation rows (last 5 per user) and a seeded half of the training rows."""
    return P.sample_down(V.tail_split(interaction_log(spark, d)), 0.5)


@register("P15_select_features", "row_id:i, content_id:i, prior_correct_rate:f", f"""
SELECT row_id, content_id, sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_correct_rate FROM log""")
def q_p15(spark, d):
    """Configured columns; the one missing from the frame comes from the feature store."""
    log = interaction_log(spark, d)
    store = W.user_running(log).select("row_id", "prior_correct_rate")
    return P.select_features(log, ["content_id", "prior_correct_rate"], store)


@register("P16_map_default", "row_id:i, tag_mapped:i", """
SELECT l.row_id, coalesce(lc.tag, -999) AS tag_mapped FROM log l LEFT JOIN lectures lc ON l.content_id = lc.lecture_id""")
def q_p16(spark, d):
    return P.map_default(interaction_log(spark, d), lectures(spark, d), "content_id", "lecture_id", "tag", -999,
                         "tag_mapped")


@register("P17_log_features", "row_id:i, log1p_prior_count:f, log1p_attempt:f", """
SELECT row_id, ln(1 + count(*) OVER (PARTITION BY user_id ORDER BY timestamp, row_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS log1p_prior_count,
  ln(1 + row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id)) AS log1p_attempt FROM log""")
def q_p17(spark, d):
    df = W.attempt_count(W.user_running(interaction_log(spark, d)), "content_id", "attempt")
    return P.log_features(df, ["prior_count", "attempt"])


@register("P18_question_answer_code", "row_id:i, qa_code:i",
          "SELECT row_id, content_id + CASE WHEN answered_correctly = 1 THEN 13523 ELSE 0 END AS qa_code FROM log")
def q_p18(spark, d):
    return interaction_log(spark, d).withColumn("qa_code", P.question_answer_code())


# ---------------------------------------------------------------- J ----------
@register("J1_join_questions", "row_id:i, part:i, tags:s, correct_answer:i", """
SELECT l.row_id, q.part, q.tags, q.correct_answer FROM log l LEFT JOIN questions q ON l.content_id = q.question_id""")
def q_j1(spark, d):
    """Left join log -> questions by id (every row, as the reference merges)."""
    return P.join_questions(interaction_log(spark, d), questions(spark, d))


@register("J2_join_lectures", "row_id:i, lecture_tag:i, lecture_part:i, type_of:s", """
SELECT l.row_id, lc.tag AS lecture_tag, lc.part AS lecture_part, lc.type_of
FROM log l LEFT JOIN lectures lc ON l.content_id = lc.lecture_id AND l.content_type_id = 1""")
def q_j2(spark, d):
    return P.join_lectures(interaction_log(spark, d), lectures(spark, d))


@register("J2b_join_lectures_literal", "row_id:i, lecture_tag:i, lecture_part:i, type_of:s", """
SELECT l.row_id, lc.tag AS lecture_tag, lc.part AS lecture_part, lc.type_of
FROM log l LEFT JOIN lectures lc ON l.content_id = lc.lecture_id""")
def q_j2b(spark, d):
    """Literal form: no content-type test, a question sharing a lecture id takes its tag."""
    return P.join_lectures(interaction_log(spark, d), lectures(spark, d), literal=True)


@register("J3_lookup_map", "row_id:i, mapped_part:i", """
SELECT l.row_id, coalesce(lc.part, q.part) AS mapped_part FROM log l
LEFT JOIN questions q ON l.content_id = q.question_id LEFT JOIN lectures lc ON l.content_id = lc.lecture_id""")
def q_j3(spark, d):
    return P.lookup_part(interaction_log(spark, d), questions(spark, d), lectures(spark, d))


@register("J4_reindex_join", "row_id:i, content_rows:i", """
SELECT l.row_id, c.content_rows FROM log l
LEFT JOIN (SELECT content_id, count(*) AS content_rows FROM log GROUP BY content_id) c ON l.content_id = c.content_id""")
def q_j4(spark, d):
    """Attach a per-item table (rows per item) to the log."""
    log = interaction_log(spark, d)
    c = log.groupBy("content_id").agg(F.count(F.lit(1)).alias("content_rows"))
    return P.composite_join(log, c, ["content_id"])


@register("J5_rowid_join", "row_id:i, content_id:i, prior_correct_rate:f", f"""
SELECT row_id, content_id, sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_correct_rate FROM log""")
def q_j5(spark, d):
    log = interaction_log(spark, d)
    feats = W.user_running(log).select("row_id", "prior_correct_rate")
    return P.rowid_join(log.select("row_id", "content_id"), feats)


_TAIL = ("(SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, "
         "row_id DESC) AS rn FROM log) WHERE rn <= 5)")
_DUP = ("(SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id, task_container_id "
        "ORDER BY timestamp, answered_correctly DESC, row_id) AS rn FROM log WHERE row_id NOT IN " + _TAIL
        + ") WHERE rn > 1)")


@register("J6_semi_join", "row_id:i, user_id:i", f"SELECT row_id, user_id FROM log WHERE row_id IN {_TAIL}")
def q_j6(spark, d):
    log = interaction_log(spark, d)
    return P.semi_join(log, O.last_n_per_user(log, 5))


@register("J7_anti_join", "row_id:i",
          f"SELECT row_id FROM log WHERE row_id NOT IN {_TAIL} AND row_id NOT IN {_DUP}")
def q_j7(spark, d):
    """Drop rows in the union of two drop lists (validation rows, duplicate task rows)."""
    log = V.tail_split(interaction_log(spark, d))
    return P.anti_join(log, log.filter("is_val = 1"), O.duplicate_task_rows(log))


@register("J8_composite_join", "row_id:i, pair_rows:i", """
SELECT l.row_id, c.pair_rows FROM log l LEFT JOIN
  (SELECT content_id, user_answer, count(*) AS pair_rows FROM log GROUP BY content_id, user_answer) c
  ON l.content_id = c.content_id AND l.user_answer = c.user_answer""")
def q_j8(spark, d):
    log = interaction_log(spark, d)
    c = log.groupBy("content_id", "user_answer").agg(F.count(F.lit(1)).alias("pair_rows"))
    return P.composite_join(log, c, ["content_id", "user_answer"])


@register("J9_refill_dropped", "row_id:i, pred:f", f"""
SELECT l.row_id, coalesce(p.pred, 0) AS pred FROM log l LEFT JOIN
 (SELECT row_id, sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pred FROM log) p
 ON l.row_id = p.row_id AND l.content_type_id = 0""")
def q_j9(spark, d):
    """Predictions kept for question rows, re-expanded to all rows with 0."""
    log = W.user_running(interaction_log(spark, d))
    kept = log.filter("content_type_id = 0").withColumnRenamed("prior_correct_rate", "pred")
    return P.refill_dropped(log, kept, "pred", 0.0)


# ---------------------------------------------------------------- O / D / X ---
@register("O1_multi_key_sort", "row_id:i, sort_pos:i", """
SELECT row_id, row_number() OVER (ORDER BY user_id, timestamp, task_container_id, answered_correctly DESC, row_id)
  AS sort_pos FROM log""")
def q_o1(spark, d):
    """Position in the (user, ts, task, correct desc) order, from a range-partitioned sort."""
    from tracefeat.plans.ranking import global_rank
    log = interaction_log(spark, d).withColumn("_neg_ac", -F.col("answered_correctly"))
    return global_rank(log, ["user_id", "timestamp", "task_container_id", "_neg_ac", "row_id"], name="sort_pos")


@register("O2_last_n_per_user", "row_id:i, user_id:i", f"SELECT row_id, user_id FROM log WHERE row_id IN {_TAIL}")
def q_o2(spark, d):
    return O.last_n_per_user(interaction_log(spark, d), 5)


_ITEM_MEAN = ("(SELECT content_id, sum(answered_correctly) / count(*) AS item_mean FROM log "
              "WHERE content_type_id = 0 GROUP BY content_id)")


@register("O3_top_errors", "row_id:i, mean_error:f", f"""
WITH p AS (SELECT l.row_id, l.answered_correctly AS y, m.item_mean AS a,
  coalesce(sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.5) AS b,
  l.content_type_id FROM log l LEFT JOIN {_ITEM_MEAN} m ON l.content_id = m.content_id)
SELECT row_id, (abs(y - a) + abs(y - b)) / 2 AS mean_error FROM p WHERE content_type_id = 0
ORDER BY mean_error DESC, row_id LIMIT 10""")
def q_o3(spark, d):
    """10 question rows with the largest mean absolute error of two scorers (item mean, prior rate)."""
    from tracefeat.plans import scorers
    p = scorers.two_scores(spark, d)
    p = p.withColumn("mean_error", (F.abs(F.col("y") - F.col("a")) + F.abs(F.col("y") - F.col("b"))) / 2)
    return O.top_k(p, "mean_error", 10)


@register("O4_outliers_topk", "vec_id:i, sq_dist:f2", """
WITH d AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS c FROM d GROUP BY dim)
SELECT vec_id, sum((x - c) * (x - c)) AS sq_dist FROM d JOIN c USING (dim) GROUP BY vec_id
ORDER BY sq_dist DESC, vec_id LIMIT 20""")
def q_o4(spark, d):
    return O.vector_outliers(read_table(spark, d, "embeddings"), 20)


@register("O5_rank_normalize", "row_id:i, score_rank:f", f"""
WITH s AS (SELECT row_id, coalesce(sum(answered_correctly) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   / nullif(count(*) OVER ({WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.5) AS score FROM log)
SELECT row_id, (row_number() OVER (ORDER BY score, row_id) - 1) / count(*) OVER () AS score_rank FROM s""")
def q_o5(spark, d):
    """Double argsort / n of a score, via range-partitioned ranking."""
    s = W.user_running(interaction_log(spark, d)).withColumn(
        "score", F.coalesce(F.col("prior_correct_rate"), F.lit(0.5)))
    return O.rank_normalize(s, "score")


@register("D1_duplicate_task_rows", "row_id:i", f"SELECT row_id FROM {_DUP}")
def q_d1(spark, d):
    return O.duplicate_task_rows(V.tail_split(interaction_log(spark, d)))


@register("D2_dedup_log", "row_id:i, user_id:i", f"SELECT row_id, user_id FROM log WHERE row_id NOT IN {_DUP}")
def q_d2(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    return O.dedup_log(log, O.duplicate_task_rows(log))


@register("X1_union_flagged", "row_id:i, is_val:i", f"""
SELECT row_id, 0 AS is_val FROM log WHERE row_id NOT IN {_TAIL}
UNION ALL SELECT row_id, 1 AS is_val FROM log WHERE row_id IN {_TAIL}""")
def q_x1(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    return O.union_flagged(log.filter("is_val = 0").drop("is_val"), log.filter("is_val = 1").drop("is_val"))


_V7_SQL = """
u AS (SELECT user_id, max(timestamp) AS umax FROM log GROUP BY user_id),
mt AS (SELECT max(umax) AS maxt FROM u),
o AS (SELECT user_id, CAST(floor((maxt - umax) * ((user_id * 7919) % 1000) / 1000) AS BIGINT) AS off FROM u, mt),
vt AS (SELECT l.*, l.timestamp + o.off AS vts FROM log l JOIN o USING (user_id)),
cuts AS (SELECT vt.*, CASE WHEN (row_number() OVER (ORDER BY vts DESC, row_id DESC) - 1) // 1000 + 1 <= 5
   THEN (row_number() OVER (ORDER BY vts DESC, row_id DESC) - 1) // 1000 + 1 ELSE 0 END AS cv FROM vt)"""


@register("X2_adversarial_union", "row_id:i, target:i", f"""
WITH {_V7_SQL}
SELECT row_id, 0 AS target FROM cuts WHERE cv <> 1 UNION ALL SELECT row_id, 1 AS target FROM cuts WHERE cv = 1""")
def q_x2(spark, d):
    """Train (0) vs the last virtual-time cut (1) as an adversarial target."""
    v = V.virtual_time_split(interaction_log(spark, d), val_size=1000)
    return O.adversarial_union(v.filter("cv <> 1"), v.filter("cv = 1"))


@register("X3_drop_list_union", "row_id:i", f"SELECT row_id FROM {_TAIL} UNION SELECT row_id FROM {_DUP}")
def q_x3(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    return O.drop_list_union(log.filter("is_val = 1"), O.duplicate_task_rows(log))


@register("X4_new_keys", "key_kind:s, new_key:i", f"""
WITH {_V7_SQL}
SELECT DISTINCT 'user' AS key_kind, user_id AS new_key FROM cuts
  WHERE cv = 1 AND user_id NOT IN (SELECT user_id FROM cuts WHERE cv <> 1)
UNION ALL SELECT DISTINCT 'content', content_id FROM cuts
  WHERE cv = 1 AND content_type_id = 0
    AND content_id NOT IN (SELECT content_id FROM cuts WHERE cv <> 1 AND content_type_id = 0)""")
def q_x4(spark, d):
    """Users and question items of the last cut absent from its training part."""
    v = V.virtual_time_split(interaction_log(spark, d), val_size=1000)
    tr, va = v.filter("cv <> 1"), v.filter("cv = 1")
    qt, qv = tr.filter("content_type_id = 0"), va.filter("content_type_id = 0")
    u = O.new_keys(va, tr, "user_id").select(F.lit("user").alias("key_kind"), F.col("user_id").alias("new_key"))
    c = O.new_keys(qv, qt, "content_id").select(F.lit("content").alias("key_kind"),
                                                F.col("content_id").cast("long").alias("new_key"))
    return u.unionByName(c)


# ---------------------------------------------------------------- V ----------
@register("V1_kfold", "row_id:i, fold:i, fold_weight:f",
          "SELECT row_id, row_id % 5 AS fold, 0.2 AS fold_weight FROM log")
def q_v1(spark, d):
    """k folds in the modulus form (``method='hash'`` is the seeded shuffle)."""
    return V.kfold(interaction_log(spark, d), 5, method="modulus")


@register("V2_stratified_kfold", "row_id:i, fold:i", """
SELECT row_id, row_number() OVER (PARTITION BY answered_correctly ORDER BY row_id) % 5 AS fold
FROM log WHERE content_type_id = 0""")
def q_v2(spark, d):
    return V.stratified_kfold(interaction_log(spark, d).filter("content_type_id = 0"), "answered_correctly", 5,
                              order="id")


_SNAKE = "CASE WHEN ((r - 1) // 5) % 2 = 0 THEN (r - 1) % 5 ELSE 4 - (r - 1) % 5 END"


@register("V3_group_kfold", "row_id:i, fold:i", f"""
WITH g AS (SELECT user_id, count(*) AS n FROM log GROUP BY user_id),
r AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS r FROM g)
SELECT l.row_id, {_SNAKE} AS fold FROM log l JOIN r USING (user_id)""")
def q_v3(spark, d):
    return V.group_kfold(interaction_log(spark, d), "user_id", 5)


_V4_SQL = """
WITH RECURSIVE
cls AS (SELECT answered_correctly AS v0, content_type_id AS v1, count(*) AS n FROM log GROUP BY ALL),
lab AS (SELECT col, v, n, row_number() OVER (ORDER BY n, col, v) AS pos FROM (
  SELECT 0 AS col, v0 AS v, sum(n) AS n FROM cls GROUP BY v0 UNION ALL SELECT 1, v1, sum(n) FROM cls GROUP BY v1)),
co AS (SELECT c.*, a.pos AS l0, b.pos AS l1, least(a.pos, b.pos) AS main,
  row_number() OVER (ORDER BY least(a.pos, b.pos), v0, v1) AS cn
  FROM cls c JOIN lab a ON a.col = 0 AND a.v = c.v0 JOIN lab b ON b.col = 1 AND b.v = c.v1),
todo AS (SELECT *, row_number() OVER (ORDER BY cn, r) AS i FROM co, (SELECT range AS r FROM range(5)) t WHERE r <= n % 5),
rec AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS cn, CAST(-1 AS BIGINT) AS fold,
    (SELECT list(CAST(n AS BIGINT) ORDER BY pos, f) FROM lab, (SELECT range AS f FROM range(5)) fs) AS need
  UNION ALL
  SELECT i, cn, fold, list_transform(need, lambda x, j: x - CASE WHEN (j - 1) // 5 + 1 IN (l0, l1) THEN
      CASE WHEN r = 0 THEN 5 * (n // 5) WHEN (j - 1) % 5 = fold THEN 5 ELSE 0 END ELSE 0 END)
  FROM (SELECT *, CASE WHEN r = 0 THEN -1 ELSE list_position(score, list_max(score)) - 1 END AS fold FROM (
    SELECT t.i, t.cn, t.r, t.n, t.l0, t.l1, rec.need, list_transform(range(1, 6), lambda f:
      CAST(need[(main - 1) * 5 + f] AS HUGEINT) * 1000000000000 + need[(l0 - 1) * 5 + f] + need[(l1 - 1) * 5 + f]) AS score
    FROM rec JOIN todo t ON t.i = rec.i + 1))),
rest AS (SELECT rec.cn, t.r, rec.fold FROM rec JOIN todo t ON t.i = rec.i WHERE t.r > 0),
p AS (SELECT l.row_id, co.cn, co.n, row_number() OVER (PARTITION BY co.cn ORDER BY row_id) - 1 AS p
      FROM log l JOIN co ON l.answered_correctly = co.v0 AND l.content_type_id = co.v1)
SELECT p.row_id, CAST(CASE WHEN p.p < p.n // 5 * 5 THEN p.p % 5 ELSE rest.fold END AS BIGINT) AS fold
FROM p LEFT JOIN rest ON rest.cn = p.cn AND rest.r = p.p - p.n // 5 * 5 + 1"""


@register("V4_multilabel_stratified_kfold", "row_id:i, fold:i", _V4_SQL)
def q_v4(spark, d):
    """Every value of two label columns in nearly equal shares per fold (id order; the hash order is the default)."""
    return V.multilabel_stratified_kfold(interaction_log(spark, d), ["answered_correctly", "content_type_id"], 5,
                                         order="id")


_V5_SQL = """
WITH RECURSIVE
g AS (SELECT user_id, count(*) FILTER (WHERE answered_correctly = 0) AS c0, count(*) FILTER (WHERE answered_correctly = 1)
        AS c1 FROM qlog WHERE content_type_id = 0 GROUP BY user_id),
tot AS (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM g),
cl AS (SELECT c0, c1, count(*) AS n, row_number() OVER (ORDER BY c0 + c1 DESC, c0, c1) AS cn FROM g GROUP BY c0, c1),
todo AS (SELECT *, row_number() OVER (ORDER BY cn, r) AS i FROM cl, tot, (SELECT range AS r FROM range(5)) t WHERE r <= n % 5),
rec AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS cn, CAST(-1 AS BIGINT) AS fold,
    list_transform(range(5), lambda x: CAST(0 AS DOUBLE)) AS h0, list_transform(range(5), lambda x: CAST(0 AS DOUBLE)) AS h1
  UNION ALL
  SELECT i, cn, fold, list_transform(h0, lambda x, j: x + CASE WHEN r = 0 THEN c0 * (n // 5) WHEN j = fold + 1 THEN c0 ELSE 0 END),
    list_transform(h1, lambda x, j: x + CASE WHEN r = 0 THEN c1 * (n // 5) WHEN j = fold + 1 THEN c1 ELSE 0 END)
  FROM (SELECT *, CASE WHEN r = 0 THEN -1 ELSE list_position(score, list_min(score)) - 1 END AS fold FROM (
    SELECT t.i, t.cn, t.r, t.n, t.c0, t.c1, rec.h0, rec.h1, list_transform(range(1, 6), lambda f: round((
        list_aggregate(list_transform(h0, lambda x, j: (x + CASE WHEN j = f THEN c0 ELSE 0 END) / greatest(t0, 1)), 'stddev_pop')
      + list_aggregate(list_transform(h1, lambda x, j: (x + CASE WHEN j = f THEN c1 ELSE 0 END) / greatest(t1, 1)), 'stddev_pop')
      ) / 2, 12)) AS score
    FROM rec JOIN todo t ON t.i = rec.i + 1))),
rest AS (SELECT rec.cn, t.r, rec.fold FROM rec JOIN todo t ON t.i = rec.i WHERE t.r > 0),
p AS (SELECT g.user_id, cl.cn, cl.n, row_number() OVER (PARTITION BY cl.cn ORDER BY user_id) - 1 AS p
      FROM g JOIN cl ON g.c0 = cl.c0 AND g.c1 = cl.c1),
f AS (SELECT p.user_id, CAST(CASE WHEN p.p < p.n // 5 * 5 THEN p.p % 5 ELSE rest.fold END AS BIGINT) AS fold
      FROM p LEFT JOIN rest ON rest.cn = p.cn AND rest.r = p.p - p.n // 5 * 5 + 1)
SELECT l.row_id, f.fold FROM qlog l JOIN f USING (user_id) WHERE l.content_type_id = 0"""


@register("V5_stratified_group_kfold", "row_id:i, fold:i", _V5_SQL)
def q_v5(spark, d):
    """Users whole in a fold, by the greedy rule of least mean deviation of the label shares."""
    return V.stratified_group_kfold(question_log(spark, d).filter("content_type_id = 0"), "user_id",
                                    "answered_correctly", 5)


@register("V6_tail_split", "row_id:i, is_val:i", f"""
SELECT row_id, CAST(row_id IN {_TAIL} AS INTEGER) AS is_val FROM log""")
def q_v6(spark, d):
    return V.tail_split(interaction_log(spark, d))


@register("V7_virtual_time_split", "row_id:i, viretual_time_stamp:i, cv:i",
          "WITH " + _V7_SQL.replace("// 1000", "// (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM log)")
          + " SELECT row_id, vts AS viretual_time_stamp, cv FROM cuts")
def q_v7(spark, d):
    """Users shifted onto one axis; five cuts of val_size rows from the end (10 % of rows)."""
    return V.virtual_time_split(interaction_log(spark, d))


@register("V8_id_list_split", "row_id:i, is_val:i", f"""
SELECT row_id, CAST(row_id IN {_DUP} AS INTEGER) AS is_val FROM log""")
def q_v8(spark, d):
    """Validation flag from a given id list (here the duplicate-task ids)."""
    log = V.tail_split(interaction_log(spark, d))
    return V.id_list_split(log.drop("is_val"), O.duplicate_task_rows(log))


@register("V9_user_holdout", "row_id:i", """
WITH c AS (SELECT user_id, count(*) AS n FROM log GROUP BY user_id),
b AS (SELECT min(n) AS lo, max(n) AS hi FROM c),
u AS (SELECT user_id, CASE WHEN n = lo THEN 0 ELSE least(CAST(ceil((n - lo) / (hi - lo) * 200) AS BIGINT) - 1, 199) END
      AS n_bin FROM c, b),
f AS (SELECT user_id, row_number() OVER (PARTITION BY n_bin ORDER BY user_id) % 5 AS fold FROM u)
SELECT row_id FROM log WHERE user_id NOT IN (SELECT user_id FROM f WHERE fold = 0)""")
def q_v9(spark, d):
    return V.user_holdout(interaction_log(spark, d), 5, 0)


assert set(LOG_COLUMNS) <= set(LOG_SPEC.replace(":i", "").replace(":f", "").replace(" ", "").split(","))
