"""Shared derived frames: the answered-question table ``x`` with the weighted
targets and entity bins, its repeat and elapsed-time tables; and the DuckDB
text of the same frames for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefeat.operators import encoders as A
from tracefeat.operators import splits as V
from tracefeat.sources.binding import interaction_log, question_log, questions

# Upper edges of the user-experience bins (prior answered questions).
U_CNT_EDGES = [10, 30, 100, 300, 1000]
SESSION_GAP_FIXTURE_MS = 43_200_000   # 12 h: the fixture's mean gap is ~10 h


def u_cnt_cat(c) -> F.Column:
    e = F.lit(len(U_CNT_EDGES))
    for i, edge in reversed(list(enumerate(U_CNT_EDGES))):
        e = F.when(c < edge, F.lit(i)).otherwise(e)
    return e


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Question rows with had_explanation as 0/1, u_cnt_cat and u_hist_ques_ansed."""
    x0 = question_log(spark, d).filter(F.col("content_type_id") == 0)
    wu = Window.partitionBy("user_id").orderBy("timestamp", "row_id")
    wuc = Window.partitionBy("user_id", "content_id").orderBy("timestamp", "row_id")
    return x0.withColumns({
        "prior_question_had_explanation": F.coalesce(F.col("prior_question_had_explanation"), F.lit(False))
        .cast("int"),
        "u_cnt_cat": u_cnt_cat(F.row_number().over(wu) - 1),
        "u_hist_ques_ansed": (F.row_number().over(wuc) > 1).cast("int"),
    })


def train_x(spark: SparkSession, d: str) -> DataFrame:
    x = answered(spark, d)
    return A.with_choice_targets(x, A.choice_weights(x, questions(spark, d)))


def folded_log(spark: SparkSession, d: str) -> DataFrame:
    return V.kfold(interaction_log(spark, d), 5, method="modulus")


# ---------------------------------------------------------------- SQL ---------
_U_CNT_SQL = "CASE " + " ".join(f"WHEN rn0 < {e} THEN {i}" for i, e in enumerate(U_CNT_EDGES)) + \
    f" ELSE {len(U_CNT_EDGES)} END"

X_SQL = f"""
x0 AS (SELECT row_id, user_id, timestamp, content_id, content_type_id, task_container_id, user_answer,
          answered_correctly, prior_question_elapsed_time,
          CAST(coalesce(prior_question_had_explanation, false) AS INTEGER) AS prior_question_had_explanation,
          part, tags, correct_answer,
          row_number() OVER (PARTITION BY user_id ORDER BY timestamp, row_id) - 1 AS rn0,
          row_number() OVER (PARTITION BY user_id, content_id ORDER BY timestamp, row_id) AS rnc
       FROM qlog WHERE content_type_id = 0),
cw0 AS (SELECT content_id, user_answer, count(*) AS cnt FROM x0 GROUP BY content_id, user_answer),
cc AS (SELECT content_id, count(*) AS c_count FROM x0 GROUP BY content_id),
cw1 AS (SELECT cw0.content_id, cw0.user_answer, cw0.cnt, cc.c_count, cw0.cnt / cc.c_count AS choice_rate,
          CAST(cw0.user_answer = q.correct_answer AS INTEGER) AS ac
        FROM cw0 JOIN cc USING (content_id) LEFT JOIN questions q ON cw0.content_id = q.question_id),
cw AS (SELECT *, (1.0 - ac * choice_rate) * ac AS weighted_answered_correctly,
         1.0 - coalesce(sum(choice_rate) OVER (PARTITION BY content_id ORDER BY ac DESC, choice_rate DESC, user_answer
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weighted_score FROM cw1),
x AS (SELECT x0.*, {_U_CNT_SQL} AS u_cnt_cat, CAST(rnc > 1 AS INTEGER) AS u_hist_ques_ansed,
         cw.weighted_answered_correctly, cw.weighted_score
      FROM x0 LEFT JOIN cw ON x0.content_id = cw.content_id AND x0.user_answer = cw.user_answer),
rep AS (SELECT * FROM x WHERE u_hist_ques_ansed = 1),
et AS (SELECT * FROM (SELECT *, lead(prior_question_elapsed_time) OVER (PARTITION BY user_id ORDER BY timestamp, row_id)
          AS question_elapsed_time FROM x) WHERE question_elapsed_time IS NOT NULL),
gm AS (SELECT avg(answered_correctly) AS answered_correctly_mean,
          avg(weighted_answered_correctly) AS weighted_answered_correctly_mean,
          avg(weighted_score) AS weighted_score_mean FROM x)"""

TARGETS = ("answered_correctly", "weighted_answered_correctly", "weighted_score")


def entity_sql(keys, parts, s: int = 5) -> str:
    """DuckDB text of ``encoders.entity_table`` over the CTEs of ``X_SQL``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = "xxx".join(keys)
    kl = ", ".join(keys)
    blocks = []
    if "count_std" in parts:
        blocks.append(f"SELECT {kl}, count(answered_correctly) AS {k}__count, stddev_samp(answered_correctly) "
                      f"AS {k}__std FROM x GROUP BY {kl}")
    if "count_std_repeat" in parts:
        blocks.append(f"SELECT {kl}, count(answered_correctly) AS {k}__count_repeat, "
                      f"stddev_samp(answered_correctly) AS {k}__std_repeat FROM rep GROUP BY {kl}")
    if "unique_user" in parts:
        blocks.append(f"SELECT {kl}, count(DISTINCT user_id) AS {k}__unique_user FROM x GROUP BY {kl}")
    for t in TARGETS:
        for part, src, suf in (("te", "x", ""), ("te_repeat", "rep", "_repeat")):
            if part in parts:
                blocks.append(f"SELECT {kl}, (sum({t}) + {s} * (SELECT {t}_mean FROM gm)) / (count({t}) + {s}) "
                              f"AS {k}__{t}_sm{s}{suf} FROM {src} GROUP BY {kl}")
    if "te_target" in parts:
        t = "answered_correctly"
        blocks.append(f"SELECT {kl}, (sum({t}) + {s} * (SELECT {t}_mean FROM gm)) / (count({t}) + {s}) "
                      f"AS {k}__{t}_sm{s} FROM x GROUP BY {kl}")
    for part, t in (("entropy_answer", "user_answer"), ("entropy_target", "answered_correctly")):
        if part in parts:
            blocks.append(f"SELECT {kl}, -sum(p * ln(p)) AS {k}__entropy__{t} FROM (SELECT {kl}, "
                          f"c / sum(c) OVER (PARTITION BY {kl}) AS p FROM (SELECT {kl}, {t}, count(*) AS c FROM x "
                          f"GROUP BY {kl}, {t})) GROUP BY {kl}")
    if "te_elapsed" in parts:
        blocks.append(f"SELECT {kl}, (sum(question_elapsed_time) + {s} * (SELECT avg(question_elapsed_time) FROM et))"
                      f" / (count(question_elapsed_time) + {s}) AS {k}__question_elapsed_time_sm{s} "
                      f"FROM et GROUP BY {kl}")
    sql = f"SELECT * FROM (SELECT DISTINCT {kl} FROM x) AS base"
    for i, b in enumerate(blocks):
        sql += f"\n LEFT JOIN ({b}) AS b{i} USING ({kl})"
    return sql


def entity_cols(keys, parts, s: int = 5) -> list[tuple[str, str]]:
    """Output columns (name, spec kind) of ``entity_table`` for the given parts."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = "xxx".join(keys)
    cols = [(c, "i") for c in keys]
    if "count_std" in parts:
        cols += [(f"{k}__count", "i"), (f"{k}__std", "f")]
    if "count_std_repeat" in parts:
        cols += [(f"{k}__count_repeat", "i"), (f"{k}__std_repeat", "f")]
    if "unique_user" in parts:
        cols += [(f"{k}__unique_user", "i")]
    for t in TARGETS:
        if "te" in parts:
            cols.append((f"{k}__{t}_sm{s}", "f"))
        if "te_repeat" in parts:
            cols.append((f"{k}__{t}_sm{s}_repeat", "f"))
    if "te_target" in parts:
        cols.append((f"{k}__answered_correctly_sm{s}", "f"))
    if "entropy_answer" in parts:
        cols.append((f"{k}__entropy__user_answer", "f"))
    if "entropy_target" in parts:
        cols.append((f"{k}__entropy__answered_correctly", "f"))
    if "te_elapsed" in parts:
        cols.append((f"{k}__question_elapsed_time_sm{s}", "f2"))
    return cols


def spec_text(cols) -> str:
    return ", ".join(f"{n}:{k}" for n, k in cols)
