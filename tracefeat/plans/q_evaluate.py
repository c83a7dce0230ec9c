"""Registered queries for evaluation and blending E1-E12.

Models are the two deterministic stand-in scorers of ``plans.scorers``:
``a`` = item mean target, ``b`` = user's prior correct rate (0.5 if none),
plus ``c`` = the user's rolling-3 rate (``b`` when short) for the 3-way blend.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import encoders as A
from tracefeat.operators import evaluate as E
from tracefeat.operators import sets as O
from tracefeat.operators import splits as V
from tracefeat.operators import windows as W
from tracefeat.plans import scorers
from tracefeat.plans.registry import register
from tracefeat.sources.binding import interaction_log

WU = "PARTITION BY user_id ORDER BY timestamp, row_id"
PRIOR = f"{WU} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
TS = f"""
ts AS (SELECT q.row_id, q.user_id, q.content_id, q.task_container_id, q.part, q.timestamp, q.answered_correctly AS y,
         m.item_mean AS a, coalesce(q.b0, 0.5) AS b, coalesce(q.r3, coalesce(q.b0, 0.5)) AS c
       FROM (SELECT *, sum(answered_correctly) OVER ({PRIOR}) / nullif(count(*) OVER ({PRIOR}), 0) AS b0,
               CASE WHEN count(*) OVER ({WU} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
                    THEN sum(answered_correctly) OVER ({WU} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / 3 END AS r3
             FROM qlog) q
       LEFT JOIN (SELECT content_id, sum(answered_correctly) / count(*) AS item_mean FROM qlog
                  WHERE content_type_id = 0 GROUP BY content_id) m USING (content_id)
       WHERE q.content_type_id = 0)"""


def auc_sql(src: str, score: str, by: str = "", label: str = "y") -> str:
    """DuckDB text of the tie-aware rank AUC of ``score`` per ``by``."""
    gb = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {gb}sum(pos * (nb + neg / 2.0)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM (SELECT {gb}{score}, sum({label}) AS pos, count(*) - sum({label}) AS neg FROM {src} GROUP BY {gb}{score}))
  {"GROUP BY " + by if by else ""})"""


def _scores(spark, d):
    s = scorers.two_scores(spark, d)
    return s


def _scores3(spark, d):
    log = W.rolling_prior_mean(W.user_running(interaction_log(spark, d)), (3,))
    r3 = log.select("row_id", "answered_correctly_rolling3")
    s = scorers.two_scores(spark, d).join(r3, "row_id", "left")
    return s.withColumn("c", F.coalesce(F.col("answered_correctly_rolling3"), F.col("b")))


@register("E1_auc", "auc:f", f"WITH {TS} SELECT * FROM {auc_sql('ts', 'a')}")
def q_e1(spark, d):
    """AUC of the item-mean scorer over all question rows (ties count half)."""
    return E.auc(_scores(spark, d), "y", "a")


@register("E2_auc_by_segment", "part:i, auc:f", f"WITH {TS} SELECT * FROM {auc_sql('ts', 'b', 'part')}")
def q_e2(spark, d):
    """AUC of the prior-rate scorer per part."""
    return E.auc(_scores(spark, d), "y", "b", ["part"])


_OOF = f"""
k AS (SELECT row_id, row_id % 5 AS fold, content_id, answered_correctly AS t FROM qlog WHERE content_type_id = 0),
fs AS (SELECT content_id, fold, sum(t) AS s, count(t) AS n FROM k GROUP BY content_id, fold),
tot AS (SELECT content_id, sum(t) AS S, count(t) AS N FROM k GROUP BY content_id),
oof AS (SELECT k.row_id, k.fold, k.t AS y, coalesce((tot.S - fs.s) / nullif(tot.N - fs.n, 0), 0.5) AS pred
        FROM k JOIN fs USING (content_id, fold) JOIN tot USING (content_id))"""


def _oof(spark, d):
    q = V.kfold(interaction_log(spark, d).filter("content_type_id = 0"), 5, method="modulus")
    te = A.target_encoding_oof(q, "content_id", "answered_correctly", name="_te")
    return te.select("row_id", "fold", F.col("answered_correctly").alias("y"),
                     F.coalesce(F.col("_te"), F.lit(0.5)).alias("pred"))


@register("E3_oof_table", "row_id:i, fold:i, pred:f", f"WITH {_OOF} SELECT row_id, fold, pred FROM oof")
def q_e3(spark, d):
    """Out-of-fold predictions (item mean of the other folds) stacked over 5 folds."""
    o = _oof(spark, d)
    return E.oof_table([o.filter(F.col("fold") == f) for f in range(5)])


@register("E3b_cv_score", "fold:i, auc:f", f"""
WITH {_OOF}, per AS (SELECT * FROM {auc_sql('oof', 'pred', 'fold')})
SELECT fold, auc FROM per UNION ALL SELECT -1 AS fold, avg(auc) AS auc FROM per""")
def q_e3b(spark, d):
    """Per-fold AUC of the OOF table and their mean (fold -1)."""
    return E.cv_score(_oof(spark, d), "y", "pred")


_FOLD_ENC = f"""
tr AS (SELECT row_id, row_id % 5 AS fold, content_id, answered_correctly AS t FROM log WHERE row_id NOT IN
  (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC)
   AS rn FROM log) WHERE rn <= 5)),
fs AS (SELECT content_id, fold, sum(t) AS s, count(t) AS n FROM tr GROUP BY content_id, fold),
tot AS (SELECT content_id, sum(t) AS S, count(t) AS N FROM tr GROUP BY content_id),
g AS (SELECT tot.content_id, f.fold, tot.S, tot.N FROM tot, (SELECT range AS fold FROM range(5)) f),
enc AS (SELECT g.content_id, g.fold, (g.S - coalesce(fs.s, 0)) / (g.N - coalesce(fs.n, 0)) AS te FROM g
        LEFT JOIN fs ON g.content_id = fs.content_id AND g.fold = fs.fold WHERE g.N - coalesce(fs.n, 0) > 0)"""


@register("E4_fold_mean_predictions", "row_id:i, pred_mean:f", f"""
WITH {_FOLD_ENC}
SELECT l.row_id, avg(enc.te) AS pred_mean FROM log l JOIN enc USING (content_id) WHERE l.row_id IN
  (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC)
   AS rn FROM log) WHERE rn <= 5) GROUP BY l.row_id""")
def q_e4(spark, d):
    """Held-out rows scored by each of the 5 fold models (fold encoders), averaged."""
    log = V.tail_split(interaction_log(spark, d))
    tr = V.kfold(log.filter("is_val = 0"), 5, method="modulus")
    enc = A.fold_encoders(tr, "content_id", "answered_correctly", 5)
    preds = log.filter("is_val = 1").select("row_id", "content_id").join(enc, "content_id").withColumnRenamed(
        "te", "pred")
    return E.fold_mean_predictions(preds)


@register("E5_blend", "row_id:i, blend:f, blend_rank:f", f"""
WITH {TS},
r AS (SELECT *, (row_number() OVER (ORDER BY a, row_id) - 1) / count(*) OVER () AS ra,
             (row_number() OVER (ORDER BY b, row_id) - 1) / count(*) OVER () AS rb FROM ts)
SELECT row_id, 0.0 + a * {0.63!r} + b * {0.37!r} AS blend, 0.0 + ra * {0.63!r} + rb * {0.37!r} AS blend_rank FROM r""")
def q_e5(spark, d):
    """0.63 a + 0.37 b, raw and on rank-normalised scores."""
    s = O.rank_normalize(O.rank_normalize(_scores(spark, d), "a", "ra"), "b", "rb")
    s = E.blend(s, ["a", "b"], [0.63, 0.37], "blend")
    return E.blend(s, ["ra", "rb"], [0.63, 0.37], "blend_rank")


_GRID2 = [(i / 100, (100 - i) / 100) for i in range(100)]
_GRID3 = E.weight_grid(3, 0.1)


def _grid_sql(grid, cols):
    vals = ", ".join("(" + ", ".join([str(i)] + [repr(float(w)) for w in g]) + ")" for i, g in enumerate(grid))
    wn = ", ".join(f"w{j}" for j in range(len(cols)))
    score = "0.0 + " + " + ".join(f"{c} * w{j}" for j, c in enumerate(cols))
    return f"""
wg AS (SELECT * FROM (VALUES {vals}) AS t(gid, {wn})),
x AS (SELECT gid, y, {score} AS score FROM ts, wg),
res AS (SELECT gid, auc FROM {auc_sql('x', 'score', 'gid')})
SELECT {wn}, auc FROM res JOIN wg USING (gid)"""


@register("E6_blend_grid_2", "w0:f, w1:f, auc:f", f"WITH {TS}, {_grid_sql(_GRID2, ['a', 'b'])}")
def q_e6(spark, d):
    """AUC of w a + (1-w) b for w = 0.00 .. 0.99 (best row: ``best_weights``)."""
    return E.blend_search(_scores(spark, d), ["a", "b"], _GRID2)


@register("E7_blend_simplex", "w0:f, w1:f, w2:f, auc:f", f"WITH {TS}, {_grid_sql(_GRID3, ['a', 'b', 'c'])}")
def q_e7(spark, d):
    """AUC of every 3-model weight vector on a 0.1 simplex grid (last = 1 - rest)."""
    return E.blend_search(_scores3(spark, d), ["a", "b", "c"], _GRID3)


_GRID3_FINE = E.weight_grid(3, 0.01)


@register("E7b_blend_simplex_fine", "w0:f, w1:f, w2:f, auc:f", f"""
WITH {TS}, ts3 AS (SELECT a, b, c, sum(y) AS pos, count(*) - sum(y) AS neg FROM ts GROUP BY a, b, c),
wg AS (SELECT i * 101 + j AS gid, i / 100 AS w0, j / 100 AS w1, (100 - i - j) / 100 AS w2
       FROM (SELECT range AS i FROM range(101)) p, (SELECT range AS j FROM range(101)) q WHERE i + j <= 100),
s AS (SELECT gid, 0.0 + a * w0 + b * w1 + c * w2 AS score, sum(pos) AS pos, sum(neg) AS neg FROM ts3, wg GROUP BY ALL),
u AS (SELECT gid, pos, neg, coalesce(sum(neg) OVER (PARTITION BY gid ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS nb FROM s),
res AS (SELECT gid, sum(pos * (nb + neg / 2.0)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM u GROUP BY gid)
SELECT w0, w1, w2, auc FROM res JOIN wg USING (gid)""")
def q_e7b(spark, d):
    """AUC of all 5,151 three-model weight vectors on a 0.01 simplex grid (last = 1 - rest)."""
    return E.blend_search(_scores3(spark, d), ["a", "b", "c"], _GRID3_FINE)


@register("E8_task_mean_smoothing", "row_id:i, pred_smoothed:f", f"""
WITH {TS} SELECT row_id, b * 0.8 + avg(b) OVER (PARTITION BY user_id, task_container_id) * 0.1 + a * 0.1
  AS pred_smoothed FROM ts""")
def q_e8(spark, d):
    """0.8 pred + 0.1 mean pred of the (user, task) + 0.1 item encoding."""
    return E.task_mean_smoothing(_scores(spark, d), "b", "a")


_LOGIT = "ln(least(greatest(a, 1e-06), 1 - 1e-06) / (1 - least(greatest(a, 1e-06), 1 - 1e-06)))"


def _logit(c):
    p = F.least(F.greatest(F.col(c), F.lit(1e-06)), F.lit(1 - 1e-06))
    return F.log(p / (1 - p))


@register("E9_label_smoothing_bce", "loss:f", f"""
WITH {TS}, l AS (SELECT y, {_LOGIT} AS z FROM ts)
SELECT avg(greatest(z, 0.0) - z * (y * (1.0 - 0.1) + 0.5 * 0.1) + ln(1 + exp(-abs(z)))) AS loss FROM l""")
def q_e9(spark, d):
    """Mean BCE-with-logits of the item-mean logit against targets smoothed by 0.1."""
    s = _scores(spark, d).withColumn("z", _logit("a"))
    return E.mean_loss(s, "z", "y", 0.1)


@register("E10_model_disagreement", "row_id:i, err_a:f, err_b:f, err_diff:f, err_mean:f", f"""
WITH {TS} SELECT row_id, abs(y - a) AS err_a, abs(y - b) AS err_b, abs(y - a) - abs(y - b) AS err_diff,
  (abs(y - a) + abs(y - b)) / 2 AS err_mean FROM ts""")
def q_e10(spark, d):
    return E.model_disagreement(_scores(spark, d), "a", "b")


@register("E12_accuracy_at_half", "accuracy:f", f"""
WITH {TS} SELECT avg(CAST(CAST(1.0 / (1.0 + exp(-({_LOGIT}))) >= 0.5 AS INTEGER) = y AS INTEGER)) AS accuracy FROM ts""")
def q_e12(spark, d):
    """Share of rows where sigmoid(logit) >= 0.5 matches the label."""
    return E.accuracy_at_half(_scores(spark, d).withColumn("z", _logit("a")), "z", "y")
