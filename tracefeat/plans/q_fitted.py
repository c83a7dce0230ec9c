"""Registered queries for stored encoders, lookups by name and features over the
deduplicated log (H1-H5, section 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import lookup as L
from tracefeat.operators import sets as O
from tracefeat.operators import splits as V
from tracefeat.operators.fitted import CountEncoder, SmoothedEncoder, TargetEncoder, load_encoder
from tracefeat.plans import q_windows  # noqa: F401  (registers F0)
from tracefeat.plans.features import features
from tracefeat.plans.q_encoders import _FOLD_ENC_SQL
from tracefeat.plans.q_evaluate import _LOGIT, TS, _logit, _scores, auc_sql
from tracefeat.plans.q_prep import _DUP, _TAIL
from tracefeat.plans.registry import REGISTRY, register
from tracefeat.sources import io
from tracefeat.sources.binding import interaction_log


@register("H1_count_encoder_stored", "row_id:i, content_id_count:i", """
SELECT l.row_id, c.n AS content_id_count FROM log l LEFT JOIN
  (SELECT content_id, count(*) AS n FROM log GROUP BY content_id) c USING (content_id)""")
def q_h1(spark, d):
    """Count encoder fitted on the training part, stored, reloaded, the held-out part added, applied to all rows."""
    log = V.tail_split(interaction_log(spark, d))
    path = CountEncoder("content_id").fit(log.filter("is_val = 0")).save(io.fresh_path(spark, "count-encoder"))
    return load_encoder(spark, path).add(log.filter("is_val = 1")).transform(log)


@register("H2_target_encoder_stored", "row_id:i, te_content_id_by_answered_correctly:f", f"""
WITH {_FOLD_ENC_SQL},
m AS (SELECT content_id, CASE WHEN count(te) = 5 THEN sum(te) / 5 END AS te FROM enc GROUP BY content_id)
SELECT l.row_id, m.te AS te_content_id_by_answered_correctly FROM log l LEFT JOIN m USING (content_id)
WHERE l.row_id IN {_TAIL}""")
def q_h2(spark, d):
    """Target encoder fitted over 5 folds of the training part, stored, reloaded, applied to the held-out part."""
    log = V.tail_split(interaction_log(spark, d))
    train = L.assign_folds(log.filter("is_val = 0"), "KFold", k=5, method="modulus")
    enc = TargetEncoder("content_id", "answered_correctly", 5).fit(train)
    return load_encoder(spark, enc.save(io.fresh_path(spark, "target-encoder"))).transform(log.filter("is_val = 1"))


@register("H3_smoothed_encoder_stored", "row_id:i, content_idxxxcontent_type_id__answered_correctly_sm5:f", """
WITH g AS (SELECT avg(answered_correctly) AS m FROM log),
t AS (SELECT content_id, content_type_id, (sum(answered_correctly) + 5 * (SELECT m FROM g)) / (count(*) + 5) AS te
      FROM log GROUP BY content_id, content_type_id)
SELECT l.row_id, t.te AS content_idxxxcontent_type_id__answered_correctly_sm5
FROM log l JOIN t USING (content_id, content_type_id)""")
def q_h3(spark, d):
    """Smoothed encoder on two keys, fitted on one part, stored, reloaded, the other part added."""
    log = V.tail_split(interaction_log(spark, d))
    enc = SmoothedEncoder(["content_id", "content_type_id"], "answered_correctly").fit(log.filter("is_val = 0"))
    enc = load_encoder(spark, enc.save(io.fresh_path(spark, "smoothed-encoder")))
    return enc.add(log.filter("is_val = 1")).transform(log)


@register("H4_lookup_by_name", "name:s, value:f", f"""
WITH {TS}, l AS (SELECT y, {_LOGIT} AS z FROM ts)
SELECT 'auc' AS name, auc AS value FROM {auc_sql('ts', 'a')}
UNION ALL SELECT 'BCEWithLogitsLoss', avg(greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))) FROM l
UNION ALL SELECT 'SmoothBCEwLogits', avg(greatest(z, 0.0) - z * (y * (1.0 - 0.1) + 0.5 * 0.1) + ln(1 + exp(-abs(z)))) FROM l""")
def q_h4(spark, d):
    """Metric and losses of the item-mean scorer, found by their names."""
    s = _scores(spark, d).withColumn("z", _logit("a"))
    out = L.metric(s, "auc", "y", "a").select(F.lit("auc").alias("name"), "value")
    for name, params in (("BCEWithLogitsLoss", {}), ("SmoothBCEwLogits", {"smoothing": 0.1})):
        out = out.unionByName(L.loss(s, name, "y", "z", **params).select(F.lit(name).alias("name"),
                                                                         F.col("loss").alias("value")))
    return out


def _dropped_log(spark, d):
    """The log without the second and later rows of each (user, task) of the training part."""
    log = V.tail_split(interaction_log(spark, d))
    return O.dedup_log(log, O.duplicate_task_rows(log)).drop("is_val")


def _register_dropped():
    f0 = REGISTRY["F0_flagship"]
    keys = ("row_id", "user_id")
    spec = ", ".join(f"{n if n in keys else 'dropped___' + n}:{k}" for n, k in f0.spec)
    names = ", ".join(n if n in keys else f"{n} AS dropped___{n}" for n, _ in f0.spec)
    sql = f"""
WITH dropped AS (SELECT * FROM log WHERE row_id NOT IN {_DUP}),
f0 AS ({f0.sql.replace(' FROM log', ' FROM dropped')})
SELECT {names} FROM f0"""

    @register("H5_dropped_features", spec, sql)
    def q_h5(spark, d):
        """W1, W4 and W5 over the task-deduplicated log, under the prefix of that source."""
        return features(_dropped_log(spark, d), ["W1", "W4", "W5"], prefix="dropped___")


_register_dropped()
