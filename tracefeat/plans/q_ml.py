"""Registered queries for the matrix / model operators M1-M8 and E11.

Only M1 (and the M6 token table) have a SQL form; the learned outputs are
checked by row counts here and by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import evaluate as E
from tracefeat.operators import ml as M
from tracefeat.operators import splits as V
from tracefeat.operators import windows as W
from tracefeat.plans.registry import register
from tracefeat.sources import io
from tracefeat.sources.binding import interaction_log, question_log, questions

FEATURES = ["prior_correct_rate", "answered_correctly_rolling3", "part", "prior_question_elapsed_time",
            "timestamp_diff1"]
K_FOLDS = 3


@register("M1_cooccurrence_matrix", "content_id:i, user_id:i, index_code:i, column_code:i, value:i", """
SELECT content_id, user_id, dense_rank() OVER (ORDER BY content_id) - 1 AS index_code,
  dense_rank() OVER (ORDER BY user_id) - 1 AS column_code, value
FROM (SELECT content_id, user_id, count(*) AS value FROM log WHERE content_type_id = 0 GROUP BY content_id, user_id)""")
def q_m1(spark, d):
    """Item x user counts with sorted 0-based codes (distributed ranking of the keys)."""
    return M.cooccurrence_matrix(interaction_log(spark, d).filter("content_type_id = 0"), "content_id", "user_id")


def _svd(spark, d):
    x = interaction_log(spark, d).filter("content_type_id = 0")
    return M.svd_embedding(x, "content_id", "user_id", 5)


@register("M2_svd_embedding", ", ".join(["content_id:i"] + [f"content_id__svd_{j}:f" for j in range(5)]))
def q_m2(spark, d):
    """5-dim truncated SVD of the item x user binary incidence (block Krylov iteration over tables)."""
    return _svd(spark, d)[0]


@register("M3_tag_word2vec", "tag:s, w2v:af")
def q_m3(spark, d):
    """32-dim tag vectors from the question tag lists and shuffled copies (MLlib Word2Vec in partitions)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return M.tag_word2vec(questions(spark, d), size=32, window=128, partitions=n)


@register("M3b_tag_ppmi_vectors", "tag:s, vec:af")
def q_m3b(spark, d):
    """32-dim tag vectors: factored mutual information of the tags that questions carry together."""
    return M.tag_ppmi_vectors(questions(spark, d), size=32, window=128)


@register("M4_item_projection_2d", "content_id:i, content_id_proj_0:f, content_id_proj_1:f")
def q_m4(spark, d):
    """2-D map of the items: first two principal components of their SVD embedding."""
    emb, _ = _svd(spark, d)
    return M.item_projection_2d(emb, "content_id", [f"content_id__svd_{j}" for j in range(5)])


@register("M5_item_clusters", "content_id:i, cluster:i")
def q_m5(spark, d):
    """z-scored 2-D item map clustered by KMeans (k = 20 on the fixture)."""
    emb, _ = _svd(spark, d)
    proj = M.item_projection_2d(emb, "content_id", [f"content_id__svd_{j}" for j in range(5)])
    return M.item_clusters(proj, "content_id", ["content_id_proj_0", "content_id_proj_1"], k=20)


@register("M6_topic_vectors", "user_id:i, " + ", ".join(f"topic_{i}:f" for i in range(10)))
def q_m6(spark, d):
    """10-topic LDA mixture of each user's item document (repeated items as counts)."""
    x = interaction_log(spark, d).filter("content_type_id = 0")
    return M.topic_vectors(x, "user_id", "content_id", 10, unique=False, max_iter=10)


@register("M6b_token_documents", "user_id:i, n_tokens:i", """
SELECT user_id, count(DISTINCT content_id) AS n_tokens FROM log WHERE content_type_id = 0 GROUP BY user_id""")
def q_m6b(spark, d):
    """Distinct-token documents per user (the LDA input)."""
    docs = M.token_documents(interaction_log(spark, d).filter("content_type_id = 0"), "user_id", "content_id")
    return docs.select("user_id", F.size("tokens").alias("n_tokens"))


def _train_frame(spark, d):
    df = W.time_diffs(W.rolling_prior_mean(W.user_running(question_log(spark, d)), (3,)), (1,))
    df = df.filter("content_type_id = 0").withColumn("y", F.col("answered_correctly").cast("double"))
    df = df.withColumn("part", F.col("part").cast("double"))
    return V.kfold(df, K_FOLDS, method="modulus")


@register("M7_gbt_cv", "row_id:i, fold:i, pred:f")
def q_m7(spark, d):
    """Per fold a GBT fitted on the other folds scores its fold: the OOF table."""
    oof, _ = M.gbt_cv(_train_frame(spark, d), FEATURES, "y", "fold", K_FOLDS, max_iter=10, max_depth=4)
    return oof


@register("E11_importance_table", "feature:s, importance_mean:f, importance_std:f")
def q_e11(spark, d):
    """GBT feature importances stacked over folds: mean and std per feature, sorted."""
    _, imp = M.gbt_cv(_train_frame(spark, d), FEATURES, "y", "fold", K_FOLDS, max_iter=10, max_depth=4)
    return E.importance_table(imp)


@register("M8_model_scoring", "row_id:i, pred:f")
def q_m8(spark, d):
    """Held-out tail rows scored by every fold model, stored and reloaded (JVM transform), weighted 1/k."""
    df = _train_frame(spark, d)
    tail = V.tail_split(interaction_log(spark, d)).select("row_id", "is_val")
    df = df.join(tail, "row_id")
    models = M.fit_fold_models(df.filter("is_val = 0"), FEATURES, "y", "fold", K_FOLDS)
    models = M.load_models(spark, M.save_models(models, io.fresh_path(spark, "fold-models")))
    return M.score_with_models(df.filter("is_val = 1"), models, FEATURES)
