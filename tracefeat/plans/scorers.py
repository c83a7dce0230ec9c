"""Two deterministic stand-in model scores per question row.

``a`` = the item's mean target over question rows, ``b`` = the user's prior
correct rate (0.5 before any history).  Evaluation and blending operators are
exercised on these in place of trained models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.operators import windows as W
from tracefeat.plans.joins import dim_join
from tracefeat.sources.binding import question_log


def item_mean(log: DataFrame) -> DataFrame:
    q = log.filter(F.col("content_type_id") == 0)
    return q.groupBy("content_id").agg((F.sum("answered_correctly") / F.count(F.lit(1))).alias("item_mean"))


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = W.user_running(question_log(spark, sf_dir))
    log = dim_join(log, item_mean(log), ["content_id"], "left")
    return (log.filter(F.col("content_type_id") == 0)
            .select("row_id", "user_id", "content_id", "task_container_id", "part", "timestamp",
                    F.col("answered_correctly").alias("y"), F.col("item_mean").alias("a"),
                    F.coalesce(F.col("prior_correct_rate"), F.lit(0.5)).alias("b")))
