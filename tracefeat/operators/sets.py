"""Sorts, top-k, dedup and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.plans.ranking import global_rank


# O1 ------------------------------------------------------------------------
def multi_key_sort(df: DataFrame) -> DataFrame:
    """user asc, timestamp asc, task asc, correct desc (row_id last for determinism).
    A range-partitioned total sort: no single-task step."""
    return df.orderBy(F.col("user_id").asc(), F.col("timestamp").asc(), F.col("task_container_id").asc(),
                      F.col("answered_correctly").desc(), F.col("row_id").asc())


# O2 ------------------------------------------------------------------------
def last_n_per_user(df: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("row_id").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


# O3 / O4 -------------------------------------------------------------------
def top_k(df: DataFrame, score: str, k: int, tie: str = "row_id") -> DataFrame:
    """The k rows of largest ``score``; Spark plans orderBy+limit as a per-partition
    top-k followed by a merge of k rows per partition."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)


def vector_outliers(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"):
    """The k vectors farthest (squared distance) from the centroid.

    The centroid is a per-dimension average (one row per dimension, so its size
    is bounded by the vector width); distances are per-vector sums."""
    dims = vectors.select(id_col, F.posexplode(vec_col).alias("dim", "x"))
    centroid = dims.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    d = (dims.join(F.broadcast(centroid), "dim")
         .groupBy(id_col).agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("sq_dist")))
    return top_k(d, "sq_dist", k, id_col)


# O5 ------------------------------------------------------------------------
def rank_normalize(df: DataFrame, score: str, name: str | None = None) -> DataFrame:
    """(position - 1) / n in score order, ties broken by row_id (a double argsort / n)."""
    name = name or f"{score}_rank"
    r = global_rank(df, [score, "row_id"], name="_pos", total_name="_total")
    return r.withColumn(name, (F.col("_pos") - 1) / F.col("_total")).drop("_pos", "_total")


# D1 / D2 -------------------------------------------------------------------
def duplicate_task_rows(df: DataFrame, is_val: str | None = "is_val") -> DataFrame:
    """row_id of the 2nd+ rows of each (user, task) after the O1 order, validation rows removed first."""
    if is_val:
        df = df.filter(F.col(is_val) == 0)
    w = Window.partitionBy("user_id", "task_container_id").orderBy(
        F.col("timestamp").asc(), F.col("answered_correctly").desc(), F.col("row_id").asc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > 1).select("row_id")


def dedup_log(df: DataFrame, dup_ids: DataFrame) -> DataFrame:
    return df.join(dup_ids, "row_id", "left_anti")


# X1 / X2 / X3 / X4 ---------------------------------------------------------
def union_flagged(train: DataFrame, valid: DataFrame, flag: str = "is_val") -> DataFrame:
    return (train.withColumn(flag, F.lit(0))
            .unionByName(valid.withColumn(flag, F.lit(1)), allowMissingColumns=True))


def adversarial_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """train labelled 0, test labelled 1 as the target of an adversarial check."""
    return union_flagged(train, test, "target")


def drop_list_union(*lists: DataFrame, key: str = "row_id") -> DataFrame:
    out = lists[0].select(key)
    for other in lists[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def new_keys(valid: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``valid`` absent from ``train``."""
    return valid.select(key).distinct().join(train.select(key).distinct(), key, "left_anti")
