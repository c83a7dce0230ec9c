"""Binding of the driver's tables to the interaction-log data model.

``events`` becomes the interaction log, ``part`` the question and lecture
dimensions, ``lineitem`` a second, larger log.  Every later operator reads
only these frames, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefeat.functions.columns import epoch_millis
from tracefeat.plans.joins import MAX_BROADCAST_ROWS, dim_join

LOG_COLUMNS = [
    "row_id", "user_id", "timestamp", "content_id", "content_type_id", "task_container_id",
    "user_answer", "answered_correctly", "prior_question_elapsed_time",
    "prior_question_had_explanation",
]

# Lecture kinds in code order 0..3 (anything else is code 4).
LECTURE_TYPES = ["concept", "solving question", "intention", "starter"]

ROWS_PER_TASK = 3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> log (row_id, user_id, timestamp ms, content_id, ...).

    One window over the user (a single exchange on user_id) numbers the rows;
    all later per-user windows reuse that partitioning.
    """
    ev = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lecture = F.col("event_type") == "signup"
    content = F.get_json_object("props", "$.k").cast("int")
    answer = F.when(lecture, F.lit(-1)).otherwise((F.col("event_id") % 7) % 4).cast("int")
    rn = F.row_number().over(w)
    return (ev.select(
        F.col("event_id").alias("row_id"),
        "user_id",
        epoch_millis("ts").alias("timestamp"),
        content.alias("content_id"),
        lecture.cast("int").alias("content_type_id"),
        ((rn - 1) / ROWS_PER_TASK).cast("int").alias("task_container_id"),
        answer.alias("user_answer"),
        F.when(lecture, F.lit(-1)).when(answer == content % 4, F.lit(1)).otherwise(F.lit(0))
        .alias("answered_correctly"),
        F.when((rn == 1) | lecture, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("value") * 1000, 0)).alias("prior_question_elapsed_time"),
        F.when(rn == 1, F.lit(None).cast("boolean"))
        .otherwise(F.col("event_type") == "view").alias("prior_question_had_explanation"),
    ))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> questions (question_id, part, correct_answer, tags text)."""
    p = read_table(spark, sf_dir, "part")
    brand = F.split(F.col("p_brand"), "#").getItem(1).cast("int")
    tags = F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(" "), (brand + 60).cast("string"),
                 F.when(F.col("p_size") % 3 == 0,
                        F.concat(F.lit(" "), (F.col("p_partkey") % 80 + 100).cast("string")))
                 .otherwise(F.lit(""))))
    return p.select(
        F.col("p_partkey").alias("question_id"),
        (F.col("p_size") % 7 + 1).cast("int").alias("part"),
        (F.col("p_partkey") % 4).cast("int").alias("correct_answer"),
        tags.alias("tags"),
    )


def lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 == 3)
    names = F.array(*[F.lit(n) for n in LECTURE_TYPES])
    return p.select(
        F.col("p_partkey").alias("lecture_id"),
        F.col("p_size").cast("int").alias("tag"),
        (F.col("p_size") % 7 + 1).cast("int").alias("part"),
        F.element_at(names, ((F.col("p_partkey") / 10).cast("long") % 4 + 1).cast("int")).alias("type_of"),
    )


def with_questions(log: DataFrame, qs: DataFrame) -> DataFrame:
    """Attach part, tags and correct_answer to question rows only (lectures get NULL)."""
    q = qs.select(F.col("question_id").alias("_qid"), "part", "tags", "correct_answer")
    j = dim_join(log.withColumn("_qkey", F.when(F.col("content_type_id") == 0, F.col("content_id"))),
                 q, F.col("_qkey") == F.col("_qid"), "left", max_rows=MAX_BROADCAST_ROWS)
    return j.drop("_qkey", "_qid")


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_questions(interaction_log(spark, sf_dir), questions(spark, sf_dir))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a second log: user = supplier, item = part, time = ship date.

    (l_orderkey, l_linenumber) repeats, so the row id is the row's global rank
    over all columns: unique for any number of copies, lines and orders (rows
    equal in every column are interchangeable).
    """
    from tracefeat.plans.ranking import global_rank
    li = read_table(spark, sf_dir, "lineitem")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    li = global_rank(li, ["l_orderkey", "l_linenumber", *rest], name="_rank")
    ts = epoch_millis("l_shipdate")
    return (li.select(
        F.col("_rank").alias("row_id"),
        F.col("l_suppkey").alias("user_id"),
        ts.alias("timestamp"),
        F.col("l_partkey").alias("content_id"),
        F.lit(0).alias("content_type_id"),
        F.col("l_orderkey").alias("task_container_id"),
        (F.col("l_linenumber") % 4).cast("int").alias("user_answer"),
        (F.col("l_returnflag") == "N").cast("int").alias("answered_correctly"),
        (F.col("l_quantity") * 1000).alias("prior_question_elapsed_time"),
        (F.col("l_linestatus") == "O").alias("prior_question_had_explanation"),
    ))
