"""Event streams built from the log: question/lecture rows arrive with their
answers withheld; the answers of micro-batch n arrive with micro-batch n+1, as
label events or in the loop's own format, one JSON list of all of them (K2).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS = 500   # rows per micro-batch on the fixture: floor(row_id / 500)

EVENT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),          # 'row', 'label', 'list', 'tick' or 'end'
    T.StructField("group_num", T.LongType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("content_id", T.IntegerType()),
    T.StructField("content_type_id", T.IntegerType()),
    T.StructField("task_container_id", T.IntegerType()),
    T.StructField("prior_question_elapsed_time", T.DoubleType()),
    T.StructField("answered_correctly", T.IntegerType()),
    T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("user_answer", T.IntegerType()),                       # on labels from lists
    T.StructField("prior_group_answers_correct", T.StringType()),        # on lists
    T.StructField("prior_group_responses", T.StringType()),
])


def arrival(group_num) -> Column:
    """Arrival time on the replay's clock: group n arrives at second n + 1."""
    return F.timestamp_millis((group_num + 1) * 1000)


def with_groups(log: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    return log.withColumn("group_num", F.floor(F.col("row_id") / group_rows).cast("long"))


def event_frame(log: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All events: each row in its group without its answer, and its answer as a
    label event in the next group."""
    g = with_groups(log, group_rows)
    ts = F.timestamp_millis(F.col("timestamp"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("user_answer", "int"), ("prior_group_answers_correct", "string"),
                                                      ("prior_group_responses", "string"))]
    rows = g.select(F.lit("row").alias("kind"), "group_num", "row_id", "user_id", "timestamp", ts.alias("event_ts"),
                    "content_id", "content_type_id", "task_container_id", "prior_question_elapsed_time",
                    F.lit(None).cast("int").alias("answered_correctly"), arrival(F.col("group_num")).alias("arrival_ts"), *none)
    labels = g.select(F.lit("label").alias("kind"), (F.col("group_num") + 1).alias("group_num"), "row_id", "user_id",
                      "timestamp", ts.alias("event_ts"), F.lit(None).cast("int").alias("content_id"),
                      F.lit(None).cast("int").alias("content_type_id"), F.lit(None).cast("int").alias("task_container_id"),
                      F.lit(None).cast("double").alias("prior_question_elapsed_time"),
                      F.col("answered_correctly").cast("int"), arrival(F.col("group_num") + 1).alias("arrival_ts"), *none)
    return rows.unionByName(labels)


def list_frame(log: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows and, one group later, the answer lists: the loop's own format."""
    lists = label_lists(log, group_rows).withColumns({"kind": F.lit("list"), "arrival_ts": arrival(F.col("group_num"))})
    return event_frame(log, group_rows).filter("kind = 'row'").unionByName(lists, allowMissingColumns=True)


REPLAY_CHUNKS = 4
CHUNK_FILES = 4


def write_microbatches(events: DataFrame, path: str, chunks: int = REPLAY_CHUNKS, files: int = CHUNK_FILES) -> int:
    """Write the events for replay by a file source, in ``chunks`` jobs whatever the number of groups.

    A chunk is a run of consecutive groups in at most ``files`` files, with a
    user's events in one of them, so the number of triggers does not follow the
    number of tasks that wrote it.  The source takes files by modification time, so
    every user's groups arrive in order, which is what the keyed state needs;
    files of one chunk come in any order.  Returns the number of groups."""
    n = events.agg(F.max("group_num")).first()[0]
    n = -1 if n is None else int(n)
    step = -(-(n + 1) // chunks)
    for lo in range(0, n + 1, max(step, 1)):
        hi = min(lo + step, n + 1) - 1
        (events.filter(F.col("group_num").between(lo, hi)).repartition(files, "user_id")
         .write.mode("overwrite").parquet(os.path.join(path, f"groups={lo:08d}-{hi:08d}")))
    return n + 1


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = CHUNK_FILES) -> DataFrame:
    """The replayed stream.  Event-time operators pass None: the files of a chunk are not in
    time order, so a watermark may only move once all of a replay has been read."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


# K2 ------------------------------------------------------------------------
def label_lists(log: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """On group n, the JSON lists of group n-1's correctness and chosen answers in row order."""
    g = with_groups(log, group_rows)
    per = g.groupBy("group_num").agg(
        F.sort_array(F.collect_list(F.struct("row_id", "answered_correctly", "user_answer"))).alias("_s"))
    return per.select((F.col("group_num") + 1).alias("group_num"),
                      F.to_json(F.transform("_s", lambda s: s["answered_correctly"]))
                      .alias("prior_group_answers_correct"),
                      F.to_json(F.transform("_s", lambda s: s["user_answer"])).alias("prior_group_responses"))
