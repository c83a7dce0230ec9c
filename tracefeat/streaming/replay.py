"""Replays in which one trigger takes one chunk, and event time with a side output for late rows.

A file source counts files, so every chunk is written as exactly ``files`` files,
each opened by a ``tick`` row; ``maxFilesPerTrigger`` then cuts the stream where
the chunks were cut, and state and watermark move from chunk to chunk.

``route_late`` splits a stream by event time before any window sees it.  Spark's
own windows drop rows behind the watermark without a trace; here a row that is
``delay_ms`` or more behind the newest event time of earlier micro-batches goes
to the ``late`` table, all others go on, and both together are the input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefeat.plans.ranking import global_rank

FILES = 4                    # files of a chunk, and of a trigger
CHUNKS = 4


def in_files(rows: DataFrame, files: int = FILES) -> DataFrame:
    """``rows`` in exactly ``files`` partitions, none empty: each holds a ``tick`` row, null but for its kind."""
    ticks = rows.sparkSession.range(files).select(F.lit("tick").alias("kind"), F.col("id").cast("int").alias("__file"))
    spread = rows.withColumn("__file", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files)).cast("int"))
    return spread.unionByName(ticks, allowMissingColumns=True).repartitionById(files, F.col("__file")).drop("__file")


def write_chunks(rows: DataFrame, chunk: str, path: str, chunks: int = CHUNKS, files: int = FILES) -> None:
    """One job per chunk number 0 .. chunks - 1, in order, as the file source reads by time of writing."""
    for c in range(chunks):
        in_files(rows.where(F.col(chunk) == c).drop(chunk), files).write.parquet(os.path.join(path, f"chunk={c:06d}"))


def time_chunks(rows: DataFrame, chunks: int = CHUNKS, order=("event_ts", "row_id")) -> DataFrame:
    """``rows`` with ``chunk``: equal shares of the order of event time (distributed rank, no task holds them all)."""
    r = global_rank(rows, list(order), name="__rank", total_name="__total")
    return r.withColumn("chunk", F.floor((F.col("__rank") - 1) * chunks / F.col("__total")).cast("int")).drop("__rank", "__total")


def arrival_chunks(rows: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """``rows`` with ``chunk``: runs of consecutive groups, in the order in which the groups arrived."""
    top = rows.agg(F.max("group_num").alias("g")).select(
        F.greatest(F.ceil((F.col("g") + 1) / chunks), F.lit(1)).cast("long").alias("step"))
    return rows.crossJoin(F.broadcast(top)).withColumn("chunk", F.floor(F.col("group_num") / F.col("step")).cast("int")) \
        .drop("step")


def read_chunks(spark: SparkSession, path: str, schema, files: int = FILES) -> DataFrame:
    """The stream of chunks, one a trigger."""
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
            .parquet(path))


def route_late(events: DataFrame, root: str, delay_ms: int = 0, files: int = FILES, timeout_s: int | None = None) -> None:
    """Split a stream of ``events`` (column ``event_ts``) into ``root``/on_time and ``root``/late until it is read up.

    Per micro-batch the newest event time is kept in ``root``/clock; the
    watermark of a batch is the newest event time of all earlier ones less
    ``delay_ms``.  A row behind it is late (``behind_ms``: by how much); a row
    without event time is late too (``behind_ms`` null).  Every batch writes
    its own folders anew, so a replayed batch neither loses nor doubles rows.
    """
    spark = events.sparkSession
    clock = os.path.join(root, "clock")

    def route(batch: DataFrame, batch_id: int) -> None:
        now = spark.createDataFrame([], "batch_id long, newest long") if batch_id == 0 else \
            spark.read.schema("batch_id long, newest long").parquet(clock)
        mark = now.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        rows = batch.where("kind <> 'tick'")
        ms = F.unix_millis("event_ts")
        behind = F.lit(None).cast("long") if mark is None else F.lit(mark - delay_ms) - ms
        late = ms.isNull() | F.coalesce(behind > 0, F.lit(False))
        in_files(rows.where(~late), files).write.mode("overwrite").parquet(os.path.join(root, "on_time", f"b={batch_id:08d}"))
        rows.where(late).withColumn("behind_ms", behind).write.mode("overwrite").parquet(
            os.path.join(root, "late", f"batch={batch_id}"))
        rows.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(ms).alias("newest")).coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(clock, f"b={batch_id}"))

    q = (events.writeStream.foreachBatch(route).option("checkpointLocation", os.path.join(root, "_ckpt_route"))
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()


def late_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """The side output: the late rows with ``behind_ms`` and the ``batch`` they came in."""
    full = T.StructType(schema.fields + [T.StructField("behind_ms", T.LongType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(os.path.join(root, "late"))
