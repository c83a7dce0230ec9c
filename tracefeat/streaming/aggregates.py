"""K4-K6 and the runner that drives a streaming query to completion.

K4: sessions per user with ``session_window`` and a watermark.
K5: an encoder refreshed per micro-batch through ``foreachBatch``: a base and the
    deltas since, exactly-once per batch id and bounded whatever the number of batches.
K6: tumbling / sliding event-time counts with a watermark.
"""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SESSION_GAP_MS = 12 * 3_600_000


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which typed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                   timeout_s: int | None = None) -> list:
    """Run a streaming frame with ``availableNow`` into a parquet sink and wait, without end unless
    ``timeout_s`` says so; the progress of its micro-batches (read rows, watermark, rows in state, rows dropped behind the watermark)."""
    with rocksdb(df.sparkSession):
        return _run_to_parquet(df, path, checkpoint, mode, timeout_s)


def _run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str, timeout_s: int | None) -> list:
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    finish(q, timeout_s)
    return list(q.recentProgress)


def finish(q: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for a query's end; a bound in seconds is the caller's choice, as the time grows with the input."""
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()


def end_marker(spark: SparkSession, path: str, group_num: int, far_ts_ms: int) -> None:
    """One control event far after the data, so that event-time watermarks close
    every real window / session of a finite replay (a live stream's clock does this)."""
    from tracefeat.streaming.events import EVENT_SCHEMA
    far = F.timestamp_millis(F.col("timestamp"))
    row = [("end", group_num, -1, -1, far_ts_ms) + (None,) * (len(EVENT_SCHEMA) - 5)]
    m = spark.createDataFrame(row, EVENT_SCHEMA).withColumns({"event_ts": far, "arrival_ts": far})
    m.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"group={group_num:06d}"))


# K4 ------------------------------------------------------------------------
def stream_sessions(events: DataFrame, gap_ms: int = SESSION_GAP_MS, delay: str = "1 hour") -> DataFrame:
    """Question rows per user session: a gap above ``gap_ms`` opens a new session, an equal one
    does not (as in the batch feature U12).  ``session_window`` ends a session at a gap of its
    length, so its length is one millisecond more, the resolution of the event time."""
    question = (F.col("kind") == "end") | (F.col("kind") == "row") & (F.col("content_type_id") == 0)
    rows = events.filter(question).withWatermark("event_ts", delay)
    s = rows.groupBy(F.session_window("event_ts", f"{gap_ms + 1} milliseconds").alias("s"), "user_id") \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    return s.select("user_id", F.unix_millis(F.col("s.start")).alias("session_start"),
                    (F.unix_millis(F.col("s.end")) - 1).alias("session_end"), "n_rows")


# K6 ------------------------------------------------------------------------
def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = "6 hours",
                    delay: str = "1 hour") -> DataFrame:
    rows = events.filter(F.col("kind").isin("row", "end")).withWatermark("event_ts", delay)
    w = F.window("event_ts", size, slide) if slide else F.window("event_ts", size)
    c = rows.groupBy(w.alias("w"), "content_type_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return c.select(F.unix_millis(F.col("w.start")).alias("window_start"),
                    F.unix_millis(F.col("w.end")).alias("window_end"), "content_type_id", "n_rows")


# K5 ------------------------------------------------------------------------
FOLD_EVERY = 8               # batches after which the deltas are folded into a new base


def refresh_encoder(events: DataFrame, table_path: str, checkpoint: str, key: str = "content_id",
                    timeout_s: int | None = None, fold_every: int = FOLD_EVERY) -> None:
    """Row counts by ``key``, kept as a base and the deltas of the batches since.

    A micro-batch writes its counts as a delta; every ``fold_every`` batches the
    base and the deltas since are summed into a new base.  Deltas go round in
    2 * ``fold_every`` folders and bases in two, each overwritten whole, so what a
    reader sums does not grow with the number of batches.  A replayed batch
    overwrites its own folders with the same rows; the base it folds from is the
    other one."""
    spark = events.sparkSession
    kind = events.schema[key].dataType.simpleString()

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            for part, slot in (("base", 1), ("delta", 1)):
                spark.createDataFrame([], f"{key} {kind}, n long, upto long").write.mode("overwrite").parquet(
                    os.path.join(table_path, part, f"slot={slot}"))
        counts = batch.filter(F.col("kind") == "row").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("upto", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            os.path.join(table_path, "delta", f"slot={batch_id % (2 * fold_every)}"))
        if (batch_id + 1) % fold_every == 0:
            fold = batch_id // fold_every
            whole = _encoder_rows(spark, table_path, key, batch_id, batch_id - fold_every) \
                .groupBy(key).agg(F.sum("n").alias("n")).withColumn("upto", F.lit(batch_id).cast("long"))
            whole.write.mode("overwrite").parquet(os.path.join(table_path, "base", f"slot={fold % 2}"))

    q = (events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    finish(q, timeout_s)


def _encoder_rows(spark: SparkSession, table_path: str, key: str, newest: int | None = None,
                  base_upto: int | None = None) -> DataFrame:
    """The rows of the base (the newest unless told) and of the deltas behind it up to batch ``newest``."""
    base = spark.read.parquet(os.path.join(table_path, "base")).select(key, "n", "upto")
    delta = spark.read.parquet(os.path.join(table_path, "delta")).select(key, "n", "upto")
    if base_upto is None:
        top = base.agg(F.max("upto")).first()[0]
        base_upto = -1 if top is None else top
    delta = delta.filter(F.col("upto") > base_upto)
    return base.filter(F.col("upto") == base_upto).unionByName(delta if newest is None else delta.filter(F.col("upto") <= newest))


def read_encoder(spark: SparkSession, table_path: str, key: str = "content_id") -> DataFrame:
    return _encoder_rows(spark, table_path, key).groupBy(key).agg(F.sum("n").alias(f"{key}_count"))
