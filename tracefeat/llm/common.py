"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"            # \x20 \x09-\x0D
WHITE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage (a lost executor costs a re-read, not a recomputation), makes
    every later use see the same rows, and gives joins two plain scans so that
    adaptive execution may split a hot key on either side.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space (``[^\\x20\\x09-\\x0D]+``); null and blank give 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.size(F.split(t, WHITE_RE)).cast("long"))


def without(df: DataFrame, names) -> DataFrame:
    """Drop the input columns that an operator's own output columns replace (case-insensitively)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def content_key(*cols: Column) -> Column:
    """64-bit content key of a row; rows equal in ``cols`` (nulls included) share it."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in cols])


def in_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4, the fold number of the labelled operators; null ids are fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))
