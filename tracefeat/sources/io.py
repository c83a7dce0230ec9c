"""Readers, writers and the feature store.

Everything is a Spark reader/writer: files are written by executors in
parallel, never gathered on the driver.  Paths live under the shared folder
named by ``spark.checkpoint.dir`` (or any path the caller gives).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.session import scratch_path

FORMATS = {
    ".csv": ("csv", {"header": "true", "sep": ","}),
    ".tsv": ("csv", {"header": "true", "sep": "\t"}),
    ".json": ("json", {}),
    ".parquet": ("parquet", {}),
    ".csv.gz": ("csv", {"header": "true", "sep": ",", "compression": "gzip"}),
}


def _fmt(path: str):
    for ext in sorted(FORMATS, key=len, reverse=True):
        if path.endswith(ext):
            return FORMATS[ext]
    raise ValueError(f"unknown extension: {path}")


def write_by_extension(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Writer chosen by the path's suffix (.csv .tsv .json .parquet .csv.gz)."""
    fmt, opts = _fmt(path)
    df.write.mode(mode).format(fmt).options(**opts).save(path)
    return path


def read_by_extension(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reader chosen by the suffix; pass ``schema`` to avoid inference on text formats."""
    fmt, opts = _fmt(path)
    opts = {k: v for k, v in opts.items() if k != "compression"}
    r = spark.read.format(fmt).options(**opts)
    if schema is not None:
        r = r.schema(schema)
    elif fmt == "csv":
        r = r.option("inferSchema", "true")
    return r.load(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared scratch folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


class FeatureStore:
    """Feature groups as parquet tables keyed by row_id plus a registry.

    Every save writes a new version of its group and appends (feature, group,
    version) to the registry; a feature is read from the last version that holds
    it, so saving a group again with fewer columns loses none.  Assembling reads
    only the requested columns (parquet column pruning) and joins on row_id.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _version_path(self, group: str, version: int) -> str:
        return os.path.join(self.root, "groups", group, f"v{version:020d}")

    def _registry_path(self) -> str:
        return os.path.join(self.root, "registry")

    def save(self, df: DataFrame, group: str, key: str = "row_id") -> None:
        version = time.time_ns()
        df.write.parquet(self._version_path(group, version))
        names = self.spark.createDataFrame([(c, group, version) for c in df.columns if c != key],
                                           "feature string, grp string, version long")
        names.write.mode("append").parquet(self._registry_path())

    def _latest(self) -> DataFrame:
        """(feature, grp, version): the last version of every feature of every group."""
        return self.spark.read.parquet(self._registry_path()).groupBy("feature", "grp").agg(F.max("version").alias("version"))

    def registry(self) -> DataFrame:
        return self._latest().select("feature", "grp")

    def group(self, group: str, key: str = "row_id") -> DataFrame:
        """All features of a group, each from its last version."""
        return self._wide([r for r in self._latest().filter(F.col("grp") == group).orderBy("feature").collect()], None, key)

    def assemble(self, features: list[str], base: DataFrame | None = None, key: str = "row_id") -> DataFrame:
        """Wide frame of the named features; of a name saved in several groups the last one saved counts.
        The lookup reads the registry (one row per feature name, a bounded list)."""
        rows = self._latest().filter(F.col("feature").isin(features)).orderBy("version").collect()
        where = {r["feature"]: r for r in rows}
        missing = [f for f in features if f not in where]
        if missing:
            raise KeyError(missing)
        return self._wide([where[f] for f in features], base, key)

    def _wide(self, rows: list, base: DataFrame | None, key: str) -> DataFrame:
        by_table: dict[tuple, list[str]] = {}
        for r in rows:
            by_table.setdefault((r["grp"], r["version"]), []).append(r["feature"])
        out = base
        for (g, v), cols in by_table.items():
            part = self.spark.read.parquet(self._version_path(g, v)).select(key, *cols)
            out = part if out is None else out.join(part, key, "left" if base is not None else "inner")
        return out


def write_submission(preds: DataFrame, path: str, gzip: bool = True) -> str:
    """One CSV (per partition) with a header, gzip-compressed."""
    w = preds.write.mode("overwrite").option("header", "true")
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)
    return path


def append_table(df: DataFrame, path: str) -> str:
    """Append a frame to a parquet table."""
    df.write.mode("append").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by=("cv", "split")) -> str:
    """One table partitioned by the cut columns (never a file per row)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path
