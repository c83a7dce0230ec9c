"""Sharding by fixed virtual slots: records hash into slots, a versioned map says which shard holds a slot.

A set of shards is a folder::

    map/version=V/     slot, shard, since, bytes: which shard holds a slot since which version
    data/__since=V/__shard=K/   the records that version V wrote, sorted by slot
    manifest/__since=V/  rows and first place of every (slot, piece) that version V wrote

A record's slot follows from its id and text alone and never changes.  Only the
map is edited: ``rebalance`` moves as few slots as bring the shards to equal
bytes, writes a new map version and copies the records of the moved slots; all
others stay where they are, and every older version can still be read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefeat.llm.common import content_key, materialise

SLOTS = 4096
PIECE_BYTES = 256 << 20      # a slot is written in pieces of about this size
EVEN = 0.001                 # shards whose bytes differ by less than this share of their mean count as even
MANIFEST_ROWS = 1 << 20      # a manifest of up to so many rows (about 40 MB) is broadcast, a longer one is joined by key
PRIVATE = ("__key", "__bytes", "__slot", "__piece", "__at", "__shard", "__since", "__place")


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one for the end of the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def edit_map(current: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """A new slot-to-shard map with near equal shard weights that moves few slots of ``current``.

    Slots of shards that no longer exist and what a shard holds above the mean
    are freed, largest first and never below the mean, then given, largest
    first, to the lightest shard.  Last, the heaviest and the lightest shard
    exchange single slots or pairs while that brings them closer and they differ
    by more than a thousandth of the mean.
    """
    new, w = current.copy(), weights.astype(np.int64)
    mean = w.sum() / shards
    by_size = np.lexsort((np.arange(len(w)), -w))
    new[(new >= shards) | (new < 0)] = -1
    load = np.bincount(new[new >= 0], weights=w[new >= 0], minlength=shards).astype(np.int64)
    for s in by_size:
        k = new[s]
        if k >= 0 and w[s] > 0 and load[k] - w[s] >= mean:
            load[k] -= w[s]
            new[s] = -1
    for s in by_size:
        if new[s] < 0:
            k = int(load.argmin()) if w[s] else int(np.bincount(new[new >= 0], minlength=shards).argmin())
            new[s] = k
            load[k] += w[s]
    for _ in range(8 * shards + 64):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        mine, theirs = np.flatnonzero(new == hi), np.flatnonzero(new == lo)
        mine, theirs = mine[np.argsort(w[mine], kind="stable")], theirs[np.argsort(w[theirs], kind="stable")]
        if gap < max(2, EVEN * mean) or not len(mine):
            break
        # moving a against b (or against nothing) takes w[a] - w[b] off the gap twice; best is half the gap
        back = np.concatenate(([0], w[theirs]))
        near = np.clip(np.searchsorted(w[mine], back + gap / 2), 0, len(mine) - 1)
        options = np.stack([near, np.maximum(near - 1, 0)])
        left = np.abs(gap - 2 * (w[mine][options] - back))
        i, j = np.unravel_index(int(left.argmin()), left.shape)
        if left[i, j] >= gap:
            break
        a = mine[options[i, j]]
        new[a] = lo
        gain = int(w[a])
        if j:
            new[theirs[j - 1]] = hi
            gain -= int(w[theirs[j - 1]])
        load[hi] -= gain
        load[lo] += gain
    return new


def _slotted(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """``docs`` with key, bytes and slot.

    A key is heavy when its repeated rows weigh more than a mean slot, so there
    are fewer heavy keys than slots; their rows, equal in id and text and so
    interchangeable, are dealt over all slots one by one.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.withColumns({"__key": content_key(i, t), "__bytes": record_bytes(t)})
    keys = materialise(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("b")), "slot-keys")
    mean = (keys.agg(F.sum("b")).first()[0] or 0) / slots
    heavy = [r["__key"] for r in keys.where((F.col("n") > 1) & (F.col("b") > mean)).select("__key").collect()]
    slot = F.pmod("__key", F.lit(slots)).cast("int")
    if heavy:
        dealt = F.pmod(F.xxhash64("__key", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
        marks = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in heavy], "__heavy long"))
        keyed = keyed.withColumn("__dealt", dealt).join(marks, F.col("__key") == F.col("__heavy"), "left")
        slot = F.when(F.col("__heavy").isNotNull(), F.col("__dealt")).otherwise(slot)
    out = keyed.withColumn("__slot", slot).drop("__dealt", "__heavy")
    weights = (out if heavy else keys.withColumnRenamed("b", "__bytes").withColumn("__slot", slot)) \
        .groupBy("__slot").agg(F.sum("__bytes").alias("b")).collect()
    return out, weights


def _save_map(spark: SparkSession, folder: str, version: int, shard, since, weights) -> None:
    rows = [(s, int(shard[s]), int(since[s]), int(weights[s])) for s in range(len(shard))]
    spark.createDataFrame(rows, "slot int, shard int, since int, bytes long").coalesce(1) \
        .write.parquet(f"{folder}/map/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One row per slot of a map version (the newest unless told): slot, shard, since, bytes."""
    maps = spark.read.schema("slot int, shard int, since int, bytes long, version int").parquet(f"{folder}/map")
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def _write(rows: DataFrame, shard_of: dict[int, int], folder: str, version: int) -> None:
    """Write slotted rows under their shards, sorted by slot, with a manifest of every (slot, piece)."""
    spark = rows.sparkSession
    target = F.broadcast(spark.createDataFrame(list(shard_of.items()), "__s int, __shard int"))   # at most one row a slot
    order = ["__shard", "__slot", "__piece", "__key", "__bytes"]
    laid = (rows.join(target, F.col("__slot") == F.col("__s")).drop("__s")
            .repartition("__shard", "__slot", "__piece").sortWithinPartitions(*order)
            .withColumn("__at", F.monotonically_increasing_id()))
    path = f"{folder}/data/__since={version}"
    laid.write.partitionBy("__shard").parquet(path)
    done = spark.read.schema("__slot int, __piece int, __bytes long, __at long, __shard int").parquet(path)
    done.groupBy("__shard", "__slot", "__piece").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")).write.parquet(f"{folder}/manifest/__since={version}")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                 slots: int = SLOTS) -> None:
    """Write every row of ``docs`` (all columns) into ``shards`` shards of near equal bytes.

    Version 0 of the map deals the slots round robin; the bytes per slot are
    aggregated and version 1 is the edited map by which the rows are written.
    Null ids and texts are values like any other, a null text holds no bytes;
    repeated rows are all kept; an empty table makes empty shards.  Columns
    named like the private ones (``__slot`` ...) are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*PRIVATE)
    slotted, found = _slotted(docs, id_col, text_col, slots)
    weights = np.zeros(slots, dtype=np.int64)
    for r in found:
        weights[r["__slot"]] = r["b"]
    first = np.arange(slots) % shards
    _save_map(spark, folder, 0, first, np.zeros(slots, int), np.zeros(slots, np.int64))
    shard = edit_map(first, weights, shards)
    pieces = int(max(1, -(-int(weights.max()) // PIECE_BYTES)))
    rows = slotted.withColumn("__piece", F.pmod(F.floor(F.col("__key") / slots), F.lit(pieces)).cast("int"))
    _write(rows, {s: int(shard[s]) for s in range(slots)}, folder, 1)
    _save_map(spark, folder, 1, shard, np.ones(slots, int), weights)


def rebalance(spark: SparkSession, folder: str, shards: int, schema) -> int:
    """Edit the newest map for ``shards`` shards and copy the rows of the moved slots; the new version's number.

    ``schema`` is that of the rows given to ``write_shards``.  The map is
    written last: until then readers keep the version before.
    """
    rows = sorted(load_map(spark, folder).collect(), key=lambda r: r["slot"])
    version = rows[0]["version"] + 1
    old = np.array([r["shard"] for r in rows])
    weights = np.array([r["bytes"] for r in rows], dtype=np.int64)
    new = edit_map(old, weights, shards)
    moved = {int(s): int(new[s]) for s in np.flatnonzero(new != old)}
    since = np.array([r["since"] for r in rows])
    filled = {s: k for s, k in moved.items() if weights[s]}
    if filled:
        _write(_valid(spark, folder, schema, version - 1).where(F.col("__slot").isin(list(filled))).drop("__at", "__shard"),
               filled, folder, version)
    since[list(moved)] = version
    _save_map(spark, folder, version, new, since, weights)
    return version


def _valid(spark: SparkSession, folder: str, schema, version: int | None) -> DataFrame:
    """The stored rows that a map version holds to be current."""
    extra = "__key long, __bytes long, __slot int, __piece int, __at long, __since int, __shard int"
    private = spark.createDataFrame([], extra).schema
    names = {f.name.lower() for f in private.fields}
    full = type(schema)([f for f in schema.fields if f.name.lower() not in names] + private.fields)
    m = load_map(spark, folder, version).select(F.col("slot").alias("__ms"), F.col("since").alias("__mv"))
    data = spark.read.schema(full).parquet(f"{folder}/data")
    return data.join(F.broadcast(m), (F.col("__slot") == F.col("__ms")) & (F.col("__since") == F.col("__mv"))) \
        .drop("__ms", "__mv", "__since")


def read_shards(spark: SparkSession, folder: str, schema, version: int | None = None) -> DataFrame:
    """All rows with ``__shard``, ``__slot`` and ``__place``, the row's place in its shard (gapless from 0).

    Rows of a shard are ordered by slot, piece, key and size; the places come
    from the manifest (one row a slot and piece), so no shard is sorted whole.
    """
    m = load_map(spark, folder, version).select(F.col("slot").alias("__slot"), F.col("since").alias("__since"))
    parts = spark.read.schema("__shard int, __slot int, __piece int, __n long, __first long, __since int") \
        .parquet(f"{folder}/manifest")
    parts = parts.join(F.broadcast(m), ["__slot", "__since"])
    before = Window.partitionBy("__shard").orderBy("__slot", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__shard", "__slot", "__piece", "__first",
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = _valid(spark, folder, schema, version)
    if parts.limit(MANIFEST_ROWS + 1).count() <= MANIFEST_ROWS:
        parts = F.broadcast(parts)                                  # the rows, texts and all, stay where they are
    placed = rows.join(parts, ["__shard", "__slot", "__piece"])
    own = [f"`{c}`" for c in rows.columns if c not in PRIVATE]
    return placed.select(*own, "__shard", "__slot", (F.col("__before") + F.col("__at") - F.col("__first")).alias("__place"))
