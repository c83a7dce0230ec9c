"""The ``opN_<name>`` queries and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.llm import (chat, codes, codes_sql, covertree, decontaminate, html_text, langid, mixing, quality, simhash,
                           slots, suffixes, warc, whitening)
from tracefeat.llm.common import content_key, table
from tracefeat.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@query("op1_mix_sources", mixing.mix_sql(
    "documents", "SELECT doc_id, size, source_size, target, taken FROM mixed"))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 repeating: words taken of each document."""
    return mixing.mix_to_weights(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint (3-word shingles) and component at 3 or fewer bits of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query("op6_warc_round_trip", warc.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    key = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, key).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_embedding_near_dedup", covertree.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within a label."""
    return covertree.cosine_components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op4_chat_snapshots", chat.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "n_turns", "n_copies", "text", "part")


@query("op9_quality_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")) \
        .withColumnRenamed("id", "doc_id")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", F.col("__held_out").alias("held_out"), F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"))


@query("op2_suffix_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that an earlier document (or place) holds: where, and whose they are."""
    docs = table(spark, sf_dir, "documents")
    found = suffixes.repeated_passages(docs)
    ids = docs.select("doc_id", content_key(F.col("doc_id"), F.col("text")).alias("rid"))
    return ids.join(found, "rid").select(
        "doc_id", F.aggregate("spans", F.lit(0), lambda n, s: n + s["to_word"] - s["from_word"]).alias("repeated_words"),
        "spans", F.col("others").alias("first_doc_ids"))


@query("op7_benchmark_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its score and where it stands."""
    return decontaminate.contaminated_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op5_page_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op11_virtual_slots")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written into 8 shards by 4096 virtual slots (law ``bytes``) and read back from them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    slots.write_shards(docs, folder, shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return slots.read_shards(spark, folder, docs.schema).select(
        "doc_id", slots.record_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("__slot").alias("virtual_slot"))


@query("op12_vector_codes", codes_sql.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding as 16 codebook indexes, with its error and that of its label."""
    coded, books = codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(codes.codebooks_sha256(books)).alias("codebooks_sha256"))


@query("op13_whitened_embeddings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding on the 16 leading whitened components of the distinct integer vectors."""
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    share = F.array(*[F.lit(e) for e in model["explained"]]).cast("array<double>")
    return rows.select("id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened")).select(
        F.col("id").alias("vec_id"), (F.col("pos") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"),
        "deviation", F.col("col").alias("whitened"), F.get(share, F.col("pos")).alias("explained"),
        F.lit(model["identity_error"]).alias("identity_error"))
