"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise, without, word_count

STRIDE = 2654435761          # a prime above any number of blocks of a shard: b -> b*STRIDE + c permutes the blocks
OUT = ("size", "source_size", "target", "taken", "passes", "spans")
SHARD_WORDS = 1 << 18
BLOCK_WORDS = 32


def cyclic_weights(names: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., cycle, repeating over the sources by code point, null last."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    return names.withColumn("weight", ((F.row_number().over(w) - 1) % cycle + 1).cast("double"))


def water_fill(sources: DataFrame, max_repeats: int) -> DataFrame:
    """``target`` of each source (one row per source: skey, source_size, weight).

    All words are shared by weight; a source stops at ``max_repeats`` times its
    size and the excess is shared again by weight.  In ascending order of
    cap/weight a source is capped exactly while its cap is not above its share
    of what the earlier (capped) sources leave, so one ordered pass suffices.
    """
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = (sources.withColumn("cap", F.col("source_size") * max_repeats)
         .withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)))
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))
                                                                 .otherwise(0)).over(before), F.lit(0)))
                     / F.nullif(F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
                                F.lit(0.0)))
         .withColumn("capped", F.coalesce(F.col("cap") <= F.col("level") * F.col("weight"), F.lit(True)))
         .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(every)))
    return s.withColumn("target", F.when(F.col("weight") <= 0, F.lit(0.0))
                        .when(F.col("capped"), F.col("cap").cast("double"))
                        .otherwise(F.col("final") * F.col("weight"))) \
        .drop("cap", "ratio", "level", "capped", "final")


def sainte_lague(df: DataFrame, group: list[str], share: str, total: str, seats_total: str, tie: str) -> DataFrame:
    """Column ``seats``: ``seats_total`` seats dealt to the rows of a group by the highest quotients share/(2s+1).

    Rounding every share by the divisor total/seats_total is itself the
    apportionment of some number of seats; the difference to ``seats_total`` is
    then dealt (or taken back) one seat at a time by the highest (lowest)
    quotients.  A row can gain or lose at most its quota times
    (|difference| + n)/seats_total, plus one, so the candidates stay linear in n.
    """
    w = Window.partitionBy(*group)
    quota = F.col(share) * F.col(seats_total) / F.nullif(F.col(total).cast("double"), F.lit(0.0))
    base = (df.withColumn("quota", F.coalesce(quota, F.lit(0.0)))
            .withColumn("seats0", F.floor(F.col("quota") + 0.5).cast("long"))
            .withColumn("diff", F.col(seats_total) - F.sum("seats0").over(w))
            .withColumn("n_rows", F.count(F.lit(1)).over(w)))
    most = F.when(F.col("diff") == 0, F.lit(0)).otherwise(
        F.floor(F.col("quota") * (F.abs("diff") + F.col("n_rows"))
                / F.nullif(F.col(seats_total).cast("double"), F.lit(0.0))) + 2)
    cand = (base.withColumn("most", F.coalesce(most, F.lit(0)).cast("long")).filter("most > 0")
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)))
            .withColumn("seat", F.when(F.col("diff") > 0, F.col("seats0") + F.col("j"))
                        .otherwise(F.col("seats0") - 1 - F.col("j")))
            .filter("seat >= 0")
            .withColumn("q", F.col(share) / (2 * F.col("seat") + 1)))
    order = Window.partitionBy(*group, "diff").orderBy(
        F.when(F.col("diff") > 0, -F.col("q")).otherwise(F.col("q")),
        F.when(F.col("diff") > 0, F.col("tie_rank")).otherwise(-F.col("tie_rank")), "seat")
    ranked = (cand.withColumn("tie_rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(tie)))
              .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.abs("diff")))
    keys = list(dict.fromkeys([*group, tie]))
    fix = ranked.groupBy(*keys).agg(F.sum(F.signum("diff")).cast("long").alias("fix"))
    return (base.join(fix, keys, "left").withColumn("seats", F.col("seats0") + F.coalesce("fix", F.lit(0)))
            .drop("quota", "seats0", "diff", "n_rows", "fix"))


def mix_to_weights(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", max_repeats: int = 3, block_words: int = BLOCK_WORDS,
                   shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """Every input row with the share of it that a weighted mix of all sources takes.

    ``weights`` (source, weight) names the target shares; None weighs the
    sources 1, 2, 3, repeating, by code point with the null source last.  The
    mix holds as many words as the input.  Targets come from ``water_fill``;
    blocks of ``block_words`` words are dealt to sources and then to the
    seeded shards of each source by Sainte-Lague quotients.  A shard repeats
    its whole stream (documents in seeded order) as often as its quota allows,
    and fills the rest with blocks picked by a seeded permutation, the last
    one cut at the quota.  A document gives the words its blocks cover:
    ``passes`` whole repeats plus the word ranges ``spans``; ``taken`` counts
    both and never exceeds ``max_repeats`` times ``size``.

    Adds size, source_size, target, taken, passes, spans; input columns of
    those names are replaced.  Null and empty texts have size 0 and give 0; a
    null source is a source of its own; a source missing in ``weights`` weighs
    0; rows equal in id and text are separate rows, each given its own part of
    the stream; a null id is an id.  An empty table gives an empty table.
    The tables of sources and shards hold one row per source (shard), never
    per document.  Reruns agree: the order depends on ``seed`` and content.
    """
    d = without(docs, OUT)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                            F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    d = (d.withColumn("__size", word_count(F.col(text_col))).withColumn("__key", key)
         .withColumn("__skey", F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("~"))))
    slot = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    base = materialise(d.select(F.col("__skey").alias("skey"), F.col(source_col).cast("string").alias("source"),
                                F.col("__size").alias("size"), slot.alias("slot")), "mix")

    src = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        src = cyclic_weights(src)
    else:
        w = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")).alias("skey"),
                           F.col("weight").cast("double").alias("weight"))
        src = src.join(w, "skey", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    src = water_fill(src, max_repeats).withColumn("blocks", F.round(F.col("total") / block_words).cast("long")) \
        .withColumn("one", F.lit(1))
    src = sainte_lague(src, ["one"], "target", "total", "blocks", "skey") \
        .withColumnRenamed("seats", "source_seats") \
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    src = materialise(src.select("skey", "source_size", "target", "source_seats", "n_shards"), "mix-sources")

    shards = (base.join(src, "skey").withColumn("shard", F.col("slot") % F.col("n_shards"))
              .groupBy("skey", "shard").agg(F.sum("size").alias("n"), F.first("source_size").alias("source_size"),
                                            F.first("source_seats").alias("source_seats")))
    shards = sainte_lague(shards, ["skey"], "n", "source_size", "source_seats", "shard")
    quota = F.least(F.col("seats") * block_words, F.col("n") * max_repeats)
    shards = shards.select(
        F.col("skey").alias("__skey"), F.col("shard").alias("__shard"), F.col("n").alias("__n"), quota.alias("__quota"),
        (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "skey", "shard")), 1, 8), 16, 10)
         .cast("long")).alias("__offset"))

    src_cols = src.select(F.col("skey").alias("__skey"), "source_size", "target", F.col("n_shards").alias("__shards"))
    w = Window.partitionBy("__skey", "__shard").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0)
    b = F.lit(block_words).cast("long")
    x = (d.join(src_cols, "__skey").withColumn("__shard", slot % F.col("__shards"))
         .withColumn("__end", F.sum("__size").over(w)).withColumn("__start", F.col("__end") - F.col("__size"))
         .join(shards, ["__skey", "__shard"])
         .withColumn("passes", F.when(F.col("__n") > 0, F.floor(F.col("__quota") / F.greatest("__n", F.lit(1))))
                     .otherwise(0).cast("int"))
         .withColumn("__rest", F.col("__quota") - F.col("passes") * F.col("__n"))
         .withColumn("__full", F.floor(F.col("__n") / block_words).cast("long")))

    def taken_to(blk):
        """End, in the shard's stream, of what the partial pass takes of block ``blk``."""
        place = (blk * F.lit(STRIDE) + F.col("__offset")) % F.greatest(F.col("__full"), F.lit(1))
        head = F.when(blk < F.col("__full"), F.least(b, F.col("__rest") - place * b)) \
            .otherwise(F.col("__rest") - F.col("__full") * b)
        return blk * b + F.greatest(head, F.lit(0))

    blocks = F.sequence(F.floor(F.col("__start") / block_words).cast("long"),
                        F.floor((F.col("__end") - 1) / block_words).cast("long"))
    part = F.transform(blocks, lambda blk: F.struct(
        (F.greatest(F.col("__start"), blk * b) - F.col("__start")).alias("from_word"),
        (F.least(F.col("__end"), taken_to(blk)) - F.col("__start")).alias("to_word")))
    none = F.array().cast("array<struct<from_word:bigint,to_word:bigint>>")
    spans = F.when((F.col("__size") > 0) & (F.col("__rest") > 0),
                   F.filter(part, lambda s: s["to_word"] > s["from_word"])).otherwise(none)
    x = (x.withColumn("spans", spans).withColumn("size", F.col("__size"))
         .withColumn("taken", F.col("passes") * F.col("__size")
                     + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to_word"] - s["from_word"])))
    return x.select(*[F.col(f"`{c}`") for c in d.columns if not c.startswith("__")], *OUT)


# ---------------------------------------------------------------------------
# DuckDB SQL of the whole mix over a relation with doc_id, text, source.

def mix_sql(relation: str, final: str, max_repeats: int = 3, block_words: int = BLOCK_WORDS,
            shard_words: int = SHARD_WORDS, seed: int = 7, prelude: str = "") -> str:
    """SQL twin of ``mix_to_weights`` with cyclic weights; ``final`` selects from ``mixed``."""
    def lague(src: str, out: str, group: str, share: str, total: str, seats: str, tie: str) -> str:
        return f"""
{out}_b AS (SELECT *, coalesce({share} * {seats} / nullif(CAST({total} AS DOUBLE), 0), 0) AS quota FROM {src}),
{out}_c AS (SELECT *, CAST(floor(quota + 0.5) AS BIGINT) AS seats0 FROM {out}_b),
{out}_d AS (SELECT *, CAST({seats} - sum(seats0) OVER (PARTITION BY {group}) AS BIGINT) AS diff,
            count(*) OVER (PARTITION BY {group}) AS n_rows,
            dense_rank() OVER (PARTITION BY {group} ORDER BY {tie}) AS tie_rank FROM {out}_c),
{out}_e AS (SELECT *, unnest(range(0, CASE WHEN diff = 0 THEN 0 ELSE CAST(coalesce(floor(quota * (abs(diff) + n_rows)
            / nullif(CAST({seats} AS DOUBLE), 0)) + 2, 0) AS BIGINT) END)) AS j FROM {out}_d),
{out}_f AS (SELECT *, CASE WHEN diff > 0 THEN seats0 + j ELSE seats0 - 1 - j END AS seat FROM {out}_e),
{out}_g AS (SELECT *, {share} / CAST(2 * seat + 1 AS DOUBLE) AS q FROM {out}_f WHERE seat >= 0),
{out}_h AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN diff > 0 THEN -q ELSE q END,
            CASE WHEN diff > 0 THEN tie_rank ELSE -tie_rank END, seat) AS r FROM {out}_g),
{out}_i AS (SELECT {group}, {tie} AS t, sum(sign(diff)) AS fix FROM {out}_h WHERE r <= abs(diff) GROUP BY {group}, {tie}),
{out} AS (SELECT d.*, d.seats0 + CAST(coalesce(i.fix, 0) AS BIGINT) AS seats FROM {out}_d d
          LEFT JOIN {out}_i i ON d.{group} = i.{group} AND d.{tie} = i.t)"""
    b = block_words
    return f"""WITH {prelude}
docs_ AS (SELECT doc_id, text, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS k,
  coalesce('s' || source, '~') AS skey FROM {relation}),
base_ AS (SELECT *, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS slot FROM docs_),
src0 AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM base_ GROUP BY skey, source),
src1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         source_size * {max_repeats} AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM src0),
src2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0)) / nullif(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, skey
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lvl FROM src1),
src3 AS (SELECT *, coalesce(cap <= lvl * weight, true) AS capped FROM src2),
src4 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE max(CASE WHEN NOT capped THEN lvl END) OVER () * weight END AS target,
         CAST(round(total / {b}) AS BIGINT) AS blocks, 1 AS one FROM src3),
{lague('src4', 'src5', 'one', 'target', 'total', 'blocks', 'skey')},
src_ AS (SELECT skey, source_size, target, seats AS source_seats,
         greatest(1, CAST(ceil(source_size / {shard_words}) AS BIGINT)) AS n_shards FROM src5),
sh0 AS (SELECT b.skey, b.slot % s.n_shards AS shard, CAST(sum(size) AS BIGINT) AS n, any_value(s.source_size) AS source_size,
        any_value(s.source_seats) AS source_seats FROM base_ b JOIN src_ s ON b.skey = s.skey GROUP BY 1, 2),
{lague('sh0', 'sh1', 'skey', 'n', 'source_size', 'source_seats', 'shard')},
sh_ AS (SELECT skey, shard, n, least(seats * {b}, n * {max_repeats}) AS quota,
        CAST('0x' || substr(md5('{seed}|' || skey || '|' || shard), 1, 8) AS BIGINT) AS off FROM sh1),
m0 AS (SELECT b.*, s.source_size, s.target, b.slot % s.n_shards AS shard,
       CAST(sum(b.size) OVER (PARTITION BY b.skey, b.slot % s.n_shards ORDER BY k, b.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e
       FROM base_ b JOIN src_ s ON b.skey = s.skey),
m1 AS (SELECT m0.*, e - size AS st, h.n, h.off, h.n // {b} AS fl, CASE WHEN h.n > 0 THEN h.quota // h.n ELSE 0 END AS passes,
       CASE WHEN h.n > 0 THEN h.quota % h.n ELSE 0 END AS rest
       FROM m0 JOIN sh_ h ON m0.skey = h.skey AND m0.shard = h.shard),
mixed AS (SELECT doc_id, text, source, size, source_size, target, passes,
  CAST(passes * size + CASE WHEN size = 0 OR rest = 0 THEN 0 ELSE coalesce(list_sum(list_transform(
    range(st // {b}, (e - 1) // {b} + 1), lambda g: greatest(0, least(e, g * {b} + greatest(0, CASE WHEN g < fl
      THEN least({b}, rest - ((g * {STRIDE} + off) % greatest(fl, 1)) * {b}) ELSE rest - fl * {b} END))
      - greatest(st, g * {b})))), 0) END AS BIGINT) AS taken FROM m1)
{final}"""
