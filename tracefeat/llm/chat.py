"""Chat formatting: logged snapshots of a conversation collapse into the longest one before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART_CHARS = 1 << 24         # a conversation's text is cut into rows of about so many characters
PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F     # hash of turns h1..hn: sum of h(i) BASE^(n - i)


def _quoted(text: str | None) -> str:
    """Text with the template's own markers broken up, so that a turn cannot open another."""
    return (text or "").replace(OPEN, "< |im_start|>").replace(CLOSE, "< |im_end|>")


def make_chain(part_chars: int):
    """mapInArrow function over turns sorted by (ckey, turn, role, text): hash of the turns so far, rendered pieces.

    Hash and position count from the first turn of the conversation in this
    partition.  ``close`` marks its last turn here, ``edge`` that of the first
    and the last conversation of the partition, which may go on in others.  A
    piece of text stands at the turn that fills it or closes.  Every row of a
    null conversation id is a conversation of its own.
    """
    def chain(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["part", "ckey", "conv", "pos", "prefix", "close", "edge", "text"]
        key, turn, pos, h, first, alone = None, None, 0, 0, True, 0
        held, text, chars, kind, out, size = None, [], 0, None, [], 0

        def bytes_of(v):
            raw = b"\x00" if v is None else b"\x01" + v.encode()
            return len(raw).to_bytes(8, "little") + raw

        def release(close, edge):
            nonlocal text, chars, size
            piece = None
            if close or chars >= part_chars:
                piece, text, chars = "".join(text), [], 0
                size += len(piece)
            out.append((*held, close, edge, piece))

        def batch_of(rows):
            kinds = [pa.int32(), pa.string(), kind, pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kind = batch.schema.field(1).type
            for ckey, conv, number, role, said in zip(*(c.to_pylist() for c in batch.columns)):
                this = (number, role, said)
                if ckey == key and this == turn:
                    continue                                   # the same row logged again
                new = ckey != key or ckey == "~"
                if held:
                    release(new, new and first and held[1][0] != "~")
                    first = first and not new
                if new:
                    key, pos, h = ckey, 0, 0
                turn, pos = this, pos + 1
                own = int.from_bytes(hashlib.blake2b(bytes_of(role) + bytes_of(said), digest_size=16).digest(), "little")
                h = (h * BASE + own) % PRIME
                if ckey == "~":
                    alone += 1
                    held = (part, f"~{part}:{alone}", None, pos, f"{h:032x}")
                else:
                    held = (part, ckey, conv, pos, f"{h:032x}")
                text.append(f"{OPEN}{'unknown' if role is None else role}\n{_quoted(said)}{CLOSE}\n")
                chars += len(text[-1])
                if len(out) >= 10_000 or size >= 1 << 24:
                    yield batch_of(out)
                    out, size = [], 0
        if held:
            release(True, held[1][0] != "~")
            yield batch_of(out)
    return chain


def make_carry(carried):
    """Arrow UDF over broadcast {(part, ckey): (turns before, their hash, goes on)}: whole position, hash and end."""
    @F.arrow_udf("struct<pos:long,prefix:string,last:boolean>")
    def carry(part, ckey, pos, prefix, close):
        import pyarrow as pa
        known = carried.value
        parts = {p for p, _ in known}
        out = []
        for p, c, n, h, end in zip(*(v.to_pylist() for v in (part, ckey, pos, prefix, close))):
            if p in parts and (p, c) in known:
                before, above, on = known[p, c]
                h = f"{(above * pow(BASE, n, PRIME) + int(h, 16)) % PRIME:032x}"
                n, end = n + before, end and not on
            out.append({"pos": n, "prefix": h, "last": end})
        return pa.array(out, pa.struct([("pos", pa.int64()), ("prefix", pa.string()), ("last", pa.bool_())]))
    return carry


def chain_table(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, part_chars: int) -> DataFrame:
    """(part, ckey, conv, pos, prefix, last, text): turns in order with the hash of the turns so far, and rendered pieces.

    Sorted by ranges of the whole key, so a conversation of any size is spread
    over tasks; the hashes of its ranges are put together on the driver from
    one row per range end (two per partition at most).
    """
    spark = turns.sparkSession
    t = turns.select(F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("~")).alias("ckey"),
                     F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                     F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # rows without an id are told apart by content only: equal ones go before the sort, the rest need no order
    alone = t.where("conv is null").distinct().withColumn("spread", F.xxhash64("turn", "role", "text"))
    t = t.where("conv is not null").withColumn("spread", F.lit(0).cast("long")).unionByName(alone)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = F.substring("text", 1, 64)                         # equal starts stay together; keeps the bounds small
    kind = dict(turns.dtypes)[conv_col]
    chain = materialise(
        t.repartitionByRange(n, "ckey", "spread", "turn", "role", start)
        .sortWithinPartitions("ckey", "spread", "turn", "role", "text").drop("spread").mapInArrow(
            make_chain(part_chars), f"part int, ckey string, conv {kind}, pos long, prefix string, close boolean, "
                                    "edge boolean, text string"), "chat-chain")
    carried, open_at = {}, {}
    edges = chain.where("edge").select("ckey", "part", "pos", "prefix").collect()
    for r in sorted(edges, key=lambda r: (r["ckey"], r["part"])):
        last = open_at.get(r["ckey"])
        before, above = (0, 0) if last is None else last[1:]
        if last is not None:
            carried[last[0], r["ckey"]] = (*carried[last[0], r["ckey"]][:2], True)
        carried[r["part"], r["ckey"]] = (before, above, False)
        open_at[r["ckey"]] = (r["part"], before + r["pos"],
                              (above * pow(BASE, r["pos"], PRIME) + int(r["prefix"], 16)) % PRIME)
    whole = make_carry(spark.sparkContext.broadcast(carried))("part", "ckey", "pos", "prefix", "close")
    return chain.withColumn("whole", whole).select("part", "ckey", "conv", "whole.*", "text")


def _maximal(chain: DataFrame) -> DataFrame:
    ends = chain.where("last").groupBy("prefix").agg(
        F.min(F.struct(F.col("conv").isNull().alias("none"), "conv", "ckey", "pos")).alias("head"),
        F.count(F.lit(1)).alias("n_copies"))
    inside = chain.where(~F.col("last")).select("prefix").distinct()
    return ends.join(inside, "prefix", "left_anti").select("head.ckey", "head.conv", F.col("head.pos").cast("int").alias(
        "n_turns"), "n_copies")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """One rendered text per maximal conversation: conv, n_turns, n_copies, text, part.

    Turns are ordered by number, role, text (nulls first); a row equal to the
    one before it is the same turn logged again.  A rolling 127-bit hash of
    (role, text) runs along each conversation; one whose last hash is a hash
    inside a longer one is a snapshot of it and goes (anti-join).  Of
    conversations with equal turns the smallest id stays, ``n_copies`` counts
    them.  Every distinct row of a null conversation id is a conversation of
    one turn; such rows are spread by a hash of their content.  Rows of one
    conversation equal in turn, role and the first 64 characters meet in one
    sorted stream, which holds one of them at a time.

    Each turn renders as ``<|im_start|>role NL text<|im_end|> NL``; a null role
    is "unknown", a null text is empty, the markers inside a turn are broken
    up.  A text of more than ``part_chars`` characters comes in several rows,
    ``part`` 0, 1, ... in order, cut between turns, each of about twice that
    at most (or one turn); all others are part 0.  An empty table gives an
    empty table; other columns are ignored.
    """
    chain = chain_table(turns, conv_col, turn_col, role_col, text_col, part_chars)
    kept = materialise(_maximal(chain), "chat-kept")
    pieces = chain.where("text is not null").select("ckey", "pos", "text")
    meta = pieces.select("ckey", "pos", F.length("text").alias("n"))
    several = meta.groupBy("ckey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ckey")
    to_here = Window.partitionBy("ckey").orderBy("pos")
    cells = materialise(
        meta.join(several, "ckey", "left_semi")
        .withColumn("cell", F.floor((F.sum("n").over(to_here) - F.col("n")) / F.lit(part_chars)))
        .select("ckey", "pos", (F.dense_rank().over(Window.partitionBy("ckey").orderBy("cell")) - 1).alias("part")),
        "chat-cells")                                          # a row for each part_chars and each end of a partition
    pieces = pieces.join(cells, ["ckey", "pos"], "left")
    one = pieces.where("part is null").select("ckey", "text", F.lit(0).alias("part"))
    parts = pieces.where("part is not null").groupBy("ckey", "part").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "").alias("text"))
    return one.unionByName(parts).join(kept, "ckey").select("conv", "n_turns", "n_copies", "text", "part")


SQL = """
WITH t0 AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM t0),
c AS (SELECT conv_id, CAST(count(*) AS INT) AS n_turns,
        list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
        string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(replace(coalesce(text, ''),
          '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), ''
          ORDER BY turn, role, text) AS text FROM t GROUP BY conv_id, alone),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS pre FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
g AS (SELECT *, count(*) OVER (PARTITION BY turns) AS n_copies FROM c
      QUALIFY row_number() OVER (PARTITION BY turns ORDER BY conv_id NULLS LAST) = 1)
SELECT conv_id, n_turns, CAST(n_copies AS BIGINT) AS n_copies, text, 0 AS part
FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = g.turns)
"""
