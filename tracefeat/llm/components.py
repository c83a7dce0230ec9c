"""Connected components of a link table, as Spark rounds (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node reachable.

    Self-links, repeated links and null ends are ignored; an empty table gives
    an empty table.  Each half round aggregates minima (map-side combined) and
    joins them back through two written tables, so a hub with a third of all
    links is split by the skew join and an executor loss costs a re-read.
    Only counts and a checksum come to the driver.  Rounds grow with the
    logarithm of the longest chain; links that still change after
    ``max_rounds`` are an error.
    """
    e = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    e = materialise(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    sig = _signature(e)
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        # large star: every node hands the smallest node it sees to its larger neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "links")
        star = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                           .where("a > b").distinct(), "links")
        # small star: every node hands it to its smaller neighbours and itself
        low = materialise(star.groupBy("a").agg(F.min("b").alias("m")), "links")
        nxt = (star.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        e = materialise(nxt, "links")
        new = _signature(e)
        if new == sig:
            break
        sig = new
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
