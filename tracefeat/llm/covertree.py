"""Exact cosine links between embeddings: cover trees per block, dual traversal of block pairs, tiles of blocks a task."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.llm.common import materialise
from tracefeat.llm.components import connected_components

BLOCK = 2048                 # vectors of a block: one cover tree
MAX_TILE = 8                 # blocks of a tile side at most
TILE_BYTES = 32 << 20        # doubles of a tile side: a task holds two sides
MAX_PIVOTS = 256             # pivots of the top level, so the broadcast is 256 x dimension doubles at most
PAIR_SCHEMA = "cid long, n_add long, root long"


def _units(column):
    """Arrow list column -> unit vectors in double precision (scaled first, so squares cannot overflow)."""
    import numpy as np
    col = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if len(col) == 0:
        return np.zeros((0, 1))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cover_tree(x, radii=(1.0, 0.5, 0.25)):
    """Levels of a cover tree over unit vectors, coarse to fine.

    A level is (centres, parents, radius): point numbers of the nodes, the
    node of the level above each belongs to, and the farthest point a node
    really holds.  The root covers the sphere (radius 2), every level halves
    the covering radius, centres of a level stay centres below, and the last
    level holds the points themselves with radius 0.
    """
    import numpy as np

    def dist(pts, centre):
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[pts] @ x[centre])))

    n = len(x)
    everyone = np.arange(n)
    levels = [(np.array([0]), np.array([0]), np.array([dist(everyone, 0).max()]))]
    members = [everyone]
    for r in radii:
        centres, parents, reach, below = [], [], [], []
        for node, pts in enumerate(members):
            own = levels[-1][0][node]
            left = np.concatenate(([own], pts[pts != own]))
            while len(left):
                c = left[0]
                d = dist(left, c)
                near = d <= r
                near[0] = True
                centres.append(c)
                parents.append(node)
                reach.append(d[near].max())
                below.append(left[near])
                left = left[~near]
        levels.append((np.array(centres), np.array(parents), np.array(reach)))
        members = below
    node_of = np.empty(n, dtype=np.int64)
    for node, pts in enumerate(members):
        node_of[pts] = node
    levels.append((everyone, node_of, np.zeros(n)))
    return levels


def dual_traversal(xa, ta, xb, tb, min_cos):
    """Point pairs (i, j) of two trees with cosine >= min_cos.

    Level by level, a pair of nodes lives on while its parents did and the
    distance of its centres is within the two covering radii plus the
    threshold distance.  The last level compares points by their cosine.
    """
    import numpy as np
    eps = math.sqrt(2.0 - 2.0 * min_cos) + 1e-9
    alive = np.ones((1, 1), dtype=bool)
    last = len(ta) - 1
    for k, ((ca, pa_, ra), (cb, pb_, rb)) in enumerate(zip(ta, tb)):
        if k:
            alive = alive[pa_][:, pb_]
        n = int(alive.sum())
        if not n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if n * 8 < alive.size:                    # few pairs left: only theirs
            i, j = np.nonzero(alive)
            dot = np.einsum("ij,ij->i", xa[ca[i]], xb[cb[j]])
            ok = dot >= min_cos if k == last else \
                np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot)) <= ra[i] + rb[j] + eps
            alive = np.zeros_like(alive)
            alive[i[ok], j[ok]] = True
        else:
            dot = xa[ca] @ xb[cb].T
            alive &= dot >= min_cos if k == last else \
                np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot)) <= ra[:, None] + rb[None, :] + eps
    i, j = np.nonzero(alive)
    return ta[-1][0][i], tb[-1][0][j]


def local_roots(n, i, j):
    """Smallest point reachable from each of ``n`` points over the pairs (i, j)."""
    import numpy as np
    lab = np.arange(n)
    while True:
        before = lab.copy()
        np.minimum.at(lab, i, lab[j])
        np.minimum.at(lab, j, lab[i])
        lab = lab[lab]
        if (lab == before).all():
            return lab


def make_tile_task(min_cos: float):
    """applyInArrow function for one tile: per class its linked vectors and spanning links, never the pairs.

    Rows carry the slot of their block in the tile and the slots (as bits) it
    meets.  Every block gets one cover tree; every pair of blocks that meets
    is traversed once and its pairs shrink to counts and one link a class
    before the next pair is taken, so memory holds two blocks' pairs at most.
    """
    def task(t: pa.Table) -> pa.Table:
        import numpy as np
        order = t.column("cid").combine_chunks().to_numpy().argsort(kind="stable")
        t = t.take(pa.array(order))
        cid, slot, copies = (t.column(c).to_numpy() for c in ("cid", "slot", "copies"))
        mask, x = t.column("mask").to_numpy(), _units(t.column("vec"))
        rows = {int(k): np.nonzero(slot == k)[0] for k in np.unique(slot)}
        trees = {k: cover_tree(x[r]) for k, r in rows.items()}
        add = np.zeros(len(cid))
        up, low = [], []
        for k, r in rows.items():
            meets = int(mask[r[0]])
            for m, q in rows.items():
                if not meets >> m & 1:
                    continue
                i, j = dual_traversal(x[r], trees[k], x[q], trees[m], min_cos)
                if m == k:
                    i, j = i[i < j], j[i < j]
                i, j = r[i], q[j]
                np.add.at(add, i, copies[j])
                np.add.at(add, j, copies[i])
                root = local_roots(len(cid), i, j)     # rows are in cid order: the smallest point is the smallest cid
                hit = np.nonzero(root != np.arange(len(cid)))[0]
                up.append(hit)
                low.append(root[hit])
        root = local_roots(len(cid), np.concatenate(up), np.concatenate(low)) if up else np.arange(len(cid))
        got = add > 0
        return pa.table({"cid": cid[got], "n_add": add[got].astype(np.int64), "root": cid[root][got]})
    return task


def make_nearest(pivots):
    """Arrow UDF: vector -> (nearest pivot, distance to it)."""
    schema = "struct<pivot:int,dist:double>"

    @F.arrow_udf(schema)
    def nearest(vecs: pa.Array) -> pa.Array:
        import numpy as np
        x = _units(vecs)
        p = np.asarray(pivots)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T))) if len(x) else np.zeros((0, len(p)))
        k = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(d[np.arange(len(k)), k])],
                                          ["pivot", "dist"])
    return nearest


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                      group_col: str = "label", min_cos: float = 0.93, block: int = BLOCK,
                      max_pivots: int = MAX_PIVOTS, max_tile: int = MAX_TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(id, n_links, component_id, kept) for every input row.

    Rows of one group (equal, not null) and one dimension link at cosine >=
    ``min_cos`` in double precision, exactly.  n_links counts the other rows
    linked directly; component_id is the smallest id reachable.  A null,
    empty or zero vector, one with null or non-finite components and a row
    of a null group link with nothing: 0 links, their own component.  Rows
    with equal vectors are one class with a count, compared once, so a huge
    group of copies costs one row; classes are told apart by two 64-bit
    hashes of group and vector and numbered once in a written table.  A null id is ignored by the minimum (a
    component of null ids only has a null component_id) and is never kept;
    rows repeating an id are separate rows.  An empty table gives an empty one.

    Groups over ``block`` classes are cut by the top level of the tree:
    bounded pivots (the ``max_pivots`` smallest keys at most), shells of equal
    counts around each pivot, and a hash inside oversized shells.  Block pairs
    whose centres and radii rule out a link are never formed.  The others go
    to tiles of neighbouring blocks, ``max_tile`` a side at most (15 at most: slots are bits) and
    ``tile_bytes`` of doubles: a task gets each of its blocks once however many
    partners they have there, so vectors travel once a tile row, not once a pair.
    """
    eps = math.sqrt(2.0 - 2.0 * min_cos) + 1e-9
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"     # as doubles only inside the tasks
    arr = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    inf = float("inf")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), arr.alias("vec"))
            .withColumn("ok", F.coalesce(F.col("grp").isNotNull() & (F.size("vec") > 0) & ~bad
                                         & F.exists("vec", lambda v: v != 0), F.lit(False)))
            .withColumn("grp", F.concat_ws(":", F.size("vec").cast("string"), "grp")))
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("grp", "vec")),
                             "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "vec", "grp"))})
    classes = materialise(rows.where("ok").groupBy("h1", "h2").agg(
        F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("low")).withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    sizes = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))

    # top level: pivots only if some group needs cutting
    top = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    n_pivots = min(max_pivots, -(-top // block)) if top > block else 0
    keyed = classes.join(sizes.where(F.col("n") > block).withColumnRenamed("n", "big"), "grp", "left")
    if n_pivots:
        import numpy as np
        chosen = [r["vec"] for r in keyed.where("big is not null").orderBy("h1", "h2").limit(n_pivots).collect()]
        dim = len(chosen[0])
        p = _units(pa.array([v for v in chosen if len(v) == dim], type=pa.list_(pa.float64())))
        near = make_nearest(p.tolist())(F.col("vec"))
        home = F.struct(F.lit(-1).alias("pivot"), F.lit(0.0).alias("dist"))
        split = keyed.where(F.col("big").isNotNull() & (F.size("vec") == dim)).withColumn("at", near)
        whole = keyed.where(F.col("big").isNull() | (F.size("vec") != dim)).withColumn("at", home)
        keyed = split.unionByName(whole).select("cid", "h1", "grp", "vec", "copies", "at.pivot", "at.dist")
        gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
        between = classes.sparkSession.createDataFrame(
            [(i, j, float(gaps[i, j])) for i in range(len(p)) for j in range(len(p))] + [(-1, -1, 0.0)],
            "pivot int, pivot2 int, gap double")
    else:
        keyed = keyed.select("cid", "h1", "grp", "vec", "copies", F.lit(-1).alias("pivot"), F.lit(0.0).alias("dist"))
        between = classes.sparkSession.createDataFrame([(-1, -1, 0.0)], "pivot int, pivot2 int, gap double")
    keyed = materialise(keyed, "vec-cells")
    cells = keyed.groupBy("grp", "pivot").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", [i / 64 for i in range(1, 64)], 1000).alias("marks"))
    cells = cells.withColumn("n_shells", F.least(F.lit(64), F.ceil(F.col("n") / block)).cast("int")) \
        .withColumn("cuts", F.when(F.col("n_shells") > 1, F.transform(
            F.sequence(F.lit(1), F.col("n_shells") - 1),
            lambda i: F.get("marks", F.floor(i * 64 / F.col("n_shells")).cast("int") - 1)))
                    .otherwise(F.array().cast("array<double>"))).select("grp", "pivot", "cuts")
    keyed = keyed.join(cells, ["grp", "pivot"]).withColumn(
        "shell", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    shells = keyed.groupBy("grp", "pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"),
                                                       F.max("dist").alias("hi"))
    shells = materialise(shells.withColumn("salts", F.ceil(F.col("n") / block).cast("int"))
                         .withColumn("hi", F.when(F.col("pivot") < 0, F.lit(2.0)).otherwise(F.col("hi"))), "vec-shells")
    # blocks in the order of the top level, cut into runs that make the sides of the tiles
    dim = F.greatest(F.split("grp", ":")[0].cast("long"), F.lit(1))
    in_order = Window.partitionBy("grp").orderBy("pivot", "shell", "salt")
    blocks = shells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumns({
        "num": F.row_number().over(in_order) - 1,
        "k": F.greatest(F.lit(1), F.least(F.lit(min(max_tile, 15)), F.floor(F.lit(tile_bytes) / (dim * 8 * block)))).cast("int")})
    blocks = blocks.withColumn("side", F.floor(F.col("num") / F.col("k")).cast("int"))
    two = blocks.select("grp", F.col("pivot").alias("pivot2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
                        F.col("num").alias("num2"), F.col("side").alias("side2"))
    pairs = (blocks.join(two, "grp").where("num <= num2")
             .join(between, ["pivot", "pivot2"])
             .where((F.col("gap") - F.col("hi") - F.col("hi2") <= eps) & (F.col("lo") - F.col("gap") - F.col("hi2") <= eps)
                    & (F.col("lo2") - F.col("gap") - F.col("hi") <= eps)))
    slot = F.pmod("num", "k")
    slot2 = F.pmod("num2", "k") + F.when(F.col("side") == F.col("side2"), 0).otherwise(F.col("k"))
    ends = F.array(F.struct(F.col("num"), slot.alias("slot"), F.call_function("shiftleft", F.lit(1), slot2).alias("bit")),
                   F.struct(F.col("num2").alias("num"), slot2.alias("slot"), F.lit(0).alias("bit")))
    routes = (pairs.select("grp", "side", "side2", F.explode(ends).alias("e"))
              .groupBy("grp", "side", "side2", "e.num", "e.slot").agg(F.bit_or("e.bit").alias("mask")))
    routes = materialise(routes.join(blocks.select("grp", "num", "pivot", "shell", "salt"), ["grp", "num"]).drop("num"),
                         "vec-routes")
    placed = (keyed.join(shells.select("grp", "pivot", "shell", "salts"), ["grp", "pivot", "shell"])
              .withColumn("salt", F.pmod(F.hash("h1"), F.col("salts"))))
    found = materialise(placed.join(routes, ["grp", "pivot", "shell", "salt"])
                        .select("grp", "side", "side2", "slot", "mask", "cid", "copies", "vec")
                        .groupBy("grp", "side", "side2").applyInArrow(make_tile_task(min_cos), PAIR_SCHEMA), "vec-links")

    n_add = found.groupBy("cid").agg(F.sum("n_add").alias("n_add"))
    roots = materialise(connected_components(found.select("cid", "root"), "cid", "root"), "vec-roots")
    base = materialise(rows.select("id", "h1", "h2"), "vec-rows")
    by_class = (classes.select("cid", "h1", "h2", "low", "copies")
                .join(n_add, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                .withColumn("root", F.coalesce("root", "cid")))
    by_class = materialise(by_class, "vec-by-class")
    heads = materialise(by_class.groupBy("root").agg(F.min("low").alias("component_id")), "vec-heads")
    by_class = materialise(by_class.join(heads, "root").select(
        "h1", "h2", (F.coalesce("n_add", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vec-linked")
    linked = base.where("h1 is not null").join(by_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = base.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.r = links.x),
c AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
