"""Fold assignment and time-aware validation splits (V1-V9).

Every split is a column (``fold``, ``is_val``, ``cv``) on the log, never a
driver-side index list.  Orders that the reference takes from a random
shuffle are seeded hashes here, so a split is reproducible and needs no
global sort unless the semantics are a global order (V2, V4, V7), which go
through the range-partitioned ``global_rank``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefeat.plans.joins import dim_join
from tracefeat.plans.ranking import global_rank


def _hash_order(seed: int):
    return F.xxhash64(F.col("row_id"), F.lit(seed))


# V1 ------------------------------------------------------------------------
def kfold(df: DataFrame, k: int = 5, seed: int = 0, method: str = "hash", weights=None) -> DataFrame:
    """fold in 0..k-1 and its weight (1/k or a given list)."""
    if method == "hash":
        fold = F.pmod(_hash_order(seed), F.lit(k))
    else:
        fold = F.pmod(F.col("row_id"), F.lit(k))
    df = df.withColumn("fold", fold.cast("int"))
    if weights is None:
        return df.withColumn("fold_weight", F.lit(1.0 / k))
    wmap = F.create_map(*[x for i, w in enumerate(weights) for x in (F.lit(i), F.lit(float(w)))])
    return df.withColumn("fold_weight", wmap[F.col("fold")])


# V2 / V4 -------------------------------------------------------------------
def stratified_kfold(df: DataFrame, label_cols, k: int = 5, order: str = "hash", seed: int = 0) -> DataFrame:
    """Equal class share per fold: position within the class (label or label
    combination for V4) modulo k.  ``order='id'`` numbers by row_id."""
    label_cols = [label_cols] if isinstance(label_cols, str) else list(label_cols)
    if order == "hash":
        df = df.withColumn("_ord", _hash_order(seed))
        keys = ["_ord", "row_id"]
    else:
        keys = ["row_id"]
    r = global_rank(df, keys, partition_cols=label_cols, name="_pos")
    out = r.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos")
    return out.drop("_ord") if order == "hash" else out


MAX_CLASSES = 1_000_000      # distinct label vectors that the fold plan may hold on the driver


def _dealt(df: DataFrame, keys, order, plan, k: int) -> DataFrame:
    """``df`` with ``fold``: the members of a class, ranked by ``order``, go to the folds in turn; those left
    over (fewer than k) go where ``plan`` (class -> list of folds) says."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keys)]
                          + [T.StructField("_even", T.LongType()), T.StructField("_rest", T.ArrayType(T.IntegerType()))])
    rows = [(*key, n // k * k, rest) for key, n, rest in plan]
    r = global_rank(df, order, partition_cols=keys, name="_pos")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    r = dim_join(r, spark.createDataFrame(rows, schema), on, "inner", max_rows=MAX_CLASSES)
    p = F.col("_pos") - 1
    fold = F.when(p < F.col("_even"), F.pmod(p, F.lit(k))).otherwise(F.get(F.col("_rest"), (p - F.col("_even")).cast("int")))
    return r.withColumn("fold", fold.cast("int")).drop("_pos", "_even", "_rest", *[f"_k{i}" for i in range(len(keys))])


def _classes(df: DataFrame, keys, what: str) -> list:
    """(key values, members) of every class, in key order; an error beyond ``MAX_CLASSES``."""
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy(*[F.col(c).asc_nulls_first() for c in keys]) \
        .limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct {what}")
    return [(tuple(r[:-1]), r[-1]) for r in rows]


def multilabel_plan(classes: list, k: int) -> list:
    """(label vector, rows, folds of the rows left over) per class.

    A label is a (column, value) pair.  Labels are taken from the rarest to the
    commonest (ties by column, then value, nulls first), and with each the
    vectors that hold it and are not yet dealt, in their order.  A class gives
    each fold the same number of rows; what is left over goes row by row to the
    fold with the largest remaining need of that label, then with the largest
    need over all labels of the vector, then to the first.  A fold's need of a
    label is its target (a k-th of the label's rows) less what it holds; it is
    kept k-fold, as an integer."""
    def place(label):
        return label[0], label[1] is not None, label[1] if label[1] is not None else 0

    total: dict = {}
    for key, n in classes:
        for label in enumerate(key):
            total[label] = total.get(label, 0) + n
    need = {label: [n] * k for label, n in total.items()}
    out, done = [], set()
    for main in sorted(total, key=lambda label: (total[label], place(label))):
        for key, n in classes:
            if key in done or key[main[0]] != main[1]:
                continue
            done.add(key)
            labels = list(enumerate(key))
            for label in labels:
                need[label] = [x - k * (n // k) for x in need[label]]
            rest = []
            for _ in range(n % k):
                f = max(range(k), key=lambda f: (need[main][f], sum(need[label][f] for label in labels), -f))
                for label in labels:
                    need[label][f] -= k
                rest.append(f)
            out.append((key, n, rest))
    return out


def multilabel_stratified_kfold(df: DataFrame, label_cols, k: int = 5, seed: int = 0, order: str = "hash") -> DataFrame:
    """Folds in which every label (column and value) has nearly its share: rows with equal labels are one class,
    and the classes are dealt by ``multilabel_plan``, which sees only their counts.  ``order='id'``
    numbers a class's rows by row_id instead of a seeded hash."""
    label_cols = list(label_cols)
    plan = multilabel_plan(_classes(df, label_cols, "label vectors"), k)
    if order == "id":
        return _dealt(df, label_cols, ["row_id"], plan, k)
    return _dealt(df.withColumn("_ord", _hash_order(seed)), label_cols, ["_ord", "row_id"], plan, k).drop("_ord")


# V3 / V5 -------------------------------------------------------------------
def _snake(pos, k: int):
    """Boustrophedon assignment of a 0-based rank: 0..k-1, k-1..0, 0..k-1, ..."""
    block = F.floor(pos / k)
    p = F.pmod(pos, F.lit(k))
    return F.when(F.pmod(block, F.lit(2)) == 0, p).otherwise(F.lit(k - 1) - p).cast("int")


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A group stays in one fold; groups ranked by size (desc) are dealt to folds
    in snake order, which balances fold sizes without a driver-side loop."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = global_rank(sizes.withColumn("_neg", -F.col("_size")), ["_neg", group], name="_r")
    folds = ranked.select(group, _snake(F.col("_r") - 1, k).alias("fold"))
    return df.join(folds, group, "left")


def group_plan(classes: list, totals: list, k: int) -> list:
    """(label counts, groups, folds of the groups left over) per class of groups with equal label counts.

    Classes are taken by group size, largest first (ties by the counts).  A class
    gives each fold the same number of groups; each group left over goes to
    the fold where it leaves the smallest mean, over the labels, of the standard
    deviation of the folds' shares of the label (equal to 12 digits: the first)."""
    import numpy as np
    share = np.maximum(np.array(totals, dtype=float), 1.0)
    held = np.zeros((k, len(totals)))
    out = []
    for counts, n in sorted(classes, key=lambda c: (-sum(c[0]), c[0])):
        c = np.array(counts, dtype=float)
        held += c * (n // k)
        rest = []
        for _ in range(n % k):
            tried = held[None, :, :] + np.eye(k)[:, :, None] * c[None, None, :]
            spread = np.round((tried / share).std(axis=1).mean(axis=1), 12)
            f = int(spread.argmin())
            held[f] += c
            rest.append(f)
        out.append((counts, n, rest))
    return out


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """Groups stay whole and folds get a similar label mix: greedy by least mean deviation of the label shares.

    The greedy rule runs over classes of groups with equal label counts (their
    number is what the driver holds), so a million groups alike are one step;
    within a class the groups are ranked by their key and dealt."""
    values = [r[0] for r in df.select(label).distinct().orderBy(F.col(label).asc_nulls_first()).collect()]
    names = [f"_l{i}" for i in range(len(values))]
    stats = df.groupBy(group).agg(*[F.sum(F.col(label).eqNullSafe(F.lit(v)).cast("long")).alias(n) for v, n in zip(values, names)])
    totals = df.agg(*[F.sum(F.col(label).eqNullSafe(F.lit(v)).cast("long")) for v in values]).first() if values else []
    if not values:
        return df.withColumn("fold", F.lit(0))
    folds = _dealt(stats, names, [group], group_plan(_classes(stats, names, "label counts of a group"), list(totals), k), k)
    folds = folds.select(F.col(group).alias("_g"), "fold")
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


# V6 ------------------------------------------------------------------------
def tail_split(df: DataFrame, n: int = 5) -> DataFrame:
    """is_val = 1 for the last n rows of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("row_id").desc())
    return df.withColumn("is_val", (F.row_number().over(w) <= n).cast("int"))


# V7 ------------------------------------------------------------------------
def user_offsets(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Per-user random shift in [0, maxT - user_max].  With ``seed=None`` the
    draw is the deterministic rule (user_id * 7919) % 1000 / 1000 (oracle form)."""
    u = df.groupBy("user_id").agg(F.max("timestamp").alias("max_time_stamp"))
    room = df.agg(F.max("timestamp")).scalar() - F.col("max_time_stamp")
    if seed is None:
        off = F.floor(room * F.pmod(F.col("user_id") * 7919, F.lit(1000)) / 1000)
    else:
        off = F.floor(room * F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000)
    return u.withColumn("rand_time_stamp", off.cast("long"))


def virtual_time_split(df: DataFrame, val_size: int | None = None, n_cuts: int = 5, seed: int | None = None,
                       val_share: float = 0.1) -> DataFrame:
    """Shift users onto one time axis, sort by (virtual time, row_id) and cut the
    last ``val_size`` rows as cut 1, the ``val_size`` before as cut 2, ...;
    ``cv`` = cut number (0 = never validation)."""
    if val_size is None:
        val_size = F.floor(df.agg(F.count(F.lit(1))).scalar() * val_share)
    else:
        val_size = F.lit(val_size)
    offs = user_offsets(df, seed)
    v = df.join(offs, "user_id", "left").withColumn("viretual_time_stamp",
                                                   F.col("timestamp") + F.col("rand_time_stamp"))
    r = global_rank(v, ["viretual_time_stamp", "row_id"], descending=True, name="_back")
    cut = F.floor((F.col("_back") - 1) / val_size) + 1
    return r.withColumn("cv", F.when(cut <= n_cuts, cut).otherwise(F.lit(0)).cast("int")).drop("_back")


# V8 ------------------------------------------------------------------------
def id_list_split(df: DataFrame, val_ids: DataFrame, key: str = "row_id") -> DataFrame:
    flag = val_ids.select(key).distinct().withColumn("is_val", F.lit(1))
    return df.join(flag, key, "left").withColumn("is_val", F.coalesce(F.col("is_val"), F.lit(0)))


# V9 ------------------------------------------------------------------------
def user_holdout(df: DataFrame, k: int = 5, fold: int = 0, n_bins: int = 200) -> DataFrame:
    """Stratify users on 200 equal-width bins of their row count into k folds and
    drop fold ``fold`` of users from the log."""
    from tracefeat.operators.prep import equal_width_bins
    users = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    users = equal_width_bins(users, "n_rows", n_bins, "n_bin").withColumn("row_id", F.col("user_id"))
    uf = stratified_kfold(users, "n_bin", k, order="id").filter(F.col("fold") == fold).select("user_id")
    return df.join(uf, "user_id", "left_anti")
