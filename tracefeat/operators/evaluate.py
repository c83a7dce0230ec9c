"""Evaluation and blending (E1-E12), all as DataFrame aggregations.

AUC is a rank statistic: scores are first reduced to one row per distinct
score (positives, negatives; partial aggregation on the map side), and the
negatives ranked below each score come from a distributed prefix sum, so no
step sorts the whole column in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.functions.columns import sigmoid
from tracefeat.plans.ranking import global_cumsum
from tracefeat.session import cut_lineage


# E1 / E2 -------------------------------------------------------------------
def auc(df: DataFrame, label: str = "y", score: str = "score", by=()) -> DataFrame:
    """ROC AUC with ties counted half, per ``by`` group (one row per group).
    A group with a single class has AUC NULL."""
    by = [by] if isinstance(by, str) else list(by)
    s = df.groupBy(*by, score).agg(F.sum(F.col(label)).alias("pos"),
                                   (F.count(F.lit(1)) - F.sum(F.col(label))).alias("neg"))
    return auc_from_counts(s, score, by)


def auc_from_counts(s: DataFrame, score: str = "score", by=()) -> DataFrame:
    """AUC from (by..., score, pos, neg) rows with one row per distinct score."""
    by = [by] if isinstance(by, str) else list(by)
    c = global_cumsum(s, score, ["neg"], by)
    contrib = F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)
    g = c.groupBy(*by).agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*by, F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("auc"))


# E3 / E4 -------------------------------------------------------------------
def oof_table(fold_preds: list[DataFrame]) -> DataFrame:
    """Stack per-fold predictions (row_id, fold, pred) into one OOF table."""
    out = fold_preds[0]
    for p in fold_preds[1:]:
        out = out.unionByName(p)
    return out


def cv_score(oof: DataFrame, label: str = "y", pred: str = "pred", weight_col: str | None = None) -> DataFrame:
    """AUC per fold and their mean (``fold`` = -1); with ``weight_col`` the
    fold scores are weight-summed instead (the network variant)."""
    per = auc(oof, label, pred, ["fold"])
    if weight_col:
        w = oof.groupBy("fold").agg(F.first(weight_col).alias("_w"))
        agg = per.join(w, "fold").agg(F.sum(F.col("auc") * F.col("_w")).alias("auc"))
    else:
        agg = per.agg(F.avg("auc").alias("auc"))
    return per.unionByName(agg.select(F.lit(-1).cast(per.schema["fold"].dataType).alias("fold"), "auc"))


def fold_mean_predictions(preds: DataFrame, key: str = "row_id", pred: str = "pred") -> DataFrame:
    return preds.groupBy(key).agg(F.avg(pred).alias(f"{pred}_mean"))


# E5 / E6 / E7 --------------------------------------------------------------
def blend(df: DataFrame, cols, weights, name: str = "blend") -> DataFrame:
    e = F.lit(0.0)
    for c, w in zip(cols, weights):
        e = e + F.col(c) * F.lit(float(w))
    return df.withColumn(name, e)


def weight_grid(n_models: int, step: float) -> list[tuple[float, ...]]:
    """All weight vectors on a simplex grid of ``step`` (last = 1 - rest)."""
    k = int(round(1 / step))
    out = []

    def rec(prefix, left):
        if len(prefix) == n_models - 1:
            out.append(tuple(x / k for x in prefix) + ((k - sum(prefix)) / k,))
            return
        for i in range(left + 1):
            rec(prefix + [i], left - i)
    rec([], k)
    return out


MAX_SCORE_ROWS = 1_000_000   # distinct score rows (about 40 MB) up to which every task may hold them all
GRID_BLOCK = 64              # weight vectors of one shuffle beyond that


def blend_search(df: DataFrame, cols, grid, label: str = "y", max_rows: int = MAX_SCORE_ROWS,
                 block: int = GRID_BLOCK) -> DataFrame:
    """AUC of every weight vector of ``grid`` (a bounded list built from a step), one row per vector (w0.., auc).

    Rows with equal model scores are merged first.  If at most ``max_rows``
    distinct score rows are left (counted), they are sent to the tasks once and
    the grid is spread over the tasks, each ranking its vectors' blends; no
    score row is copied per vector.  Beyond that the vectors are taken in
    blocks, and each block's blends are counted per (vector, score) and ranked
    by sorted ranges, so one shuffle holds ``block`` times the score rows,
    however fine the grid.  A blend with a null score ranks lowest."""
    cols = list(cols)
    d = cut_lineage(df.groupBy(*cols).agg(F.sum(F.col(label)).cast("long").alias("_pos"),
                                          (F.count(F.lit(1)) - F.sum(F.col(label))).cast("long").alias("_neg")))
    ws = [tuple(float(w) for w in g) for g in grid]
    weights = df.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(ws)],
                                              "gid int, " + ", ".join(f"w{j} double" for j in range(len(cols))))
    if d.limit(max_rows + 1).count() <= max_rows:
        a = _ranked_in_tasks(d, cols, ws)
    else:
        parts = [_ranked_by_shuffle(d, cols, list(enumerate(ws))[lo:lo + block]) for lo in range(0, len(ws), block)]
        a = parts[0]
        for p in parts[1:]:
            a = a.unionByName(p)
    return a.join(F.broadcast(weights), "gid").drop("gid")    # the grid is a bounded parameter list


def _ranked_in_tasks(d: DataFrame, cols: list, ws: list) -> DataFrame:
    """(gid, auc) of every weight vector; ``d`` is small enough for every task."""
    import numpy as np
    spark = d.sparkSession
    t = d.select(*[F.col(c).cast("double") for c in cols], "_pos", "_neg").toPandas()
    held = spark.sparkContext.broadcast((t[cols].to_numpy(dtype=np.float64, na_value=np.nan), t["_pos"].to_numpy(),
                                         t["_neg"].to_numpy(), t[cols].isna().any(axis=1).to_numpy()))

    def rank(batches):
        import pyarrow as pa
        x, pos, neg, null = held.value
        pairs = float(pos.sum()) * float(neg.sum())
        for b in batches:
            out = []
            for g in b.column(0).to_pylist():
                score = np.zeros(len(x))
                for j, w in enumerate(ws[g]):
                    score = score + x[:, j] * w
                score[null] = -np.inf
                _, tie = np.unique(score, return_inverse=True)
                p, n = np.bincount(tie, weights=pos), np.bincount(tie, weights=neg)
                out.append(float((p * (np.cumsum(n) - n / 2.0)).sum() / pairs) if pairs else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["gid", "auc"])

    gids = spark.range(len(ws)).select(F.col("id").cast("int").alias("gid"))
    return gids.repartition(min(len(ws), spark.sparkContext.defaultParallelism * 4)).mapInArrow(rank, "gid int, auc double")


def _ranked_by_shuffle(d: DataFrame, cols: list, grid: list) -> DataFrame:
    """(gid, auc) of one block of numbered weight vectors by distributed ranking."""
    arr = F.array(*[F.struct(F.lit(i).alias("gid"), *[F.lit(w).alias(f"w{j}") for j, w in enumerate(g)]) for i, g in grid])
    x = d.select("_pos", "_neg", *cols, F.explode(arr).alias("_g"))
    score = F.lit(0.0)
    for j, c in enumerate(cols):
        score = score + F.col(c) * F.col(f"_g.w{j}")
    s = x.groupBy(F.col("_g.gid").alias("gid"), score.alias("score")).agg(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))
    return cut_lineage(auc_from_counts(s, "score", ["gid"]))


def best_weights(results: DataFrame, n_models: int) -> DataFrame:
    """The best AUC row (ties: smallest weights first)."""
    order = [F.col("auc").desc()] + [F.col(f"w{j}").asc() for j in range(n_models)]
    return results.orderBy(*order).limit(1)


# E8 ------------------------------------------------------------------------
def task_mean_smoothing(df: DataFrame, pred: str, te: str, a: float = 0.8, b: float = 0.1, c: float = 0.1,
                        name: str = "pred_smoothed") -> DataFrame:
    w = Window.partitionBy("user_id", "task_container_id")
    return df.withColumn(name, F.col(pred) * a + F.avg(pred).over(w) * b + F.col(te) * c)


# E9 ------------------------------------------------------------------------
def smoothed_bce_with_logits(logit: Column, y: Column, smoothing: float = 0.0) -> Column:
    """Numerically stable BCE with logits on targets y(1-s) + 0.5 s."""
    t = y * (1.0 - smoothing) + 0.5 * smoothing
    return F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit)))


def mean_loss(df: DataFrame, logit: str, label: str, smoothing: float = 0.0) -> DataFrame:
    return df.agg(F.avg(smoothed_bce_with_logits(F.col(logit), F.col(label), smoothing)).alias("loss"))


# E10 -----------------------------------------------------------------------
def model_disagreement(df: DataFrame, a: str, b: str, label: str = "y") -> DataFrame:
    return df.withColumns({
        f"err_{a}": F.abs(F.col(label) - F.col(a)),
        f"err_{b}": F.abs(F.col(label) - F.col(b)),
    }).withColumns({
        "err_diff": F.col(f"err_{a}") - F.col(f"err_{b}"),
        "err_mean": (F.col(f"err_{a}") + F.col(f"err_{b}")) / 2,
    })


# E11 -----------------------------------------------------------------------
def importance_table(imp: DataFrame) -> DataFrame:
    """(fold, feature, importance) stacked -> mean / std per feature, sorted."""
    return (imp.groupBy("feature").agg(F.avg("importance").alias("importance_mean"),
                                       F.stddev_samp("importance").alias("importance_std"))
            .orderBy(F.col("importance_mean").desc(), "feature"))


# E12 -----------------------------------------------------------------------
def accuracy_at_half(df: DataFrame, logit: str, label: str) -> DataFrame:
    hit = ((sigmoid(F.col(logit)) >= 0.5).cast("int") == F.col(label)).cast("int")
    return df.agg(F.avg(hit).alias("accuracy"))
