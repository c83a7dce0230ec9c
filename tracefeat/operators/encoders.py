"""Per-entity aggregates and encoders.

Encoders are lookup tables (``key -> values``) built with ``groupBy`` (partial
aggregation on the map side, so a hot key costs one partial row per task, not
a skewed shuffle) and attached to rows with a checked-broadcast join.  Out-of-
fold encodings aggregate once per (key, fold) and derive every fold's encoder
from the totals: one scan for k folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.functions.columns import EPS_STAT
from tracefeat.plans.joins import dim_join
from tracefeat.plans.segmented import whole_group_median
from tracefeat.session import cut_lineage

ORDER = ("timestamp", "row_id")
SMOOTH = 5            # smoothing weight of the "sm5" encodings
BORDER_SMOOTH = 10    # smoothing weight of the session-border rates
SESSION_GAP_MS = 600_000


def attach(df: DataFrame, table: DataFrame, keys) -> DataFrame:
    """Left-join an encoder table on its keys (broadcast only when proven small)."""
    return dim_join(df, table, list(keys) if not isinstance(keys, str) else [keys], "left")


def key_name(keys) -> str:
    return "xxx".join([keys] if isinstance(keys, str) else keys)


def with_median(table: DataFrame, df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``table`` (one row per key, null included) with the exact median of ``value`` over ``df``'s rows of the key."""
    med = whole_group_median(df, value, (key,), name).withColumnRenamed(key, "_key")
    return table.join(med, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


# A1 / A2 -------------------------------------------------------------------
def group_stats(df: DataFrame, by: str, c: str) -> DataFrame:
    """mean, median, sample std, max, min of ``c`` by ``by`` (an encoder table).
    The median comes from distributed ranks, so no group is held by one task."""
    t = df.groupBy(by).agg(
        (F.sum(c) / F.count(c)).alias(f"{c}_mean"),
        F.stddev_samp(c).alias(f"{c}_std"),
        F.max(c).alias(f"{c}_max"),
        F.min(c).alias(f"{c}_min"))
    return with_median(t, df, c, by, f"{c}_median")


def group_stats_ratio(df: DataFrame, by: str, c: str) -> DataFrame:
    """A1 attached to rows plus x/(mean+1e-5), x/(median+1e-5), x-mean, x-median."""
    t = group_stats(df, by, c)
    out = attach(df, t, by)
    return out.withColumns({
        f"{c}_div_mean_by_{by}": F.col(c) / (F.col(f"{c}_mean") + EPS_STAT),
        f"{c}_div_median_by_{by}": F.col(c) / (F.col(f"{c}_median") + EPS_STAT),
        f"{c}_diff_mean_by_{by}": F.col(c) - F.col(f"{c}_mean"),
        f"{c}_diff_median_by_{by}": F.col(c) - F.col(f"{c}_median"),
    })


# A3 ------------------------------------------------------------------------
def count_encoding(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """key -> frequency (a NULL key gets no entry, so it maps to NULL)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias(name or f"{key}_count")))


def count_encoding_add(encoder: DataFrame, new_rows: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Merge the counts of new rows into an encoder (union + sum)."""
    name = name or f"{key}_count"
    return (encoder.unionByName(count_encoding(new_rows, key, name))
            .groupBy(key).agg(F.sum(name).alias(name)))


# A4 / A5 / A6 / A7 -----------------------------------------------------------
def fold_sums(df: DataFrame, key: str, target: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(key, fold).agg(F.sum(target).alias("_fold_s"), F.count(target).alias("_fold_n"))


def fold_encoders(df: DataFrame, key: str, target: str, k: int, fold: str = "fold") -> DataFrame:
    """(key, fold, te): mean target of the rows outside the fold; a key with no
    rows outside the fold has no entry.  One aggregation for all k folds."""
    fs = fold_sums(df, key, target, fold)
    tot = fs.groupBy(key).agg(F.sum("_fold_s").alias("_tot_s"), F.sum("_fold_n").alias("_tot_n"))
    grid = tot.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    g = grid.join(fs, [key, fold], "left")
    s = F.col("_tot_s") - F.coalesce(F.col("_fold_s"), F.lit(0))
    n = F.col("_tot_n") - F.coalesce(F.col("_fold_n"), F.lit(0))
    return g.filter(n > 0).select(key, fold, (s / n).alias("te"))


def target_encoding_oof(df: DataFrame, key: str, target: str, fold: str = "fold",
                        name: str | None = None) -> DataFrame:
    """Each row gets the mean target of its key over the other folds (NULL if unseen there)."""
    name = name or f"te_{key}_by_{target}"
    fs = fold_sums(df, key, target, fold)
    tot = fs.groupBy(key).agg(F.sum("_fold_s").alias("_tot_s"), F.sum("_fold_n").alias("_tot_n"))
    enc = fs.join(tot, key).select(key, fold, F.try_divide((F.col("_tot_s") - F.col("_fold_s")).cast("double"),
                                                           (F.col("_tot_n") - F.col("_fold_n")).cast("double")).alias(name))
    return attach(df, enc, [key, fold])


def target_encoding_apply(df: DataFrame, encoders: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Unseen rows: mean of the k fold encoders; NULL if any fold lacks the key."""
    m = encoders.groupBy(key).agg(F.count("te").alias("_k"), F.sum("te").alias("_s"))
    m = m.select(key, F.when(F.col("_k") == k, F.col("_s") / k).alias(name))
    return attach(df, m, key)


def encoder_mean_table(encoders: DataFrame, key: str, name: str = "te_mean") -> DataFrame:
    """key -> mean over the fold encoders that have it."""
    return encoders.groupBy(key).agg(F.avg("te").alias(name))


def shift_target_encoding(df: DataFrame, target: str = "answered_correctly", fold: str = "fold") -> DataFrame:
    """A4 keyed by the previous and by the next item of the user (the next one
    looks into the future; kept as the reference has it)."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    df = df.withColumns({"content_id_prior": F.lag("content_id").over(w),
                         "content_id_next": F.lead("content_id").over(w)})
    df = target_encoding_oof(df, "content_id_prior", target, fold)
    return target_encoding_oof(df, "content_id_next", target, fold)


# A8 / A9 / A10 / A11 -------------------------------------------------------
def smoothed_te(df: DataFrame, keys, target: str, global_mean, s: float = SMOOTH, suffix: str = "") -> DataFrame:
    """(n * mean + s * global) / (n + s) per key (n counts non-null targets)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    name = f"{key_name(keys)}__{target}_sm{s:g}{suffix}"
    g = F.lit(global_mean) if not isinstance(global_mean, Column) else global_mean
    return df.groupBy(*keys).agg(
        ((F.sum(target) + F.lit(s) * g) / (F.count(target) + F.lit(s))).alias(name))


def count_std(df: DataFrame, keys, target: str, suffix: str = "") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = key_name(keys)
    return df.groupBy(*keys).agg(F.count(target).alias(f"{k}__count{suffix}"),
                                 F.stddev_samp(target).alias(f"{k}__std{suffix}"))


def unique_users(df: DataFrame, keys, exact: bool = True) -> DataFrame:
    """Distinct users per key; ``exact=False`` uses the HyperLogLog sketch."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    f = F.countDistinct("user_id") if exact else F.approx_count_distinct("user_id")
    return df.groupBy(*keys).agg(f.alias(f"{key_name(keys)}__unique_user"))


def entropy(df: DataFrame, keys, target: str) -> DataFrame:
    """Shannon entropy (nats) of ``target``'s distribution within each key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    c = df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    p = c.withColumn("_p", F.col("_c") / F.sum("_c").over(w))
    return p.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log(F.col("_p")))).alias(
        f"{key_name(keys)}__entropy__{target}"))


# A12 -----------------------------------------------------------------------
def tag_target_stats(x: DataFrame, questions: DataFrame, null_tag: str = "999") -> DataFrame:
    """Mean target per tag over answered rows, then per question the max, min,
    count, mean and population std of its tags' means (tag-less -> tag '999').
    Tags with no answered rows have no mean and are skipped by max/min/mean/std."""
    qt = questions.select(F.col("question_id"),
                          F.explode(F.split(F.coalesce(F.col("tags"), F.lit(null_tag)), " ")).alias("tag"))
    per_question = x.groupBy(F.col("content_id").alias("question_id")).agg(
        F.sum("answered_correctly").alias("_s"), F.count("answered_correctly").alias("_n"))    # before tags multiply rows
    tag_mean = per_question.join(qt, "question_id").groupBy("tag").agg(
        F.try_divide(F.sum("_s").cast("double"), F.sum("_n").cast("double")).alias("_m"))
    j = qt.join(tag_mean, "tag", "left")
    return j.groupBy(F.col("question_id").alias("content_id")).agg(
        F.max("_m").alias("tags_max"), F.min("_m").alias("tags_min"), F.count(F.lit(1)).alias("tags_cnt"),
        F.avg("_m").alias("tags_mean"), F.stddev_pop("_m").alias("tags_std"))


# A13 -----------------------------------------------------------------------
def session_flags(x: DataFrame, threshold_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Start = gap > threshold (user's first row forced to 1), end = the next
    row's start taken before that override (last row 0)."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    gap = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0))
    raw = (gap > threshold_ms).cast("int")
    x = x.withColumn("_raw_start", raw)
    return x.withColumns({
        "user_session_end": F.coalesce(F.lead("_raw_start").over(w), F.lit(0)),
        "user_session_start": F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(F.col("_raw_start")),
    }).drop("_raw_start")


def session_border_rate(x: DataFrame, threshold_ms: int = SESSION_GAP_MS, s: float = BORDER_SMOOTH) -> DataFrame:
    f = session_flags(x, threshold_ms)
    m = f.agg(F.struct(F.avg("user_session_start").alias("a"), F.avg("user_session_end").alias("b"))).scalar()
    ma, mb = m["a"], m["b"]
    return f.groupBy("content_id").agg(
        ((F.sum("user_session_start") + F.lit(s) * ma) / (F.count(F.lit(1)) + s))
        .alias("user_session_start__mean_smooth"),
        ((F.sum("user_session_end") + F.lit(s) * mb) / (F.count(F.lit(1)) + s))
        .alias("user_session_end__mean_smooth"))


# A14 -----------------------------------------------------------------------
def content_order_stats(x: DataFrame) -> DataFrame:
    """Position of the item in its user's history: mean/median/max/min/std by item."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    o = x.withColumn("_order", F.row_number().over(w))
    t = o.groupBy("content_id").agg(
        (F.sum("_order") / F.count("_order")).alias("content_order_mean"), F.max("_order").alias("content_order_max"),
        F.min("_order").alias("content_order_min"), F.stddev_samp("_order").alias("content_order_std"))
    return with_median(t, o, "_order", "content_id", "content_order_median")


# A15 / A16 -----------------------------------------------------------------
def choice_weights(x: DataFrame, questions: DataFrame) -> DataFrame:
    """Per (item, answer): choice_rate, weighted_answered_correctly and
    weighted_score = 1 - running sum of the rates ranked correct first, then
    by rate descending (answer id breaks ties)."""
    agg = x.groupBy("content_id", "user_answer").agg(F.count(F.lit(1)).alias("count"))
    cc = x.groupBy("content_id").agg(F.count(F.lit(1)).alias("c_count"))
    q = questions.select(F.col("question_id").alias("content_id"), "correct_answer")
    t = attach(agg.join(cc, "content_id"), q, "content_id")
    t = t.withColumn("choice_rate", F.col("count") / F.col("c_count"))
    t = t.withColumn("answered_correctly", (F.col("user_answer") == F.col("correct_answer")).cast("int"))
    t = t.withColumn("weighted_answered_correctly",
                     (1.0 - F.col("answered_correctly") * F.col("choice_rate")) * F.col("answered_correctly"))
    w = Window.partitionBy("content_id").orderBy(F.col("answered_correctly").desc(), F.col("choice_rate").desc(),
                                                 F.col("user_answer").asc())
    prev = F.coalesce(F.sum("choice_rate").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return t.withColumn("weighted_score", 1.0 - prev)


def with_choice_targets(x: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach weighted_answered_correctly / weighted_score to rows on (item, answer)."""
    w = weights.select("content_id", "user_answer", "weighted_answered_correctly", "weighted_score")
    return attach(x, w, ["content_id", "user_answer"])


def choice_weight_pivot(weights: DataFrame, answers=(0, 1, 2, 3)) -> DataFrame:
    p = weights.groupBy("content_id").pivot("user_answer", list(answers)).agg(F.first("weighted_score"))
    p = p.select("content_id", *[F.col(str(a)).alias(f"ws_{a}") for a in answers])
    return p.na.fill(0.0)


# A17 / A18 / A19 / A20 / A21 / A22 -------------------------------------------
def answer_crosstab(df: DataFrame) -> DataFrame:
    """Counts of each target value (-1 lecture, 0, 1) per item and the share of lecture rows."""
    t = df.groupBy("content_id").pivot("answered_correctly", [-1, 0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    t = t.select("content_id", F.col("-1").alias("n_lecture"), F.col("0").alias("n_wrong"),
                 F.col("1").alias("n_right"))
    return t.withColumn("lecture_share",
                        F.col("n_lecture") / (F.col("n_lecture") + F.col("n_wrong") + F.col("n_right")))


def count_over_union(a: DataFrame, b: DataFrame, key: str = "content_id") -> DataFrame:
    return a.select(key).unionAll(b.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_count_all"))


def global_means(x: DataFrame, cols, suffix: str = "") -> DataFrame:
    return x.agg(*[F.avg(c).alias(f"{c}_mean{suffix}") for c in cols])


def content_mean(x: DataFrame, target: str = "answered_correctly") -> DataFrame:
    return x.groupBy("content_id").agg((F.sum(target) / F.count(target)).alias("content_mean"))


def user_lag_encoders(df: DataFrame) -> DataFrame:
    """Per user the mean and median gap between consecutive rows."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    g = df.withColumn("_gap", F.col("timestamp") - F.lag("timestamp").over(w))
    t = g.groupBy("user_id").agg((F.sum("_gap") / F.count("_gap")).alias("user_lag_mean"))
    return with_median(t, g, "_gap", "user_id", "user_lag_median")


def head_value(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """The user's first row's value mapped to all the user's rows (NULL kept)."""
    head = df.groupBy("user_id").agg(F.min_by(c, F.struct(*ORDER)).alias(name or f"head_{c}"))
    return df.join(head, "user_id", "left")


# A23 / A24 -----------------------------------------------------------------
def repeat_table(x: DataFrame) -> DataFrame:
    """Rows where the user met the item before."""
    w = Window.partitionBy("user_id", "content_id").orderBy(*ORDER)
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > 1).drop("_r")


def elapsed_time_table(x: DataFrame) -> DataFrame:
    """A question's own time = the next row's prior elapsed time; NULL tail dropped."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return (x.withColumn("question_elapsed_time", F.lead("prior_question_elapsed_time").over(w))
            .filter(F.col("question_elapsed_time").isNotNull()))


# A25-A29 -------------------------------------------------------------------
TARGETS = ("answered_correctly", "weighted_answered_correctly", "weighted_score")


def entity_table(x: DataFrame, keys, parts, repeat: DataFrame | None = None, et: DataFrame | None = None,
                 s: float = SMOOTH) -> DataFrame:
    """Wide per-entity table; ``parts`` chooses among count_std, count_std_repeat,
    unique_user, te, te_repeat, te_target, entropy_answer, entropy_target,
    te_elapsed.  All blocks over one source share one ``groupBy`` (one
    aggregation per source: answers, repeats, elapsed times); global means are
    scalar subqueries; the blocks are joined on the entity keys."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = key_name(keys)
    ac = "answered_correctly"
    # one scalar subquery for the three global means (a struct), reused by every block
    gm = x.agg(F.struct(*[F.avg(t).alias(t) for t in TARGETS])).scalar()

    def smoothed(src: DataFrame, targets, suffix: str) -> tuple[list, list]:
        aggs, post = [], []
        for t in targets:
            g = gm[t] if suffix != "_et" else et.agg(F.avg(t)).scalar()
            aggs += [F.sum(t).alias(f"_s_{t}"), F.count(t).alias(f"_n_{t}")]
            name = f"{k}__{t}_sm{s:g}{suffix if suffix != '_et' else ''}"
            post.append(((F.col(f"_s_{t}") + F.lit(s) * g) / (F.col(f"_n_{t}") + F.lit(s))).alias(name))
        return aggs, post

    def block(src: DataFrame, aggs: list, post: list, plain: list) -> DataFrame:
        return src.groupBy(*keys).agg(*aggs).select(*keys, *plain, *post)

    blocks = []
    aggs, post, plain = [], [], []
    if "count_std" in parts:
        aggs += [F.count(ac).alias(f"{k}__count"), F.stddev_samp(ac).alias(f"{k}__std")]
        plain += [f"{k}__count", f"{k}__std"]
    if "unique_user" in parts:
        aggs.append(F.countDistinct("user_id").alias(f"{k}__unique_user"))
        plain.append(f"{k}__unique_user")
    targets = list(TARGETS) if "te" in parts else [ac] if "te_target" in parts else []
    a2, p2 = smoothed(x, targets, "")
    if aggs or a2:
        # the means of the repeat encodings are those of the answer table, as in the reference
        blocks.append(block(x, aggs + a2, p2, plain))
    aggs, plain = [], []
    if "count_std_repeat" in parts:
        aggs += [F.count(ac).alias(f"{k}__count_repeat"), F.stddev_samp(ac).alias(f"{k}__std_repeat")]
        plain += [f"{k}__count_repeat", f"{k}__std_repeat"]
    a2, p2 = [], []
    if "te_repeat" in parts:
        for t in TARGETS:
            g = gm[t]
            a2 += [F.sum(t).alias(f"_s_{t}"), F.count(t).alias(f"_n_{t}")]
            p2.append(((F.col(f"_s_{t}") + F.lit(s) * g) / (F.col(f"_n_{t}") + F.lit(s)))
                      .alias(f"{k}__{t}_sm{s:g}_repeat"))
    if aggs or a2:
        blocks.append(block(repeat, aggs + a2, p2, plain))
    if "entropy_answer" in parts:
        blocks.append(entropy(x, keys, "user_answer"))
    if "entropy_target" in parts:
        blocks.append(entropy(x, keys, ac))
    if "te_elapsed" in parts:
        a3, p3 = smoothed(et, ["question_elapsed_time"], "_et")
        blocks.append(block(et, a3, p3, []))
    out = x.select(*keys).distinct() if not blocks else None
    for b in blocks:
        out = b if out is None else out.join(b, keys, "left")
    return out


def attach_vectors(items: DataFrame, vectors: DataFrame, key: str, width: int, prefix: str, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """An outer vector per item as columns ``prefix_0..``; NULL where the item has none."""
    v = vectors.select(F.col(id_col).alias("_vid"), *[F.get(vec_col, F.lit(j)).cast("double").alias(f"{prefix}_{j}")
                                                     for j in range(width)])
    return items.join(v, F.col(key) == F.col("_vid"), "left").drop("_vid")


def attach_tag_vectors(items: DataFrame, stats: DataFrame, width: int, stat: str = "tag_vec_mean") -> DataFrame:
    """One statistic of ``tag_vector_stats`` (long form) as columns ``stat_0..`` of the items."""
    wide = stats.groupBy("question_id").pivot("dim", list(range(width))).agg(F.first(stat))
    wide = wide.select(F.col("question_id").alias("_qid"), *[F.col(str(j)).alias(f"{stat}_{j}") for j in range(width)])
    return items.join(wide, F.col("content_id") == F.col("_qid"), "left").drop("_qid")


def questions_of(items: DataFrame, questions: DataFrame) -> DataFrame:
    """The questions that are items, the only ones whose vectors a table of the items takes."""
    return questions.join(items.select(F.col("content_id").alias("question_id")), "question_id", "left_semi")


# A30 -----------------------------------------------------------------------
MAX_BROADCAST_VECTORS = 50_000


def tag_vector_stats(questions: DataFrame, vectors: DataFrame, id_col: str = "vec_id",
                     vec_col: str = "embedding") -> DataFrame:
    """Per (question, dimension) mean/median/std/max/min of its tags' vectors (long form: one row per dimension).

    Vectors travel whole: a question meets its distinct tags, each with its count, and their vectors as arrays,
    and the dimensions are taken apart at the end.  Only vectors that some tag names are looked up; the few a
    tag dictionary holds go to every task, so a tag that most questions share gathers in none."""
    qt = questions.select("question_id", F.explode(F.split("tags", " ")).alias("_t")).select(
        "question_id", F.col("_t").cast("long").alias(id_col))
    v = cut_lineage(vectors.select(id_col, F.col(vec_col).alias("_x"))
                    .join(qt.select(id_col).distinct(), id_col, "left_semi"))
    n = qt.groupBy("question_id", id_col).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = n.repartition(parts, "question_id")              # a set number: few bytes here are many rows behind
    per = dim_join(n, v, id_col, "inner", max_rows=MAX_BROADCAST_VECTORS).groupBy("question_id").agg(
        F.collect_list(F.struct("_n", "_x")).alias("_v"))
    size = F.transform("_v", lambda e: F.when(e["_x"].isNull(), 0).otherwise(F.size(e["_x"])))
    per = per.withColumns({"_dims": F.array_max(size), "_often": F.exists("_v", lambda e: e["_n"] > 1)})

    def values(j):                                       # of dimension j, sorted, as often as the tag is named
        once = F.transform("_v", lambda e: F.get(e["_x"], j).cast("double"))
        often = F.flatten(F.transform("_v", lambda e: F.array_repeat(F.get(e["_x"], j).cast("double"), e["_n"])))
        return F.sort_array(F.filter(F.when(F.col("_often"), often).otherwise(once), lambda x: x.isNotNull()))

    def mean(xs):
        return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))

    def stats(e):
        xs, m, k = e["xs"], e["m"], F.size(e["xs"])
        lo, hi = F.get(xs, F.floor((k - 1) / 2).cast("int")), F.get(xs, F.floor(k / 2).cast("int"))
        squares = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
        return F.struct(e["dim"].alias("dim"), m.alias("tag_vec_mean"),
                        F.when(lo == hi, lo).otherwise(lo * 0.5 + hi * 0.5).alias("tag_vec_median"),
                        F.when(k > 1, F.sqrt(squares / (k - 1))).alias("tag_vec_std"),
                        F.get(xs, k - 1).alias("tag_vec_max"), F.get(xs, F.lit(0)).alias("tag_vec_min"))

    dims = F.transform(F.sequence(F.lit(0), F.col("_dims") - 1), lambda j: F.struct(j.alias("dim"), values(j).alias("xs")))
    dims = F.transform(dims, lambda e: F.struct(e["dim"].alias("dim"), e["xs"].alias("xs"), mean(e["xs"]).alias("m")))
    return per.filter("_dims > 0").select("question_id", F.explode(F.transform(dims, stats)).alias("_s")) \
        .select("question_id", "_s.*")


# A31 -----------------------------------------------------------------------
def feature_profile(df: DataFrame, cols) -> DataFrame:
    """nunique, min, max, mean per feature from one aggregate pass (long form)."""
    aggs = []
    for c in cols:
        aggs += [F.countDistinct(c).alias(f"{c}__nunique"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max"), F.avg(c).alias(f"{c}__mean")]
    row = df.agg(*aggs)
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__nunique").alias("nunique"),
                                      F.col(f"{c}__min").alias("min_value"), F.col(f"{c}__max").alias("max_value"),
                                      F.col(f"{c}__mean").alias("mean_value")) for c in cols]))
    return row.select(st.alias("s")).select("s.*")
