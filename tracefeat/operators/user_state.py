"""User-state features (U1-U14): the reference's per-user dictionaries replayed
as window expressions.

Rows of every kind flow through the windows; question rows read the state
left by earlier rows and only question rows are output.  Counters that only
questions update use windows keyed by ``(user_id, content_type_id)``, so
lecture rows sit in their own partition; the time history includes lectures.
Every window is clustered by ``user_id``: one exchange for the whole family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.functions.columns import parse_tags, safe_div
from tracefeat.plans import segmented as SG
from tracefeat.plans.joins import dim_join
from tracefeat.plans.segmented import running

ORDER = ("timestamp", "row_id")
UNB = Window.unboundedPreceding

# Fixed values (state sizes and thresholds of the reference's state object).
ANSREC_MAX_LEN = 100          # answers kept per user
TIMESTAMP_REC_LEN = 10        # timestamps / elapsed times kept per user
SESSION_SHORT_MS = 600_000    # gap that opens a new session
SMOOTH = 5                    # smoothing of the user's corrected rate
SEQ_SMOOTH = 10               # smoothing of the part-sequence encodings
N_PARTS = 7
N_TAGS = 189


def _w(*keys) -> Window:
    part = ["user_id", *keys, "_seg"] if SG.active() else ["user_id", *keys]
    return Window.partitionBy(*part).orderBy(*ORDER)


QK = ("user_id", "content_type_id")


def _wq_prior() -> Window:
    return _w("content_type_id").rowsBetween(UNB, -1)


def is_q() -> Column:
    return F.col("content_type_id") == 0


def prepare(df: DataFrame) -> DataFrame:
    """Add ``et`` (elapsed, -1 when missing), ``hexp`` (0/1) and ``ans``."""
    return df.withColumns({
        "et": F.coalesce(F.col("prior_question_elapsed_time"), F.lit(-1.0)),
        "hexp": F.coalesce(F.col("prior_question_had_explanation"), F.lit(False)).cast("int"),
        "ans": F.col("answered_correctly"),
    })


def questions_only(df: DataFrame) -> DataFrame:
    return df.filter(is_q())


def real_questions() -> Column:
    return is_q() & ~F.col("_halo") if SG.active() else is_q()


# U1 / U2 -------------------------------------------------------------------
def counts(df: DataFrame, train_mean: float, s: float = SMOOTH) -> DataFrame:
    df = running(df, {"u_cnt": F.lit(1), "u_corr_cnt": F.col("ans"), "u_hade_cnt": F.col("hexp"),
                      "u_hade_corr_cnt": F.col("hexp") * F.col("ans")}, QK)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("u_cnt", "u_corr_cnt", "u_hade_cnt",
                                                                       "u_hade_corr_cnt")})
    df = df.withColumns({
        "u_corr_rate": safe_div("u_corr_cnt", "u_cnt"),
        "u_hade_corr_rate": safe_div("u_hade_corr_cnt", "u_hade_cnt"),
        "u_hade_rate": safe_div("u_hade_cnt", "u_cnt"),
        "u_hade_div_corr_cnt": safe_div("u_hade_cnt", "u_corr_cnt"),
    })
    m = train_mean if isinstance(train_mean, Column) else F.lit(float(train_mean))
    return df.withColumn("u_corr_rate_smooth", (F.col("u_cnt") * F.col("u_corr_rate") + F.lit(s) * m)
                         / (F.col("u_cnt") + F.lit(s)))


# U3 ------------------------------------------------------------------------
def latest_k_rate(df: DataFrame, ks=(3, 5, 10, 30), whole: int = ANSREC_MAX_LEN) -> DataFrame:
    """Rate over the last k answers (fewer when the history is short); NULL if none;
    latest1 is the last answer (0 if none); latest100 uses the whole kept record."""
    w = _w("content_type_id")
    cols = {"u_latest1_corr_rate": F.coalesce(F.lag("ans").over(w), F.lit(0))}
    for k in (*ks, whole):
        cols[f"u_latest{k}_corr_rate"] = F.avg("ans").over(w.rowsBetween(-k, -1))
    return df.withColumns(cols)


# U4 / U5 -------------------------------------------------------------------
def item_part_history(df: DataFrame) -> DataFrame:
    df = running(df, {"u_hist_ques_num": F.lit(1)}, (*QK, "content_id"), inclusive=True)
    df = running(df, {"u_hist_part_num": F.lit(1), "u_hist_part_corr_num": F.col("ans")}, (*QK, "part"))
    parts = {}
    for p in range(1, N_PARTS + 1):
        parts[f"u_part_{p}_cnt"] = (F.col("part") == p).cast("int")
        parts[f"_pc{p}"] = (F.col("part") == p).cast("int") * F.col("ans")
    df = running(df, parts, QK)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in [*parts, "u_hist_part_num",
                                                                      "u_hist_part_corr_num"]})
    df = df.withColumn("u_hist_ques_num", F.col("u_hist_ques_num") - 1)
    df = df.withColumns({
        "u_hist_ques_ansed": (F.col("u_hist_ques_num") > 0).cast("int"),
        "u_hist_part_num_corr_rate": safe_div("u_hist_part_corr_num", "u_hist_part_num"),
        **{f"u_part_{p}_corr_rate": F.col(f"_pc{p}") / (F.col(f"u_part_{p}_cnt") + 1.0)
           for p in range(1, N_PARTS + 1)},
    })
    return df.drop(*[f"_pc{p}" for p in range(1, N_PARTS + 1)])


# U6 ------------------------------------------------------------------------
def tag_entries(df: DataFrame) -> DataFrame:
    """One row per (question row, tag occurrence) with the user's row index ``seq``.
    A tag repeated within one row counts twice, as the reference's loop does."""
    q = df.filter(is_q()).select("user_id", "row_id", "seq", "ans",
                                 F.posexplode(parse_tags(F.coalesce(F.col("tags"), F.lit("0")))).alias("pos", "tag"))
    return q.filter(F.col("tag").isNotNull())


def _tag_counts(df: DataFrame) -> DataFrame:
    """One row per (row, tag) with the tag's multiplicity in the row."""
    extra = ["_seg", "_halo"] if SG.active() else []
    e = df.filter(is_q()).select("user_id", "row_id", "timestamp", "ans", *extra,
                                 F.explode(parse_tags(F.coalesce(F.col("tags"), F.lit("0")))).alias("tag"))
    e = e.filter(F.col("tag").isNotNull())
    return e.groupBy("user_id", "row_id", "timestamp", "ans", *extra, "tag").agg(F.count(F.lit(1)).alias("dup"))


def tag_history(df: DataFrame) -> DataFrame:
    """Sums of prior tag counts / correct counts over the row's tags, and
    max/min/mean of the per-tag correct rate (tags never seen are skipped).
    A tag repeated within a row counts with its multiplicity."""
    e = _tag_counts(df)
    e = running(e, {"_n": F.col("dup"), "_c": F.col("dup") * F.col("ans")}, ("user_id", "tag"), prep=_tag_counts)
    e = e.withColumns({"_n": F.coalesce(F.col("_n"), F.lit(0)), "_c": F.coalesce(F.col("_c"), F.lit(0))})
    e = e.withColumn("_r", safe_div("_c", "_n"))
    if SG.active():
        e = e.filter(~F.col("_halo"))
    agg = e.groupBy("user_id", "row_id").agg(
        F.sum(F.col("_n") * F.col("dup")).alias("u_hist_tag_num"),
        F.sum(F.col("_c") * F.col("dup")).alias("u_hist_tag_corr_num"),
        F.max("_r").alias("u_hist_tag_corr_rate_max"), F.min("_r").alias("u_hist_tag_corr_rate_min"),
        F.try_divide(F.sum(F.col("_r") * F.col("dup")),
                     F.sum(F.when(F.col("_r").isNotNull(), F.col("dup"))).cast("double"))
        .alias("u_hist_tag_corr_rate_mn"))
    out = df.join(agg, ["user_id", "row_id"], "left")
    return out.withColumn("u_hist_tag_num_corr_rate", safe_div("u_hist_tag_corr_num", "u_hist_tag_num"))


# U7 ------------------------------------------------------------------------
def _occurrences(e: DataFrame, chunk_rows: int | None) -> DataFrame:
    """``level``: which occurrence of its tag for its user an entry is (1-based), and ``_c``: how many came
    in earlier rows.  With ``chunk_rows`` a user's history is numbered chunk by chunk, plus the
    occurrences of the chunks before, so no task holds more than a chunk of a user."""
    keys = ["user_id", "tag"]
    if chunk_rows:
        e = e.withColumn("_ch", F.floor(F.col("seq") / chunk_rows).cast("long"))
        before = Window.partitionBy(*keys).orderBy("_ch").rowsBetween(UNB, -1)
        offs = (e.groupBy(*keys, "_ch").agg(F.count(F.lit(1)).alias("_n"))
                .select(*keys, "_ch", F.sum("_n").over(before).alias("_off")).filter(F.col("_off") > 0))
        e = e.join(offs, [*keys, "_ch"], "left")
        keys.append("_ch")
    level = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "pos"))
    e = e.withColumn("level", (level + F.coalesce(F.col("_off"), F.lit(0)) if chunk_rows else level).cast("long"))
    return e.withColumn("_c", F.min("level").over(Window.partitionBy(*keys, "seq")) - 1)


def tag_rank(df: DataFrame, n_tags: int = N_TAGS, chunk_rows: int | None = None) -> DataFrame:
    """Rank of each of the row's tags among the user's n_tags prior tag counters
    (ascending, ties by tag id): max, min and sum over the row's tags.

    A counter only rises by one, so the tags with a count of at least c are
    those whose c-th occurrence came before.  Every entry is an event (user,
    level = its occurrence number), and a tag t with prior count c ranks

        n_tags - events of level c + events of level c with a tag below t
               - events of level c + 1 with a tag below t

    (the first two terms are 0 and t for c = 0).  So an entry is read at the two
    levels c and c + 1, in windows keyed (user, level) that list the tags that
    came before.  A tag reaches a level once, so such a window holds at most a
    few rows per tag however long the user's history is; ``chunk_rows`` bounds
    the numbering before it.
    Tags outside 0..n_tags-1 get counters of their own behind those, in the
    order of their ids (their list is part of the tag dictionary, not of the log)."""
    e = tag_entries(df.filter(~F.col("_halo")) if SG.active() else df)
    more = [r["tag"] for r in e.filter(~F.col("tag").between(0, n_tags - 1)).select("tag").distinct().collect()]
    if more:
        listed = F.array(*[F.lit(t) for t in sorted(more)])
        e = e.withColumn("tag", F.when(F.col("tag").between(0, n_tags - 1), F.col("tag"))
                         .otherwise(F.array_position(listed, F.col("tag")) + (n_tags - 1)).cast("int"))
        n_tags += len(more)
    e = _occurrences(e, SG._ACTIVE.get()[0] if SG.active() else chunk_rows)
    t, level, c = F.col("tag"), F.col("level"), F.col("_c")

    def step(lvl, came, sign, base=0):
        return F.struct(lvl.alias("lvl"), (F.lit(came) if isinstance(came, bool) else came).alias("came"),
                        F.lit(sign).alias("sign"), (F.lit(base) if isinstance(base, int) else base).cast("int").alias("base"))

    steps = [step(c + 1, level == c + 1, -1, F.when(c == 0, t).otherwise(n_tags)),
             F.when(c > 0, step(c, False, 1)),
             F.when(level != c + 1, step(level, True, 0))]        # a tag named again in its row
    s = e.select("user_id", "row_id", "pos", "seq", "tag", F.explode(F.array_compact(F.array(*steps))).alias("_s")) \
        .select("user_id", "row_id", "pos", "seq", "tag", "_s.*")
    earlier = Window.partitionBy("user_id", "lvl").orderBy("seq").rangeBetween(UNB, -1)
    s = s.withColumn("_seen", F.collect_list(F.when(F.col("came"), F.col("tag"))).over(earlier)).filter("sign <> 0")
    below = F.size(F.filter("_seen", lambda u: u < F.col("tag")))
    s = s.select("row_id", "pos", F.when(F.col("sign") < 0, F.col("base") - below).otherwise(below - F.size("_seen"))
                 .cast("long").alias("_v"))
    rank = s.repartition("row_id").groupBy("row_id", "pos").agg(F.sum("_v").alias("_r"))
    ranks = rank.groupBy("row_id").agg(F.max("_r").alias("u_hist_tag_rank_max"), F.min("_r").alias("u_hist_tag_rank_min"),
                                       F.sum("_r").alias("u_hist_tag_rank_sum"))
    return df.join(ranks, "row_id", "left")


# U8 / U11 ------------------------------------------------------------------
def lecture_and_elapsed(df: DataFrame) -> DataFrame:
    df = running(df, {"u_hist_lec_cnt": (F.col("content_type_id") == 1).cast("int")})
    df = running(df, {"_et_sum": F.col("et")}, QK)
    df = df.withColumns({"u_hist_lec_cnt": F.coalesce(F.col("u_hist_lec_cnt"), F.lit(0)),
                         "_et_sum": F.coalesce(F.col("_et_sum"), F.lit(0.0))})
    return df.withColumns({
        "u_hist_et_sum_div_cnt": safe_div(F.col("_et_sum"), F.col("u_cnt") + 1),
        "u_hist_et_sum_div_corr_cnt": safe_div(F.col("_et_sum"), F.col("u_corr_cnt") + 1),
    }).drop("_et_sum")


# U9 / U10 ------------------------------------------------------------------
def _last(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - (k - 1), F.lit(1)), k)


def _avg(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def time_history(df: DataFrame, rec_len: int = TIMESTAMP_REC_LEN) -> DataFrame:
    """The kept list of the last ``rec_len`` (timestamp, elapsed) pairs of all rows,
    then the reference's list arithmetic with array functions."""
    lst = F.collect_list(F.struct(F.col("timestamp").alias("t"), F.col("et").alias("e"))).over(
        _w().rowsBetween(-rec_len, -1))
    df = running(df.withColumn("_l", lst), {"_lincorr": F.when(F.col("ans") == 0, F.col("timestamp"))}, QK,
                 fn="max")
    ts = F.transform("_l", lambda s: s["t"])
    ets = F.transform("_l", lambda s: s["e"])
    m = F.size("_l")
    df = df.withColumns({"_ts": ts, "_ets": ets, "_m": m})
    ts, ets, m = F.col("_ts"), F.col("_ets"), F.col("_m")
    diffs = F.concat(F.array(F.lit(0).cast("long")),
                     F.zip_with(F.slice(ts, 2, F.greatest(m - 1, F.lit(0))),
                                F.slice(ts, 1, F.greatest(m - 1, F.lit(0))), lambda a, b: a - b))
    # element j >= 3 (1-based) of the lag list: (ts[j-1] - ts[j-2]) - et[j]
    lags = F.concat(F.array(F.lit(-1.0), F.lit(-1.0)),
                    F.transform(F.sequence(F.lit(3), F.greatest(m, F.lit(3))),
                                lambda j: (F.try_element_at(ts, j - 1) - F.try_element_at(ts, j - 2)).cast("double")
                                - F.try_element_at(ets, j)))
    lags = F.when(m >= 3, lags).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))
    ets_f = F.filter(ets, lambda x: x != -1)
    ets_f = F.when(F.size(ets_f) > 0, ets_f).otherwise(F.array(F.lit(0.0)))
    df = df.withColumns({"_d": diffs, "_g": lags, "_e": ets_f})
    d, g, e = F.col("_d"), F.col("_g"), F.col("_e")
    empty = m == 0
    last_gap = F.try_element_at(d, F.lit(-1))
    prev_lag = F.when((m >= 2) & (last_gap != 0), last_gap - F.col("et")).otherwise(F.lit(-1.0))
    cols = {
        "u_prev_difftime": F.when(empty, F.lit(-1)).otherwise(F.col("timestamp") - F.try_element_at(ts, F.lit(-1))),
        **{f"u_prev_difftime_{k}": F.when(m >= k, F.col("timestamp") - F.try_element_at(ts, F.lit(-k)))
           .otherwise(F.lit(-1))
           for k in (2, 3, 4, 5)},
        "u_prev_lagtime": F.when(empty, F.lit(-1.0)).otherwise(prev_lag),
        "u_latest5_lagtime_max": F.when(empty, F.lit(0.0)).otherwise(F.array_max(_last(g, 5))),
        "u_latest5_lagtime_mn": F.when(~empty, _avg(_last(g, 5))),
        "u_latest5_difftime_max": F.when(empty, F.lit(0)).otherwise(F.array_max(_last(d, 5))),
        "u_latest5_difftime_mn": F.when(~empty, _avg(_last(d, 5))),
        "u_latest5_et_mn": F.when(~empty, _avg(_last(e, 5))),
        "u_latest10_lagtime_max": F.when(empty, F.lit(0.0)).otherwise(F.array_max(g)),
        "u_latest10_lagtime_mn": F.when(~empty, _avg(g)),
        "u_latest10_difftime_max": F.when(empty, F.lit(0)).otherwise(F.array_max(d)),
        "u_latest10_difftime_mn": F.when(~empty, _avg(d)),
        "u_latest10_et_max": F.when(empty, F.lit(0.0)).otherwise(F.array_max(e)),
        "u_latest10_et_mn": F.when(~empty, _avg(e)),
        "u_prev_difftime_incorr": F.when(empty, F.lit(0)).otherwise(F.col("timestamp") - F.coalesce(
            F.col("_lincorr"), F.lit(0))),
    }
    for k in (5, 7, 10):
        med = F.percentile(F.col("timestamp"), 0.5).over(_w().rowsBetween(-k, -1))
        cols[f"_med{k}"] = F.when(m >= k, med)
    df = df.withColumns(cols)
    df = df.withColumns({
        "u_prev_et_diff_time": F.when(~empty, safe_div("et", "u_prev_difftime")),
        "u_prev_et_lag_time": F.when(~empty, safe_div("et", "u_prev_lagtime")),
        "u_prev_diff_lag_time": safe_div("u_prev_difftime", "u_prev_lagtime"),
        "u_prev_lag_diff_time": safe_div("u_prev_lagtime", "u_prev_difftime"),
        **{f"timestamp_lag_div_rolling{k}_median_each_user": safe_div(F.col("timestamp"), F.col(f"_med{k}"))
           for k in (5, 7, 10)},
        **{f"timestamp_lag_diff_rolling{k}_median_each_user": F.col("timestamp") - F.col(f"_med{k}")
           for k in (5, 7, 10)},
    })
    return df.drop("_l", "_ts", "_ets", "_m", "_d", "_g", "_e", "_med5", "_med7", "_med10", "_lincorr")


# U12 -----------------------------------------------------------------------
def session_features(df: DataFrame, threshold_ms: int = SESSION_SHORT_MS) -> DataFrame:
    """A question row whose gap to the previous row (any kind) exceeds the threshold
    opens a session.  Sessions counted before the row, the session's start time
    (0 before the first break), prior rows and correct rate in the session,
    time in session and rows per second."""
    def brk(d: DataFrame) -> DataFrame:
        gap = F.col("timestamp") - F.lag("timestamp").over(_w())
        return d.withColumn("_brk", F.coalesce((gap > threshold_ms), F.lit(False)).cast("int"))

    def sessions(d: DataFrame) -> DataFrame:
        return running(brk(d), {"_sid": F.col("_brk")}, QK, inclusive=True, prep=brk)

    df = sessions(df)
    df = running(df, {"u_session_short_cnt": F.col("_brk")}, QK, prep=brk)
    df = running(df, {"_sts": F.when(F.col("_brk") == 1, F.col("timestamp"))}, QK, inclusive=True, fn="max",
                 prep=brk)
    df = running(df, {"u_cnt_in_session_short": F.lit(1)}, (*QK, "_sid"), inclusive=True, prep=sessions)
    df = running(df, {"_sc": F.col("ans")}, (*QK, "_sid"), prep=sessions)
    df = df.withColumns({
        "u_session_short_cnt": F.coalesce(F.col("u_session_short_cnt"), F.lit(0)),
        "u_cnt_in_session_short": F.col("u_cnt_in_session_short") - 1,
        "_sc": F.coalesce(F.col("_sc"), F.lit(0)),
        "u_ts_in_session_short": F.col("timestamp") - F.coalesce(F.col("_sts"), F.lit(0)),
    })
    return df.withColumns({
        "u_corr_rate_in_session_short": safe_div("_sc", "u_cnt_in_session_short"),
        "u_cnt_in_session_short_density": F.when(
            F.col("u_ts_in_session_short") > 0,
            F.col("u_cnt_in_session_short") / F.col("u_ts_in_session_short") * 1000).otherwise(F.lit(0.0)),
    }).drop("_brk", "_sid", "_sts", "_sc")


# U13 -----------------------------------------------------------------------
def part_sequence_te(df: DataFrame, train_mean: float, s: float = SEQ_SMOOTH) -> DataFrame:
    """Smoothed target mean of (last 1..3 parts of the user's previous questions,
    this part); falls back to the part's own encoding when the key is missing."""
    wq = _w("content_type_id")
    df = df.withColumns({f"prev_part_s{k}": F.lag("part", k).over(wq) for k in (1, 2, 3)})
    q = df.filter(real_questions())
    m = train_mean if isinstance(train_mean, Column) else F.lit(float(train_mean))
    part_te = q.groupBy("part").agg(F.sum("ans").alias("_s"), F.count("ans").alias("_n")).select(
        "part", ((F.col("_s") + F.lit(s) * m) / (F.col("_n") + F.lit(s))).alias("_part_te"))
    df = dim_join(df, part_te, ["part"], "left")
    keys = {1: ["prev_part_s1", "part"], 2: ["prev_part_s2", "prev_part_s1", "part"],
            3: ["prev_part_s3", "prev_part_s2", "prev_part_s1", "part"]}
    for k, ks in keys.items():
        name = "xxx".join(ks) + f"__answered_correctly_sm{s:g}"
        te = (q.filter(F.col(ks[0]).isNotNull()).groupBy(*ks).agg(F.sum("ans").alias("_s"), F.count("ans")
                                                                    .alias("_n"))
              .select(*ks, ((F.col("_s") + F.lit(s) * m) / (F.col("_n") + F.lit(s))).alias("_te")))
        df = dim_join(df, te, ks, "left").withColumn(name, F.coalesce(F.col("_te"), F.col("_part_te"))).drop("_te")
    return df.drop("_part_te")


# U14 -----------------------------------------------------------------------
def user_state(history: DataFrame) -> DataFrame:
    """The aggregatable part of the state after ``history``: counters per user."""
    h = prepare(history)
    return h.groupBy("user_id").agg(
        F.count(F.when(is_q(), 1)).alias("u_cnt"),
        F.coalesce(F.sum(F.when(is_q(), F.col("ans"))), F.lit(0)).alias("u_corr_cnt"),
        F.coalesce(F.sum(F.when(is_q(), F.col("hexp"))), F.lit(0)).alias("u_hade_cnt"),
        F.coalesce(F.sum(F.when(is_q(), F.col("hexp") * F.col("ans"))), F.lit(0)).alias("u_hade_corr_cnt"),
        F.sum((F.col("content_type_id") == 1).cast("int")).alias("u_hist_lec_cnt"))


def score_without_update(history: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Features of new rows read from the state after ``history`` only: rows of the
    same batch do not see each other (their answers are not known yet)."""
    st = user_state(history)
    out = new_rows.join(st, "user_id", "left").na.fill(0, ["u_cnt", "u_corr_cnt", "u_hade_cnt", "u_hade_corr_cnt",
                                                          "u_hist_lec_cnt"])
    return out.withColumn("u_corr_rate", safe_div("u_corr_cnt", "u_cnt"))


def update_without_score(history: DataFrame, new_rows: DataFrame) -> DataFrame:
    """State after folding the new rows' answers in (no features)."""
    return user_state(history.unionByName(new_rows, allowMissingColumns=True))


def with_seq(df: DataFrame) -> DataFrame:
    if SG.active():
        return df.withColumn("seq", F.col("_pos"))
    return df.withColumn("seq", F.row_number().over(_w()))
