"""Invariants: causality (leak test), fold partitions, distributed ranking and
AUC against brute force, chunked scans, stream = batch, restart safety."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, make_log
from tracefeat.operators import evaluate as E
from tracefeat.operators import splits as V
from tracefeat.operators import user_state as U
from tracefeat.operators import windows as W
from tracefeat.plans.features import features
from tracefeat.plans.ranking import global_cumsum, global_rank
from tracefeat.sources import io
from tracefeat.sources.binding import interaction_log, question_log


def _cut(log, frac=0.6):
    """Drop, per user, every row after the user's first ``frac`` of rows."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("timestamp", "row_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return (log.withColumns({"_r": F.row_number().over(w), "_n": n}).filter(F.col("_r") <= F.col("_n") * frac)
            .drop("_r", "_n"))


CAUSAL = ["W1", "W2", "W3", "W4", "W4b", "W4c", "W5", "W5c", "W6", "W7", "W7b", "W9", "W11", "W13", "W14", "W15",
          "W16", "W17", "W18", "W19", "W21", "W22", "W23", "W24"]


def test_causal_operators_do_not_leak(spark):
    log = question_log(spark, SF_SMALL)
    full = features(log, CAUSAL)
    cut = features(_cut(log), CAUSAL)
    cols = [c for c in cut.columns if c not in log.columns]
    a = full.join(cut.select("row_id"), "row_id").select("row_id", *cols).orderBy("row_id")
    b = cut.select("row_id", *cols).orderBy("row_id")
    assert a.collect() == b.collect()


def test_whole_history_operator_leaks_by_design(spark):
    log = question_log(spark, SF_SMALL)
    full = W.gap_vs_user(log).select("row_id", "timestamp_lag_mean")
    cut = W.gap_vs_user(_cut(log)).select("row_id", "timestamp_lag_mean")
    diff = full.join(cut, "row_id").filter(full["timestamp_lag_mean"] != cut["timestamp_lag_mean"]).count()
    assert diff > 0


def test_user_state_is_causal(spark):
    log = question_log(spark, SF_SMALL)

    def u(df):
        df = U.with_seq(U.prepare(df))
        return U.questions_only(U.time_history(U.counts(df, 0.6))).select(
            "row_id", "u_cnt", "u_corr_cnt", "u_prev_difftime", "u_latest10_lagtime_mn")
    a, b = u(log), u(_cut(log))
    assert a.join(b.select("row_id"), "row_id").orderBy("row_id").collect() == b.orderBy("row_id").collect()


def test_folds_partition_rows_and_groups_stay_whole(spark):
    log = interaction_log(spark, SF_SMALL)
    n = log.count()
    for df in (V.kfold(log, 5), V.stratified_kfold(log, "answered_correctly", 5),
               V.group_kfold(log, "user_id", 5), V.stratified_group_kfold(log, "user_id", "answered_correctly", 5)):
        assert df.count() == n
        assert df.filter(F.col("fold").isNull() | (F.col("fold") < 0) | (F.col("fold") > 4)).count() == 0
    g = V.group_kfold(log, "user_id", 5)
    assert g.groupBy("user_id").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    sizes = [r["count"] for r in g.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= max(sizes) * 0.5


def test_virtual_time_cuts_are_disjoint_and_sized(spark):
    log = interaction_log(spark, SF_SMALL)
    v = V.virtual_time_split(log, val_size=100, n_cuts=3)
    counts = {r.cv: r["count"] for r in v.groupBy("cv").count().collect()}
    assert counts[1] == counts[2] == counts[3] == 100
    assert sum(counts.values()) == log.count()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_global_rank_and_cumsum_match_pandas(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 1, 2]), rnd.randint(0, 30), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, g int, k int, v double")
    r = global_rank(df, ["k", "row_id"], ["g"], name="rk", n_parts=4).toPandas()
    p = pd.DataFrame(rows, columns=["row_id", "g", "k", "v"]).sort_values(["g", "k", "row_id"])
    p["rk"] = p.groupby("g").cumcount() + 1
    m = r.merge(p, on="row_id", suffixes=("", "_p"))
    assert (m.rk == m.rk_p).all()
    d = df.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    c = global_cumsum(d, "k", ["n"], ["g"], n_parts=4).toPandas().sort_values(["g", "k"])
    c["want"] = c.groupby("g").n.cumsum() - c.n
    assert (c.want == c.cum_n).all()


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_auc_matches_pairwise_count(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20))) for _ in range(150)]
    got = E.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()[0].auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_tag_rank_chunked_equals_unchunked(spark):
    df = U.with_seq(U.prepare(question_log(spark, SF_SMALL)))
    a = U.questions_only(U.tag_rank(df)).select("row_id", "u_hist_tag_rank_max", "u_hist_tag_rank_min",
                                                "u_hist_tag_rank_sum")
    b = U.questions_only(U.tag_rank(df, chunk_rows=3)).select("row_id", "u_hist_tag_rank_max",
                                                                "u_hist_tag_rank_min", "u_hist_tag_rank_sum")
    assert a.orderBy("row_id").collect() == b.orderBy("row_id").collect()


def test_stream_equals_batch_for_any_batch_packing(spark):
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    from tracefeat.streaming.user_state import online_user_features
    log = interaction_log(spark, SF_SMALL)
    root = io.fresh_path(spark, "t-stream")
    src = os.path.join(root, "events")
    EV.write_microbatches(EV.event_frame(log, 100), src)
    results = []
    for i, per_trigger in enumerate((1, 5)):
        out = os.path.join(root, f"out{i}")
        K.run_to_parquet(online_user_features(EV.read_events(spark, src, per_trigger)), out,
                         os.path.join(root, f"ck{i}"))
        results.append(spark.read.parquet(out).select("row_id", "u_cnt", "u_corr_cnt", "u_hist_lec_cnt",
                                                      "seq_content_id").orderBy("row_id").collect())
    assert results[0] == results[1]
    assert len(results[0]) == log.filter("content_type_id = 0").count()


def test_stream_restart_from_checkpoint_does_not_double_count(spark):
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    from tracefeat.streaming.user_state import online_user_features
    log = interaction_log(spark, SF_SMALL)
    root = io.fresh_path(spark, "t-restart")
    src, out, ck = (os.path.join(root, x) for x in ("events", "out", "ck"))
    ev = EV.event_frame(log, 100)
    first = ev.filter("group_num < 5")
    EV.write_microbatches(first, src)
    K.run_to_parquet(online_user_features(EV.read_events(spark, src, 2)), out, ck)
    # later groups arrive; the same checkpoint resumes where the first run stopped
    n = ev.agg(F.max("group_num")).first()[0]
    for g in range(5, n + 1):
        ev.filter(F.col("group_num") == g).coalesce(1).write.parquet(os.path.join(src, f"group={g:06d}"))
    K.run_to_parquet(online_user_features(EV.read_events(spark, src, 2)), out, ck)
    got = spark.read.parquet(out)
    assert got.count() == got.select("row_id").distinct().count()
    full_root = io.fresh_path(spark, "t-full")
    EV.write_microbatches(ev, os.path.join(full_root, "events"))
    K.run_to_parquet(online_user_features(EV.read_events(spark, os.path.join(full_root, "events"), 50)),
                     os.path.join(full_root, "out"), os.path.join(full_root, "ck"))
    want = spark.read.parquet(os.path.join(full_root, "out"))
    cols = ["row_id", "u_cnt", "u_corr_cnt", "u_hist_lec_cnt"]
    assert got.select(cols).orderBy("row_id").collect() == want.select(cols).orderBy("row_id").collect()


def test_one_exchange_for_composed_window_features(spark):
    log = interaction_log(spark, SF_SMALL)
    df = features(log.withColumn("part", F.lit(1)), ["W1", "W2", "W4", "W5", "W12", "W15", "W24"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one shuffle of the events on user_id; the rest are local sorts
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_checkpoint_dir_is_taken_from_session(spark):
    from tracefeat.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_skew_safe_flagship_splits_a_hot_user(spark):
    """One user holds most rows: the segmented plan gives the per-user result while
    no (user, segment) group exceeds seg_rows + halo rows."""
    from tracefeat.plans import segmented as SG
    rnd = random.Random(7)
    rows = [dict(row_id=i, user_id=1 if i % 10 else 2 + i % 7, timestamp=i * 1000 + rnd.randint(0, 999),
                 answered_correctly=rnd.randint(0, 1)) for i in range(3000)]
    log = make_log(spark, rows)
    cols = ["row_id", "prior_correct_sum", "prior_count", "prior_correct_rate", "answered_correctly_rolling7",
            "timestamp_diff5"]
    want = W.time_diffs(W.rolling_prior_mean(W.user_running(log)), (1, 2, 3, 4, 5)).select(cols)
    got = SG.flagship(log, seg_rows=200, halo=8).select(cols)
    assert got.orderBy("row_id").collect() == want.orderBy("row_id").collect()
    seg = SG.segment(log, seg_rows=200, halo=8)
    biggest = seg.groupBy("user_id", "_seg").count().agg(F.max("count")).first()[0]
    assert biggest <= 208


SEGMENTED_W = [n for n in __import__("tracefeat.plans.features", fromlist=["x"]).WINDOW_OPERATORS if n != "W17"]


def test_segmented_window_family_equals_per_user(spark):
    """Every window operator (but the 100-row W17) in segmented form with users
    cut into 2-3 segments gives exactly the per-user result."""
    log = question_log(spark, "/root/testdata/sf0.01")
    plain = features(log, SEGMENTED_W)
    seg = features(log, SEGMENTED_W, skew_safe=True, seg_rows=40, halo=32)
    cols = sorted(c for c in plain.columns if c != "prior_group_answers_correct")
    a = plain.select(cols).orderBy("row_id").collect()
    b = seg.select(cols).orderBy("row_id").collect()
    assert len(a) == len(b) == log.count()
    assert a == b


def test_segmented_user_state_equals_per_user(spark):
    from tracefeat.plans import segmented as SG
    log = question_log(spark, "/root/testdata/sf0.01")

    def build(df, mean):
        df = U.with_seq(df)
        df = U.counts(df, mean)
        df = U.latest_k_rate(df, (3, 5, 10), whole=12)
        df = U.item_part_history(df)
        df = U.lecture_and_elapsed(df)
        df = U.time_history(df)
        df = U.session_features(df, 43_200_000)
        df = U.tag_history(df)
        return U.part_sequence_te(df, mean)

    mean = 0.6
    log = U.prepare(log)        # segmenting starts from the prepared log
    plain = U.questions_only(build(log, mean))
    with SG.segmented_plan():
        seg = SG.finish(U.questions_only(build(SG.segment(log, seg_rows=40, halo=20), mean)))
    cols = sorted(c for c in plain.columns if c.startswith(("u_", "prev_part", "timestamp_lag")))
    cols = ["row_id"] + cols
    assert plain.select(cols).orderBy("row_id").collect() == seg.select(cols).orderBy("row_id").collect()


def test_segmented_sequences_equal_per_user(spark):
    from tracefeat.operators import sequences as Q
    from tracefeat.plans import segmented as SG
    from tracefeat.sources.binding import questions, with_questions
    log = V.tail_split(interaction_log(spark, "/root/testdata/sf0.01"))
    x = with_questions(log, questions(spark, "/root/testdata/sf0.01")).filter("content_type_id = 0")

    def build(df):
        s = Q.last_n_sequence(df, ["content_id", "part"], ["answered_correctly"], 21, "timestamp", None)
        return s.select("row_id", "is_val", "seq_content_id", "seq_part", "seq_answered_correctly",
                        "seq_timestamp_diff", "seq_n_pad")

    def chunks(df):
        return Q.step_chunks(df, ["content_id", "answered_correctly"], 20)

    plain, pc = build(x), chunks(x)
    with SG.segmented_plan():
        b = SG.segment(x, seg_rows=30, halo=24, kind_col=None)
        seg = SG.finish(build(b))
        sc = chunks(b)
    assert plain.orderBy("row_id").collect() == seg.orderBy("row_id").collect()
    assert pc.orderBy("user_id", "chunk_id").collect() == sc.orderBy("user_id", "chunk_id").collect()


def test_segmented_long_frames_with_default_halo(spark):
    """W17 (99 earlier gaps) and W19 (30 rows) need a long halo: with a 110-row
    halo and 150-row segments a 600-row user is cut into 4 segments."""
    rnd = random.Random(3)
    rows = [dict(row_id=i, user_id=1 if i % 6 else 2, timestamp=i * 1000 + rnd.randint(0, 999),
                 part=rnd.randint(1, 7), answered_correctly=rnd.randint(0, 1)) for i in range(720)]
    log = make_log(spark, rows)
    names = ["W17", "W19", "W15", "W1"]
    plain = features(log, names)
    seg = features(log, names, skew_safe=True, seg_rows=150, halo=110)
    cols = sorted(c for c in plain.columns)
    assert plain.select(cols).orderBy("row_id").collect() == seg.select(cols).orderBy("row_id").collect()


def test_segmented_sparse_question_rows(spark):
    """Questions far apart (three, then 36 lectures, then one more): the halo reaches
    back per content type over any number of segments."""
    from tracefeat.operators import windows as WN
    from tracefeat.plans import segmented as SG
    kinds = [0] * 3 + [1] * 36 + [0] + [1] * 20 + [0] * 2
    rows = [dict(row_id=i, user_id=1, timestamp=i * 1000, content_type_id=k, content_id=i, part=None if k else 2 + i % 4,
                 answered_correctly=-1 if k else i % 2) for i, k in enumerate(kinds)]
    rows += [dict(row_id=1000 + i, user_id=2, timestamp=i, part=3) for i in range(5)]
    log = U.prepare(make_log(spark, rows))

    def build(df):
        df = U.latest_k_rate(U.with_seq(df), (3, 5))
        return U.questions_only(U.part_sequence_te(df, 0.5))

    cols = ["row_id"] + sorted(c for c in build(log).columns if c.startswith(("u_latest", "prev_part", "timestamp_lag")))
    want = build(log).select(cols).orderBy("row_id").collect()
    hist = sorted(c for c in WN.history_window(log).columns if c.startswith("hist"))
    want_h = WN.history_window(log).select("row_id", *hist).orderBy("row_id").collect()
    with SG.segmented_plan():
        got = SG.finish(build(SG.segment(log, seg_rows=8, halo=8))).select(cols).orderBy("row_id").collect()
    with SG.segmented_plan():
        got_h = SG.finish(WN.history_window(SG.segment(log, seg_rows=8, halo=8))).select("row_id", *hist)
        got_h = got_h.orderBy("row_id").collect()
    assert got == want and got_h == want_h
    seg = SG.segment(log, seg_rows=8, halo=8)
    assert seg.groupBy("user_id", "_seg").count().agg(F.max("count")).first()[0] <= 8 + 8 + 2 * 8


def test_ranking_spreads_ties_and_string_keys(spark):
    from tracefeat.plans.ranking import sorted_ranges
    n = 20_000
    tied = spark.range(n).withColumn("k", F.lit(0.5)).withColumn("s", F.concat(F.lit("key"), F.col("id") % 97))
    for keys in (["k", "id"], ["s", "id"]):
        most = sorted_ranges(tied, keys, n_parts=8).groupBy("_bk").count().agg(F.max("count")).first()[0]
        assert most < n / 8 * 2
        ranked = global_rank(tied, keys, n_parts=8).orderBy("rank").select("rank", *keys).collect()
        assert [r["rank"] for r in ranked] == list(range(1, n + 1))
        assert [tuple(r)[1:] for r in ranked] == sorted(tuple(r)[1:] for r in ranked)
    per = global_rank(tied.withColumn("g", (F.col("id") < 15_000).cast("int")), ["k", "id"], ["g"], n_parts=8,
                      total_name="total")
    assert per.groupBy("g").agg(F.max("rank"), F.min("rank"), F.max("total")).orderBy("g").collect() == [
        (0, 5000, 1, 5000), (1, 15_000, 1, 15_000)]


def test_feature_store_keeps_features_of_earlier_saves(spark):
    store = io.FeatureStore(spark, io.fresh_path(spark, "t-store"))
    store.save(spark.createDataFrame([(1, 10, 20)], "row_id long, f1 int, f2 int"), "g")
    store.save(spark.createDataFrame([(1, 21)], "row_id long, f2 int"), "g")
    assert store.assemble(["f1", "f2"]).collect() == [(1, 10, 21)]
    assert sorted(tuple(r) for r in store.registry().collect()) == [("f1", "g"), ("f2", "g")]
    assert store.group("g").collect() == [(1, 10, 21)]


def test_tags_beyond_the_fixed_width_count(spark):
    rows = [dict(row_id=i, user_id=1, timestamp=i, tags="200" if i % 2 else "200 7", answered_correctly=1) for i in range(4)]
    df = U.with_seq(U.prepare(make_log(spark, rows)))
    got = U.questions_only(U.tag_history(df)).orderBy("row_id").select("u_hist_tag_num", "u_hist_tag_corr_num").collect()
    assert got == [(0, 0), (1, 1), (3, 3), (3, 3)]
    rank = U.questions_only(U.tag_rank(df)).orderBy("row_id").select("u_hist_tag_rank_max").collect()
    assert [r[0] for r in rank] == [189, 189, 189, 189]


def test_late_labels_without_a_row_are_handed_out(spark):
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    from tracefeat.streaming.user_state import online_user_features
    log = interaction_log(spark, SF_SMALL)
    ev = EV.event_frame(log, 100)
    lost = ev.filter("kind = 'label'").orderBy("row_id").limit(1).withColumn("row_id", F.lit(10**9).cast("long")) \
        .withColumn("group_num", F.lit(0).cast("long"))
    user = lost.first()["user_id"]
    tail = ev.filter((F.col("user_id") == user))
    far = tail.filter("kind = 'row'").limit(1).withColumn("group_num", F.lit(99).cast("long"))
    root = io.fresh_path(spark, "t-late")
    EV.write_microbatches(tail.unionByName(lost).unionByName(far), os.path.join(root, "events"))
    K.run_to_parquet(online_user_features(EV.read_events(spark, os.path.join(root, "events"), 1)),
                     os.path.join(root, "out"), os.path.join(root, "ck"))
    out = spark.read.parquet(os.path.join(root, "out"))
    assert [r["row_id"] for r in out.filter("kind = 'expired_label'").collect()] == [10**9]
    assert out.filter("kind = 'feature'").count() > 0


def test_line_item_ids_hold_large_orders(spark, tmp_path):
    from tracefeat.sources.binding import lineitem_log, read_table
    li = read_table(spark, SF_SMALL, "lineitem").limit(50)
    big = li.withColumn("l_orderkey", F.lit(3_000_000_000).cast("long"))
    big.unionByName(big).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = lineitem_log(spark, str(tmp_path))
    assert out.count() == 100 == out.select("row_id").distinct().count()
    assert out.select("task_container_id").distinct().collect() == [(3_000_000_000,)]


def test_topics_keep_every_token(spark):
    from tracefeat.operators import ml
    df = spark.createDataFrame([(i % 6, f"t{i}") for i in range(60)], "doc int, tok string")
    out = ml.topic_vectors(df, "doc", "tok", n_topics=3, unique=False, max_iter=3).collect()
    assert len(out) == 6 and all(abs(sum(r[1:]) - 1) < 1e-6 for r in out)


# Models and sampling: what the queries without SQL must hold ----------------------
def test_sample_down_keeps_validation_and_a_share(spark):
    from tracefeat.operators import prep as P
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("is_val"))
    out = P.sample_down(df, 0.25)
    kept = {r["is_val"]: r["count"] for r in out.groupBy("is_val").count().collect()}
    assert kept[1] == 2_000 and abs(kept[0] / 18_000 - 0.25) < 0.02
    assert out.select("row_id").distinct().count() == out.count()
    assert sorted(out.collect()) == sorted(P.sample_down(df, 0.25).collect())


def test_svd_singular_values_fall_and_rebuild(spark):
    import numpy as np

    from tracefeat.operators import ml
    pairs = [(i, u) for i in range(6) for u in range(20) if (i * 7 + u * 3) % 5 < 2]
    df = spark.createDataFrame(pairs, "content_id long, user_id long")
    emb, s = ml.svd_embedding(df, "content_id", "user_id", 5)
    assert all(a >= b > 0 for a, b in zip(s, s[1:]))
    m = np.zeros((6, 20))
    for i, u in pairs:
        m[i, u] = 1
    rows = np.array([r[1:] for r in emb.orderBy("content_id").collect()])
    want = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(s, want[1][:len(s)], atol=1e-6)
    # products of embeddings do not depend on the signs of the vectors
    low = want[0][:, :len(s)] * want[1][:len(s)]
    assert np.allclose(rows @ rows.T, low @ low.T, atol=1e-6)


def test_word2vec_and_clusters_repeat(spark):
    from tracefeat.operators import ml
    qs = spark.createDataFrame([(i, f"{i % 4} {i % 3 + 10}") for i in range(24)], "question_id int, tags string").coalesce(1)
    once, again = (sorted(ml.tag_word2vec(qs, size=4, max_iter=1).collect()) for _ in range(2))
    assert once == again and {r["tag"] for r in once} == {"0", "1", "2", "3", "10", "11", "12"}
    pts = spark.createDataFrame([(i, float(i % 2) * 50 + i * 0.01, None if i == 7 else 1.0) for i in range(20)],
                                "content_id int, x double, y double")
    a, b = (sorted(ml.item_clusters(pts, "content_id", ["x", "y"], k=3).collect()) for _ in range(2))
    assert a == b and len(a) == 20
    by = dict(a)
    assert by[7] not in {by[i] for i in range(20) if i != 7}                  # the filled null lies far away
    proj = ml.item_projection_2d(pts.na.fill(1.0), "content_id", ["x", "y"]).toPandas()
    assert len(proj) == 20 and proj["content_id_proj_0"].var() > proj["content_id_proj_1"].var()


def _labelled(spark, n=400):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"),
                               ((F.col("id") * 37) % 101 / 101.0).alias("x"), ((F.col("id") * 53) % 97 / 97.0).alias("z"))
    return df.withColumn("y", (F.col("x") > 0.5).cast("double"))


def test_gbt_folds_score_every_row_once(spark):
    from tracefeat.operators import ml
    df = _labelled(spark)
    oof, imp = ml.gbt_cv(df, ["x", "z"], "y", "fold", 3, max_iter=3, max_depth=2)
    got = oof.join(df.select("row_id", "y"), "row_id")
    assert oof.count() == 400 == oof.select("row_id").distinct().count()
    assert got.join(df.select("row_id", F.col("fold").alias("own")), "row_id").filter("own <> fold").count() == 0
    assert E.auc(got, "y", "pred").first()["auc"] > 0.9
    table = E.importance_table(imp).collect()
    assert table[0]["feature"] == "x" and abs(sum(r["importance_mean"] for r in table) - 1) < 1e-6


def test_saved_fold_models_score_alike(spark, tmp_path):
    from tracefeat.operators import ml
    df = _labelled(spark, 200)
    models = ml.fit_fold_models(df, ["x", "z"], "y", "fold", 3)
    ml.save_models(models, str(tmp_path / "models"))
    again = ml.load_models(spark, str(tmp_path / "models"))
    one = sorted(ml.score_with_models(df, models, ["x", "z"], [0.5, 0.3, 0.2]).collect())
    assert one == sorted(ml.score_with_models(df, again, ["x", "z"], [0.5, 0.3, 0.2]).collect())
    assert len(one) == 200 and all(0 <= r["pred"] <= 1 for r in one)


# Stored encoders and lookups ------------------------------------------------------
def test_encoders_add_store_and_reload(spark, tmp_path):
    from tracefeat.operators import encoders as A
    from tracefeat.operators.fitted import CountEncoder, SmoothedEncoder, TargetEncoder, load_encoder
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 0, 1.0), (None, 1, 1.0), (3, 1, None)],
                                 "k int, fold int, y double")
    new = spark.createDataFrame([(2, 1, 0.0), (4, 0, 1.0)], "k int, fold int, y double")
    both = rows.unionByName(new)

    c = load_encoder(spark, CountEncoder("k").fit(rows).save(str(tmp_path / "c"))).add(new)
    assert {r["k"]: r["k_count"] for r in c.transform(both).collect()} == {1: 2, 2: 3, 3: 1, 4: 1, None: None}
    assert {r["k"] for r in c.levels().collect()} == {1, 2, 3, 4}

    t = load_encoder(spark, TargetEncoder("k", "y", 2).fit(rows).save(str(tmp_path / "t"))).add(new)
    got = sorted(t.transform_folds(both, "te").collect(), key=str)
    assert got == sorted(A.target_encoding_oof(both, "k", "y", name="te").select(*got[0].__fields__).collect(), key=str)
    assert {r["k"]: r["te"] for r in t.transform(spark.createDataFrame([(1,), (2,), (9,)], "k int"), "te").collect()} \
        == {1: 0.5, 2: 0.5, 9: None}

    s = load_encoder(spark, SmoothedEncoder("k", "y", 2).fit(rows).save(str(tmp_path / "s"))).add(new)
    mean = 4 / 6                                     # rows with a key and a target
    got = {r["k"]: r["k__y_sm2"] for r in s.transform(both).collect()}
    assert got[1] == pytest.approx((1 + 2 * mean) / 4) and got[3] == pytest.approx(mean) and got[None] == pytest.approx(mean)


def test_lookup_by_name(spark):
    from tracefeat.operators import lookup as L
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 12).alias("user_id"),
                                (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("v"))
    for name, params in (("KFold", {}), ("StratifiedKFold", {"label_cols": "y"}), ("GroupKFold", {"group": "user_id"}),
                         ("MultilabelStratifiedKFold", {"label_cols": ["y", "v"]}),
                         ("StratifiedGroupKFold", {"group": "user_id", "label": "y"})):
        out = L.assign_folds(df, name, k=3, **params)
        assert out.count() == 60 and {r["fold"] for r in out.collect()} == {0, 1, 2}, name
    with pytest.raises(KeyError):
        L.assign_folds(df, "NoSuchFold")


def test_ranks_and_medians_keep_null_groups(spark):
    from tracefeat.operators import encoders as A
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 7.0), (3, "a", 1.0), (4, "a", None)],
                               "row_id long, g string, v double")
    ranks = {r["row_id"]: r["rank"] for r in global_rank(df, ["row_id"], ["g"]).collect()}
    assert ranks == {1: 1, 2: 2, 3: 1, 4: 2}
    stats = {r["g"]: r["v_median"] for r in A.group_stats(df, "g", "v").collect()}
    assert stats == {None: 6.0, "a": 1.0}


def _streamed(spark, df, root, name):
    from tracefeat.streaming import aggregates as K
    progress = K.run_to_parquet(df, os.path.join(root, name), os.path.join(root, f"ck_{name}"))
    return spark.read.parquet(os.path.join(root, name)), progress


def _loop_events(spark, rows, events_root):
    """rows: dicts with kind, group_num, row_id, user_id and what else is set; one file a group."""
    from tracefeat.streaming import events as EV
    names = [f.name for f in EV.EVENT_SCHEMA.fields]
    for g in sorted({r["group_num"] for r in rows}):
        part = [tuple(r.get(n) for n in names) for r in rows if r["group_num"] == g]
        df = spark.createDataFrame(part, EV.EVENT_SCHEMA).withColumns({
            "arrival_ts": EV.arrival(F.col("group_num")), "event_ts": F.timestamp_millis("timestamp")})
        df.coalesce(1).write.parquet(os.path.join(events_root, f"group={g:06d}"))


def _row(g, r, u, t, ct=0):
    return dict(kind="row", group_num=g, row_id=r, user_id=u, timestamp=t, content_id=10 + r, content_type_id=ct)


def _label(g, r, u, a):
    return dict(kind="label", group_num=g, row_id=r, user_id=u, answered_correctly=a)


def test_event_time_state_moves_between_batches(spark):
    """Time-ordered chunks, one a trigger: at least three batches whose sessions and windows cross them."""
    from tracefeat.plans.q_streaming import _event_time_replay
    from tracefeat.streaming import aggregates as K
    log = interaction_log(spark, SF_SMALL)
    root, ev = _event_time_replay(spark, SF_SMALL)
    for name, df, total in (("sessions", K.stream_sessions(ev), log.filter("content_type_id = 0").count()),
                            ("counts", K.windowed_counts(ev), 4 * log.count())):
        out, progress = _streamed(spark, df, root, name)
        read = [p for p in progress if p["numInputRows"] > 0]
        assert len(read) >= 4
        carried = [p["stateOperators"][0]["numRowsTotal"] for p in read[:4]]
        assert all(n > 0 for n in carried[:3]), carried
        marks = [p["eventTime"]["watermark"] for p in read]
        assert marks == sorted(marks) and len(set(marks)) >= 3
        assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in progress)
        assert out.filter("user_id >= 0" if name == "sessions" else "content_type_id IS NOT NULL") \
            .agg(F.sum("n_rows")).first()[0] == total


def test_late_events_leave_by_the_side_output(spark):
    """Arrival out of event-time order: on time + late = all, and the windows hold exactly what was on time."""
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    from tracefeat.streaming import replay as R
    rows = EV.event_frame(interaction_log(spark, SF_SMALL)).filter("kind = 'row'")
    hour = 3_600_000
    mixed = rows.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int") + F.when(
        F.col("event_ts") > "2024-01-15", 1).otherwise(0)).withColumn(
        "event_ts", F.when(F.col("row_id") == 3, F.lit(None)).otherwise(F.col("event_ts")))
    root = io.fresh_path(spark, "t-late-side")
    src = os.path.join(root, "events")
    R.write_chunks(mixed, "chunk", src)
    R.route_late(R.read_chunks(spark, src, EV.EVENT_SCHEMA), root, delay_ms=hour)
    late = R.late_rows(spark, root, EV.EVENT_SCHEMA)
    t = {r["row_id"]: (r["chunk"], r["ms"]) for r in mixed.select("row_id", "chunk", F.unix_millis("event_ts").alias("ms")).collect()}
    want = set()
    for i, (c, ms) in t.items():
        newest = max((m for k, m in t.values() if k < c and m is not None), default=None)
        if ms is None or newest is not None and newest - hour - ms > 0:
            want.add((i, c, None if ms is None else newest - hour - ms))
    assert {(r["row_id"], r["batch"], r["behind_ms"]) for r in late.collect()} == want and 10 < len(want) < 990
    on_time = spark.read.schema(EV.EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(
        os.path.join(root, "on_time")).filter("kind = 'row'")
    assert on_time.count() + len(want) == len(t)
    K.end_marker(spark, os.path.join(root, "on_time"), 0, max(m for _, m in t.values() if m) + 30 * 86_400_000)
    out, progress = _streamed(spark, K.windowed_counts(R.read_chunks(spark, os.path.join(root, "on_time"), EV.EVENT_SCHEMA)),
                              root, "counts")
    assert out.filter("content_type_id IS NOT NULL").agg(F.sum("n_rows")).first()[0] == 4 * on_time.count()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 0


def test_rows_without_an_answer_leave_by_timer(spark):
    """An idle user's row expires though that user sends nothing more; an answered one does not; a label that comes
    after its row expired is handed out too; the state is empty afterwards."""
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    from tracefeat.streaming.user_state import online_user_features
    root = io.fresh_path(spark, "t-expire")
    src = os.path.join(root, "events")
    rows = [_row(0, 1, 7, 100), _row(0, 2, 7, 200), _row(0, 3, 8, 100), _label(1, 2, 7, 1), _row(1, 4, 9, 100),
            _label(2, 4, 9, 0), _row(30, 5, 9, 300), _label(31, 5, 9, 1), _row(31, 6, 10, 1), _label(32, 3, 8, 1),
            _row(60, 7, 10, 5), _row(90, 8, 10, 6), _row(120, 9, 10, 7), _label(121, 6, 10, 1)]
    _loop_events(spark, rows, src)
    df = online_user_features(EV.read_events(spark, src, 1), row_ttl_ms=10_000, delay="1 second")
    out, progress = _streamed(spark, df, root, "out")
    got = {(r["kind"], r["row_id"]) for r in out.filter("kind <> 'feature'").collect()}
    assert got == {("expired_row", 1), ("expired_row", 3), ("expired_label", 3), ("expired_row", 6), ("expired_row", 7),
                   ("expired_row", 8)}
    feature = {r["row_id"]: (r["u_cnt"], r["u_corr_cnt"]) for r in out.filter("kind = 'feature'").collect()}
    assert feature[5] == (1, 0) and feature[7] == (0, 0) and len(feature) == 9


def test_waiting_rows_do_not_make_a_call_dearer(spark):
    """A call touches the entries its events name: the pending map is never walked."""
    from tracefeat.streaming.user_state import UserLoop
    import pandas as pd

    class Map(dict):
        touched = 0

        def containsKey(self, k):
            Map.touched += 1
            return k in self

        def getValue(self, k):
            Map.touched += 1
            return self[k]

        def updateValue(self, k, v):
            Map.touched += 1
            self[k] = v

        def removeKey(self, k):
            Map.touched += 1
            self.pop(k, None)

        def iterator(self):
            raise AssertionError("walked")

    class Cell(list):
        def exists(self):
            return bool(self)

        def get(self):
            return self[0] if self and not isinstance(self[0], list) else (self[0] if self else [])

        def update(self, v):
            self[:] = [v]

        def put(self, v):
            self[:] = [list(v)]

    class Handle:
        def getValueState(self, *a):
            return Cell()

        getListState = getValueState

        def getMapState(self, *a):
            return Map()

        def registerTimer(self, at):
            pass

    loop = UserLoop()
    loop.init(Handle())
    cost = []
    for g in range(60):
        ev = pd.DataFrame([dict(_row(g, 10 * g + k, 1, 100 * g + k), answered_correctly=None) for k in range(10)])
        ev["arrival_ts"] = pd.Timestamp(g + 1, unit="s")
        before = Map.touched
        list(loop.handleInputRows((1,), iter([ev]), None))
        cost.append(Map.touched - before)
    assert len(loop.pending) == 600 and max(cost[1:]) == min(cost[1:])


def test_answer_lists_feed_the_loop(spark):
    """Lists met with buffered rows; groups that never complete leave on both sides; a restart changes nothing."""
    from tracefeat.streaming import events as EV
    from tracefeat.streaming.labels import match_label_lists
    root = io.fresh_path(spark, "t-lists")
    src = os.path.join(root, "events")

    def answers(g, c, a):
        return dict(kind="list", group_num=g, prior_group_answers_correct=c, prior_group_responses=a)

    rows = [_row(0, 3, 1, 30), _row(0, 1, 2, 10), _row(0, 2, 1, 20), _row(1, 4, 1, 40), answers(1, "[1,0,1]", "[3,2,1]"),
            answers(2, "[0,1]", "[0,0]"), _row(2, 5, 1, 50), answers(9, "[1]", "[1]"), _row(40, 6, 1, 60)]
    _loop_events(spark, [r for r in rows if r["group_num"] < 2], src)

    def run():
        ev = EV.read_events(spark, src, 1).withWatermark("arrival_ts", "1 second")
        return _streamed(spark, match_label_lists(ev, ttl_ms=5_000), root, "out")[0]

    run()
    _loop_events(spark, [r for r in rows if r["group_num"] >= 2], src)
    out = run().collect()
    assert sorted((r["row_id"], r["user_id"], r["answered_correctly"], r["user_answer"], r["group_num"])
                  for r in out if r["kind"] == "label") == [(1, 2, 1, 3, 1), (2, 1, 0, 2, 1), (3, 1, 1, 1, 1)]
    assert sorted((r["kind"], r["row_id"], r["group_num"]) for r in out if r["kind"] != "label") == [
        ("unmatched_list", None, 2), ("unmatched_list", None, 9), ("unmatched_row", 4, 1), ("unmatched_row", 5, 2)]


def test_svd_of_a_flat_spectrum_and_of_nothing(spark):
    """Singular values within 1e-6 of numpy where they hardly fall; rank below k; an empty matrix."""
    import numpy as np
    from tracefeat.operators import ml
    x = interaction_log(spark, "/root/testdata/sf0.01").filter("content_type_id = 0").select("content_id", "user_id").distinct()
    emb, s = ml.svd_embedding(x, "content_id", "user_id", 5)
    p = x.toPandas()
    m = np.zeros((p["content_id"].max() + 1, p["user_id"].max() + 1))
    m[p["content_id"], p["user_id"]] = 1
    u, want, _ = np.linalg.svd(m, full_matrices=False)
    assert np.abs(np.array(s) - want[:5]).max() < 1e-6
    got = np.zeros((len(m), 5))
    for r in emb.collect():
        got[r[0]] = r[1:]
    assert np.abs(np.abs(got.T @ u[:, :5]) / want[:5] - np.eye(5)).max() < 1e-3
    two = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (None, 3)], "content_id int, user_id int")
    emb, s = ml.svd_embedding(two, "content_id", "user_id", 5)
    assert np.allclose(s, [2.0, 1.0]) and emb.count() == 3
    emb, s = ml.svd_embedding(two.limit(0), "content_id", "user_id", 5)
    assert s == [] and emb.count() == 0


def test_tag_vectors_have_their_company_for_neighbours(spark):
    """Tags of one of two kinds of question lie closer to their own kind; a second run gives the same vectors."""
    import numpy as np
    from tracefeat.operators import ml
    rows = [(i, " ".join(str(20 * (i % 2) + (i * 7 + j * 5) % 12) for j in range(4))) for i in range(200)] + [(999, "77"), (998, None)]
    qs = spark.createDataFrame(rows, "question_id int, tags string")
    once, again = ({r["tag"]: np.array(r["vec"]) for r in ml.tag_ppmi_vectors(qs, size=30).collect()} for _ in range(2))
    assert set(once) == {str(t) for t in [*range(12), *range(20, 32), 77]} | {"nan"}
    assert not once["77"].any() and not once["nan"].any()
    assert all(abs(once[t] @ once[u] - again[t] @ again[u]) < 1e-8 for t in once for u in once)     # equal values may turn
    unit = {t: v / np.linalg.norm(v) for t, v in once.items() if v.any()}
    own = [unit[a] @ unit[b] for a in unit for b in unit if a != b and (int(a) < 20) == (int(b) < 20)]
    far = [unit[a] @ unit[b] for a in unit for b in unit if (int(a) < 20) != (int(b) < 20)]
    assert np.mean(own) > np.mean(far) + 0.1 and max(map(abs, far)) < 0.1
    vec = {r["tag"]: np.array(r["w2v"]) for r in ml.tag_word2vec(qs, size=8, partitions=3).collect()}
    assert set(vec) == set(once)


def test_fine_grid_blends_agree_with_the_shuffled_form_and_the_coarse_grid(spark):
    from tracefeat.operators import evaluate as E
    from tracefeat.plans.q_evaluate import _scores3
    s = _scores3(spark, SF_SMALL).withColumn("a", F.when(F.col("row_id") % 50 != 0, F.col("a")))     # null scores too
    cols = ["a", "b", "c"]
    fine = {r[:3]: r["auc"] for r in E.blend_search(s, cols, E.weight_grid(3, 0.01)).select("w0", "w1", "w2", "auc").collect()}
    assert len(fine) == 5151
    coarse = {r[:3]: r["auc"] for r in E.blend_search(s, cols, E.weight_grid(3, 0.1), max_rows=0, block=30)
              .select("w0", "w1", "w2", "auc").collect()}
    assert len(coarse) == 66
    for w, v in coarse.items():
        assert abs(fine[w] - v) < 1e-12
    one = E.auc(s.withColumn("score", F.lit(0.0) + F.col("a") * 0.37 + F.col("b") * 0.21 + F.col("c") * 0.42)).first()[0]
    assert abs(fine[(0.37, 0.21, 0.42)] - one) < 1e-12
    single = E.blend_search(s.filter("y = 1"), cols, E.weight_grid(3, 0.5))
    assert [r["auc"] for r in single.collect()] == [None] * 6


def test_multilabel_folds_hold_their_share_of_every_label(spark):
    """Three correlated labels, one rare; null is a label value like any other."""
    rows = [(i, int(i % 3 == 0), int(i % 3 == 0 and i % 7 < 5 or i % 31 == 0), 1 if i % 50 == 7 else None if i % 11 == 0 else 0)
            for i in range(1003)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int, c int")
    for order in ("hash", "id"):
        out = V.multilabel_stratified_kfold(df, ["a", "b", "c"], 5, seed=3, order=order).toPandas()
        assert sorted(out["row_id"]) == list(range(1003)) and set(out["fold"]) == set(range(5))
        for label in ("a", "b", "c"):
            n = out[label].isna().sum() / 5
            assert abs(out[out[label].isna()].groupby("fold").size().reindex(range(5), fill_value=0) - n).max() <= 1.6
            for v in out[label].dropna().unique():
                n = (out[label] == v).sum() / 5
                assert abs(out[out[label] == v].groupby("fold").size().reindex(range(5), fill_value=0) - n).max() <= 1.6, (label, v)
    assert V.multilabel_stratified_kfold(df.limit(0), ["a", "b"], 5).count() == 0


def test_stratified_group_folds_are_the_greedy_ones(spark):
    """Classes of equal groups give what a group-by-group greedy gives, beat dealing in snake order, and keep groups whole."""
    import numpy as np
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for g in range(120):
        for _ in range(int(rng.integers(1, 30)) if g < 60 else 4):
            rows.append((i, g if g != 5 else None, int(rng.random() < (g % 10) / 12) if g < 60 else i % 2))
            i += 1
    df = spark.createDataFrame(rows, "row_id long, user_id long, y int")
    out = V.stratified_group_kfold(df, "user_id", "y", 4).toPandas()
    assert len(out) == len(rows) and (out.groupby("user_id", dropna=False)["fold"].nunique() == 1).all()
    total = out.groupby("y").size()

    def spread(folds):
        table = out.assign(fold=folds).groupby(["fold", "y"]).size().unstack(fill_value=0).reindex(range(4), fill_value=0)
        return (table / total).std(ddof=0).mean()

    counts = out.groupby(["user_id", "y"], dropna=False).size().unstack(fill_value=0)
    held, fold_of = np.zeros((4, 2)), {}
    for g, c in sorted(((g, tuple(c)) for g, c in zip(counts.index, counts.to_numpy())), key=lambda x: -sum(x[1])):
        tried = [np.mean(np.std([(held + np.eye(4)[f][:, None] * c)[k] / total.to_numpy() for k in range(4)], axis=0)) for f in range(4)]
        f = int(np.argmin(tried))
        held[f] += c
        fold_of[g] = f
    greedy = spread([fold_of[g] if g in fold_of else fold_of[np.nan] for g in out["user_id"]]) if not out["user_id"].isna().any() \
        else spread(out["user_id"].map(lambda g: next(v for k, v in fold_of.items() if k == g or (k != k and g != g))))
    snake = {g: (lambda p: p % 4 if p // 4 % 2 == 0 else 3 - p % 4)(p) for p, g in enumerate(
        sorted(counts.index, key=lambda g: -(counts.loc[g].iloc[1] / counts.loc[g].sum()) if g == g else 0))}
    dealt = spread(out["user_id"].map(lambda g: next(v for k, v in snake.items() if k == g or (k != k and g != g))))
    assert spread(out["fold"]) <= greedy * 1.5 + 1e-3 and spread(out["fold"]) < dealt


def test_encoder_refresh_reads_a_bounded_number_of_files(spark):
    """Twenty batches folded every three, restarted in between and one batch replayed: exact counts, at most eight folders."""
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import events as EV
    root = io.fresh_path(spark, "t-k5")
    src, table, ck = (os.path.join(root, x) for x in ("events", "table", "ck"))
    rows = [_row(g, 10 * g + k, 1, 100 * g + k) | {"content_id": (g + k) % 4} for g in range(10) for k in range(3)]
    more = [r | {"group_num": r["group_num"] + 10, "row_id": r["row_id"] + 1000} for r in rows]
    for part in (rows, more):
        _loop_events(spark, part, src)
        K.refresh_encoder(EV.read_events(spark, src, 1), table, ck, fold_every=3)
        got = {r[0]: r[1] for r in K.read_encoder(spark, table).collect()}
        n = len(part) * (1 if part is rows else 2)
        want = {c: sum(r["content_id"] == c for r in rows) * n // len(part) for c in range(4)}
        assert got == want
    assert len(os.listdir(os.path.join(table, "delta"))) <= 6 and len(os.listdir(os.path.join(table, "base"))) == 2
    import shutil
    copy = os.path.join(root, "copy")
    shutil.copytree(ck, copy)
    for f in os.listdir(os.path.join(copy, "commits")):
        if f.strip(".").split(".")[0] == "19":                       # the last batch was written but not committed
            os.remove(os.path.join(copy, "commits", f))
    K.refresh_encoder(EV.read_events(spark, src, 1), table, copy, fold_every=3)
    assert {r[0]: r[1] for r in K.read_encoder(spark, table).collect()} == want
