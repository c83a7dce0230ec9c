"""Hand-made 5-10 row cases for the quirks listed in the fixture notes."""

import pytest
from pyspark.sql import functions as F

from conftest import make_log
from tracefeat.operators import encoders as A
from tracefeat.operators import evaluate as E
from tracefeat.operators import prep as P
from tracefeat.operators import sequences as Q
from tracefeat.operators import user_state as U
from tracefeat.operators import windows as W


def _by_row(df, *cols):
    return {r["row_id"]: tuple(r[c] for c in cols) for r in df.select("row_id", *cols).collect()}


def test_single_row_user(spark):
    df = make_log(spark, [dict(row_id=1, user_id=7, timestamp=100)])
    out = W.rolling_prior_mean(W.time_diffs(W.user_running(df)))
    r = out.collect()[0]
    assert (r.prior_correct_sum, r.prior_count, r.prior_correct_rate) == (0, 0, None)
    assert r.answered_correctly_rolling3 is None and r.timestamp_diff1 is None


def test_exactly_w_rows(spark):
    rows = [dict(row_id=i, user_id=1, timestamp=i * 10, answered_correctly=i % 2) for i in range(4)]
    out = _by_row(W.rolling_prior_mean(make_log(spark, rows), (3,)), "answered_correctly_rolling3")
    assert out[2] == (None,)
    assert out[3] == ((0 + 1 + 0) / 3,)


def test_lecture_rows_counted_in_w1_not_in_u1(spark):
    rows = [dict(row_id=1, user_id=1, timestamp=1, content_type_id=1, answered_correctly=-1, part=None),
            dict(row_id=2, user_id=1, timestamp=2, answered_correctly=1),
            dict(row_id=3, user_id=1, timestamp=3, content_type_id=1, answered_correctly=-1, part=None),
            dict(row_id=4, user_id=1, timestamp=4, answered_correctly=0)]
    df = make_log(spark, rows)
    w1 = _by_row(W.user_running(df), "prior_correct_sum", "prior_count")
    assert w1[4] == (-1 + 1 - 1, 3)
    u = U.counts(U.with_seq(U.prepare(df)), 0.5)
    u1 = _by_row(U.questions_only(u), "u_cnt", "u_corr_cnt")
    assert u1 == {2: (0, 0), 4: (1, 1)}
    lec = _by_row(U.questions_only(U.lecture_and_elapsed(u)), "u_hist_lec_cnt")
    assert lec == {2: (1,), 4: (2,)}


def test_null_part_runs(spark):
    parts = [1, 1, None, None, 2, 2, 2]
    df = make_log(spark, [dict(row_id=i, user_id=1, timestamp=i, part=p) for i, p in enumerate(parts)])
    out = _by_row(W.run_length(df), "user_part_continous_count")
    assert [out[i][0] for i in range(7)] == [1, 2, 1, 1, 1, 2, 3]
    same = _by_row(W.same_part_recent(df, (10,)), "user_part_count10")
    assert [same[i][0] for i in range(7)] == [0, 1, 0, 0, 0, 1, 2]


def test_zero_gap_gives_null_not_inf(spark):
    rows = [dict(row_id=i, user_id=1, timestamp=t) for i, t in enumerate([0, 5, 10, 15, 15])]
    out = _by_row(W.rolling_over_gap(make_log(spark, rows), (3,)), "answered_correctly_rolling3_div_elapsed_from_prior")
    assert out[4] == (None,)
    assert out[3][0] is not None


def test_repeated_item_inside_task_and_order(spark):
    rows = [dict(row_id=1, user_id=1, timestamp=1, content_id=9, task_container_id=0),
            dict(row_id=2, user_id=1, timestamp=1, content_id=3, task_container_id=0),
            dict(row_id=3, user_id=1, timestamp=1, content_id=9, task_container_id=0)]
    df = make_log(spark, rows)
    o = _by_row(W.order_in_task(df), "order_content_id_by_task_container_id")
    assert o == {2: (1,), 1: (2,), 3: (3,)}
    a = _by_row(W.attempt_count(df), "attempt")
    assert a[3] == (2,)


def test_tag_repeated_in_row_counts_twice(spark):
    rows = [dict(row_id=1, user_id=1, timestamp=1, tags="5 5", answered_correctly=1),
            dict(row_id=2, user_id=1, timestamp=2, tags="5")]
    df = U.with_seq(U.prepare(make_log(spark, rows)))
    out = _by_row(U.tag_history(df), "u_hist_tag_num", "u_hist_tag_corr_num")
    assert out[2] == (2, 2)


def test_item_in_one_fold_is_null_oof(spark):
    rows = [dict(row_id=i, user_id=1, timestamp=i, content_id=c, answered_correctly=i % 2)
            for i, c in enumerate([1, 1, 2, 1, 1])]
    df = make_log(spark, rows).withColumn("fold", F.col("row_id") % 2)
    te = _by_row(A.target_encoding_oof(df, "content_id", "answered_correctly"), "te_content_id_by_answered_correctly")
    assert te[2] == (None,)                         # item 2 only in fold 0
    assert te[0] == ((1 + 1) / 2,)                   # rows 1, 3 of item 1 are in fold 1


def test_all_equal_scores_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, score double")
    assert E.auc(df, "y", "score").collect()[0].auc == 0.5
    one = spark.createDataFrame([(1, 0.1), (1, 0.9)], "y int, score double")
    assert E.auc(one, "y", "score").collect()[0].auc is None


def test_session_threshold_is_strict(spark):
    th = 1000
    rows = [dict(row_id=i, user_id=1, timestamp=t) for i, t in enumerate([0, th, 2 * th + 1, 2 * th + 2])]
    df = U.with_seq(U.prepare(make_log(spark, rows)))
    out = _by_row(U.session_features(df, th), "u_session_short_cnt", "u_cnt_in_session_short")
    # gap == threshold does not open a session; gap > threshold does
    assert out[1] == (0, 1)
    assert out[2] == (0, 0)
    assert out[3] == (1, 1)


def test_lecture_type_code_and_fill_defaults(spark):
    lect = spark.createDataFrame([(3, 1, 1, "intention")], "lecture_id long, tag int, part int, type_of string")
    rows = [dict(row_id=1, user_id=1, timestamp=1, content_id=3, content_type_id=1, answered_correctly=-1),
            dict(row_id=2, user_id=1, timestamp=2, content_id=4, prior_question_elapsed_time=None,
                 prior_question_had_explanation=None, part=None, tags=None)]
    df = make_log(spark, rows)
    lt = _by_row(P.lecture_type_code(df, lect), "type_of_id", "answered_correctly")
    assert lt == {1: (2, 2), 2: (4, 1)}
    fd = _by_row(P.fill_defaults(df), "prior_question_elapsed_time", "prior_question_had_explanation", "part", "tags")
    assert fd[2] == (-1, 0, 0, "0")


def test_sequence_padding_and_shift(spark):
    rows = [dict(row_id=i, user_id=1, timestamp=10 * (i + 1), content_id=i + 1, answered_correctly=1)
            for i in range(3)]
    df = make_log(spark, rows).withColumn("is_val", F.lit(1))
    out = {r.row_id: r for r in Q.last_n_sequence(df, ["content_id"], ["answered_correctly"], 5).collect()}
    r = out[2]
    assert r.seq_content_id == [0, 1, 2, 3]
    assert r.seq_answered_correctly == [0, 0, 1, 1]
    assert r.seq_timestamp_diff == [0, 10, 10, 10]


def test_datasets_by_name(spark):
    """Every numbered dataset gives its own fields; windows are whole, in order and padded in front."""
    from tracefeat.operators import lookup as L
    from tracefeat.operators.samples import DATASETS
    rows = [(u * 100 + i, u, i * 60000, 1 + i, 1 + i % 7, i % 2, i, 1000.0 if i else None, True if i % 3 else None, int(i > 7))
            for u, n in ((1, 10), (2, 3), (3, 1)) for i in range(n)]
    log = spark.createDataFrame(rows, "row_id long, user_id long, timestamp long, content_id int, part int, "
                                "answered_correctly int, task_container_id int, prior_question_elapsed_time double, "
                                "prior_question_had_explanation boolean, is_val int")
    q = spark.createDataFrame([(i, "1 2" if i % 2 else None) for i in range(12)], "question_id int, tags string")
    te = spark.createDataFrame([(1, 0.5), (2, 0.25)], "content_id int, te_mean double")
    for k, (fields, sampling, pad) in DATASETS.items():
        name = "" if k == 1 else str(k)
        train = L.dataset(log, f"CustomTrainDataset{name}", questions=q, te=te, max_seq=5, step=4)
        assert train.columns == ["user_id", "chunk_id", *fields.split(), "label"]
        test = L.dataset(log, f"CustomTestDataset{name}", questions=q, te=te, max_seq=5)
        assert test.columns == ["row_id", *fields.split(), "label"]
        if k not in (1, 7, 15):
            continue
        got = train.collect()
        assert {r["user_id"] for r in got} == {1, 2}                  # a user of one row gives no sample
        item = "target_id" if k == 1 else "in_ex"
        for r in got:
            real = [v for v in r[item] if v]
            assert len(r[item]) == 4 and r[item] == [0] * (4 - len(real)) + real
            assert real == list(range(real[0], real[0] + len(real)))
        last = {r["row_id"]: r for r in test.collect()}
        assert set(last) == {108, 109} and last[109][item] == [7, 8, 9, 10] and last[109]["label"] == [0, 1, 0, 1]
    r = last[109]
    assert r["in_de"] == [1, 0, 1, 0] and r["in_tag"][0] == [188] * 4 + [1, 2] and r["in_tag"][1] == [188] * 5 + [0]
    assert [v[0] for v in r["num_feat"]] == [0.625164097637492] * 4 and r["num_feat"][3][1] == 0.5
    code = L.dataset(log, "CustomTestDataset", max_seq=5, n_items=100).collect()
    assert {c["row_id"]: c["x"] for c in code}[109] == [106, 7, 108, 9]
    flat = {r["row_id"]: r for r in L.dataset(log, "CustomMlpDataset2", features=["content_id", "part"]).collect()}
    assert flat[109]["content_id"] == 10 and flat[109]["feats"] == [3.0] and flat[109]["label"] == 1
    assert L.dataset(log.limit(0), "CustomTrainDataset3", max_seq=5).count() == 0
    for bad in ("CustomTrainDataset16", "CustomTrainDataset02", "CustomTrainDataset1", "CustomOther", "CustomMlpDataset3"):
        with pytest.raises(KeyError):
            L.dataset(log, bad, **({"features": ["part"]} if "Mlp" in bad else {}))
