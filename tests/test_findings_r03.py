"""Findings of round 3: calls that stay off the state store, streams without a time bound, vectors that travel whole."""

import os

import pandas as pd
import pytest

from conftest import make_log
from tracefeat.sources import io


class Store:
    """A state variable that counts the calls it gets."""

    def __init__(self):
        self.calls, self.value, self.map = [], None, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.value
            if name == "exists":
                return self.value is not None
            if name == "update":
                self.value = args[0]
            if name == "containsKey":
                return args[0] in self.map
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name == "getValue":
                return self.map[args[0]]
            if name == "removeKey":
                self.map.pop(args[0])
            return None
        return call


class Handle:
    def __init__(self):
        self.of, self.timers = {}, []

    def _state(self, name, *schema):
        return self.of.setdefault(name, Store())

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def _event(kind, g, r, user=1, **more):
    e = dict(kind=kind, group_num=g, row_id=r, user_id=user, timestamp=10 * (r or 0), content_id=5, content_type_id=0,
             answered_correctly=None, arrival_ts=pd.Timestamp(g + 1, unit="s"), prior_group_answers_correct=None,
             prior_group_responses=None)
    return {**e, **more}


def test_answered_rows_never_reach_the_state_store():
    """rows whose answers come in the same call cost one read and one write of the user's value, and no timer."""
    from tracefeat.streaming.user_state import UserLoop
    loop, handle = UserLoop(), Handle()
    loop.init(handle)
    ev = pd.DataFrame([e for r in range(50) for e in (
        _event("row", r, r), _event("label", r + 1, r, answered_correctly=1))])
    out = list(loop.handleInputRows((1,), iter([ev]), None))
    assert len(out) == 50 and sum(len(s.calls) for s in handle.of.values()) == 2 and handle.timers == []
    assert [r.u_cnt for r in out] == list(range(50)) and out[-1].seq_answered_correctly == [1] * 20


def test_whole_groups_never_reach_the_state_store():
    """a group that comes with its answer list is matched without state; a part of one waits, and no row twice."""
    from tracefeat.streaming.labels import LabelMatcher
    m, handle = LabelMatcher(), Handle()
    m.init(handle)
    rows = [_event("row", 0, r, user=r % 3) for r in (2, 1, 0)]
    answers = _event("list", 1, None, prior_group_answers_correct="[1,0,1]", prior_group_responses="[3,2,1]")
    out = list(m.handleInputRows((0,), iter([pd.DataFrame(rows), pd.DataFrame([answers])]), None))
    assert [(r.row_id, r.answered_correctly, r.user_answer, r.group_num) for r in out] == [(0, 1, 3, 1), (1, 0, 2, 1),
                                                                                          (2, 1, 1, 1)]
    assert sum(len(s.calls) for s in handle.of.values()) <= 1 and handle.timers == []
    assert list(m.handleInputRows((0,), iter([pd.DataFrame(rows)]), None)) == [] and len(handle.timers) == 1


def test_streams_run_to_their_end():
    """the runners set no bound of their own on a stream whose time grows with its input."""
    import inspect
    from tracefeat.streaming import aggregates as K
    from tracefeat.streaming import replay as R
    for run in (K.run_to_parquet, K.refresh_encoder, R.route_late):
        assert inspect.signature(run).parameters["timeout_s"].default is None


def test_triggers_do_not_grow_with_the_writing_tasks(spark):
    """a chunk is one trigger's files, whatever the number of shuffle partitions."""
    from tracefeat.streaming import events as EV
    log = make_log(spark, [dict(row_id=i, user_id=i % 200, timestamp=i) for i in range(4000)])
    path = os.path.join(io.fresh_path(spark, "t-files"), "events")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert EV.write_microbatches(EV.event_frame(log), path) == 9
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    path = path.removeprefix("file:")
    files = [[f for f in os.listdir(os.path.join(path, c)) if f.endswith(".parquet")] for c in os.listdir(path)]
    assert len(files) <= 4 and max(map(len, files)) <= 4


def _questions(spark):
    return spark.createDataFrame([(1, "1 2"), (1, "2"), (2, "3"), (3, None), (4, "9"), (None, "1 4"), (5, "1 2 5 4")],
                                 "question_id long, tags string")


def _vectors(spark):
    nan = float("nan")
    return spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None, 5.0]), (2, [7.0, 1.0]), (3, [nan, None]), (4, None),
                                  (5, []), (None, [1.0])], "vec_id long, embedding array<float>")


def test_tag_vectors_travel_whole(spark):
    """repeated ids, repeated tags, ragged and missing vectors give what the aggregates over single components
    give, and the vectors are not taken apart before the shuffles."""
    from pyspark.sql import functions as F
    from tracefeat.operators.encoders import tag_vector_stats
    qs, vs = _questions(spark), _vectors(spark)
    qt = qs.select("question_id", F.explode(F.transform(F.split("tags", " "), lambda t: t.cast("long"))).alias("vec_id"))
    one = vs.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    want = qt.join(one, "vec_id").groupBy("question_id", "dim").agg(
        F.sum("x") / F.count("x"), F.median("x"), F.stddev_samp("x"), F.max("x"), F.min("x"))
    got = tag_vector_stats(qs, vs)

    def rows(df):
        return sorted(tuple("-" if v is None else str(v) if isinstance(v, int) else f"{v:.9f}" for v in r) for r in df.collect())
    assert rows(got) == rows(want)
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_the_items_questions_are_made_wide(spark):
    """tag vectors of questions without an item are neither aggregated nor pivoted."""
    from tracefeat.operators.encoders import attach_tag_vectors, questions_of, tag_vector_stats
    items = spark.createDataFrame([(1,), (7,), (None,)], "content_id long")
    df = attach_tag_vectors(items, tag_vector_stats(questions_of(items, _questions(spark)), _vectors(spark)), 2)
    assert {r["content_id"]: (r["tag_vec_mean_0"], r["tag_vec_mean_1"]) for r in df.collect()} == {
        1: (pytest.approx(21 / 5), pytest.approx(4 / 3)), 7: (None, None), None: (None, None)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("LeftSemi")        # below the aggregate


@pytest.mark.parametrize("seg_rows", [None, 8])
def test_an_entry_is_read_at_two_levels(spark, seg_rows):
    """ranks equal a plain count over the 189 counters, from at most three rows an entry."""
    import random
    from tracefeat.operators import user_state as U
    rnd = random.Random(3)
    log = [dict(row_id=i, user_id=i % 2, timestamp=i // 3, content_type_id=int(i % 7 == 0),
                tags=None if i % 9 == 0 else " ".join(str(rnd.choice((0, 3, 4, 5, 188, 300))) for _ in range(3)))
           for i in range(120)]
    df = U.tag_rank(U.with_seq(U.prepare(make_log(spark, log))), chunk_rows=seg_rows)
    got = {r["row_id"]: (r["u_hist_tag_rank_max"], r["u_hist_tag_rank_min"], r["u_hist_tag_rank_sum"]) for r in df.collect()}
    cnt = {}
    for e in sorted(log, key=lambda e: (e["timestamp"], e["row_id"])):
        c = cnt.setdefault(e["user_id"], {t: 0 for t in [*range(189), 300]})
        if e["content_type_id"]:
            assert got[e["row_id"]] == (None, None, None)
            continue
        tags = [int(t) for t in (e["tags"] or "0").split()]
        order = {t: k for k, t in enumerate(sorted(c, key=lambda t: (c[t], t)))}
        ranks = [order[t] for t in tags]
        assert got[e["row_id"]] == (max(ranks), min(ranks), sum(ranks))
        for t in tags:
            c[t] += 1
    assert "node" not in df._jdf.queryExecution().analyzed().toString()
