"""Task groups of any size in segmented form; one-pass standardisation; item values joined before the sequence frame."""

import math
import statistics

from conftest import make_log
from pyspark.sql import functions as F

from tracefeat.operators import prep as P
from tracefeat.operators import sequences as Q
from tracefeat.operators import windows as W
from tracefeat.plans import segmented as SG


def hot_log(spark, n):
    """One user with a single task of n rows between two small ones, and a user with a null task."""
    r = F.col("id")
    big = spark.range(n + 4).select(
        r.alias("row_id"), F.lit(1).cast("long").alias("user_id"), (r * 10).alias("timestamp"),
        ((r * 7919) % 1000).cast("int").alias("content_id"), F.lit(0).alias("content_type_id"),
        F.when(r < 2, 1).when(r < n + 2, 2).otherwise(3).alias("task_container_id"), F.lit(0).alias("user_answer"),
        ((r * 31) % 3 == 0).cast("int").alias("answered_correctly"), F.lit(1.0).alias("prior_question_elapsed_time"),
        F.lit(False).alias("prior_question_had_explanation"), F.lit(1).alias("part"), F.lit("1").alias("tags"))
    small = make_log(spark, [dict(row_id=10 ** 9 + i, user_id=2, timestamp=i, content_id=5 - i, task_container_id=t)
                             for i, t in enumerate([None, None, 4])])
    return big.unionByName(small)


def test_one_task_of_many_rows(spark):
    n = 100_000
    log = hot_log(spark, n)
    with SG.segmented_plan(5_000, 128):
        s = SG.segmented_input(log)
        order = SG.finish(W.order_in_task(s))
        got = {r[0]: (r[1], r[2]) for r in order.select(
            "row_id", "order_content_id_by_task_container_id", "order_content_id_div_max_by_task_container_id").collect()}
    want = sorted(((i * 7919) % 1000, i) for i in range(2, n + 2))
    assert all(got[i] == (k + 1, (k + 1) / n) for k, (_, i) in enumerate(want))
    assert [got[10 ** 9 + i][0] for i in range(3)] == [2, 1, 1]          # a null task is a group
    with SG.segmented_plan(5_000, 128):
        parts = W.group_answer_parts(SG.segmented_input(log), 10_000).filter("user_id = 1 AND group_num = 1").collect()
        SG._BASE.set(None)
    assert sorted(len(p["answers"]) for p in parts) == [10_000] * (n // 10_000)
    answers = [a for p in sorted(parts, key=lambda p: p["part"]) for a in p["answers"]]
    assert answers == [int((i * 31) % 3 == 0) for i in range(2, n + 2)]


def test_parts_make_the_whole_list(spark):
    """The previous group's list does not depend on the size of its parts, nor on segments."""
    log = hot_log(spark, 9)

    def lists(df):
        return sorted((r[0], r[1], r[2], r[3]) for r in df.select(
            "row_id", "group_num", "prior_group_answers_correct", "user_task_count").collect())

    plain = lists(W.group_number(log))
    assert plain == lists(W.group_number(log, part_rows=2))
    with SG.segmented_plan(4, 4):
        assert plain == lists(SG.finish(W.group_number(SG.segmented_input(log), part_rows=2)))
    after = [p for p in plain if p[0] == 11][0]
    assert after[1] == 2 and after[2] == [int((i * 31) % 3 == 0) for i in range(2, 11)]


def test_standardize_fills_nulls_and_infinities(spark):
    inf = float("inf")
    x, y = [1.0, 5.0, None, inf, -3.0, inf, None], [None] * 7
    df = spark.createDataFrame([(i, a, b, 1e9 + i) for i, (a, b) in enumerate(zip(x, y))],
                               "row_id long, x double, y double, z double")
    out = P.standardize(df, ["x", "y", "z"]).orderBy("row_id").collect()
    known = [6.0 if v == inf else v for v in x if v is not None]
    mean = sum(known) / len(known)
    full = [mean if v is None else 6.0 if v == inf else v for v in x]
    sd = statistics.stdev(full)
    assert all(math.isclose(r["x"], (v - mean) / sd, rel_tol=1e-12, abs_tol=1e-12) for r, v in zip(out, full))
    assert {r["y"] for r in out} == {None}
    sd = statistics.stdev(range(7))
    assert all(math.isclose(r["z"], (i - 3) / sd, rel_tol=1e-9, abs_tol=1e-9) for i, r in enumerate(out))
    plan = P.standardize(df, ["x", "y", "z"])._jdf.queryExecution().optimizedPlan().toString()
    assert "var_pop" in plan
    one = P.standardize(df.limit(1), ["x"]).collect()
    assert one[0]["x"] is None                                           # no deviation to divide by


def test_item_values_in_sequences(spark):
    """Padding takes the value of item 0 where there is one; unknown items the fill; no explode in the plan."""
    log = make_log(spark, [dict(row_id=i, user_id=1, timestamp=i, content_id=c) for i, c in enumerate([7, 8, 7])])
    log = log.withColumn("is_val", F.lit(1))
    te = spark.createDataFrame([(0, 0.25), (7, 0.5)], "content_id int, te_mean double")

    def run(table):
        x, fills = Q.with_te(log, table)
        return Q.last_n_sequence(x, ["content_id", "te"], ["answered_correctly"], 4, "timestamp", "is_val", fills)

    rows = run(te).orderBy("row_id").collect()
    assert [r["seq_te"] for r in rows] == [[0.25, 0.25, 0.5], [0.25, 0.5, Q.TE_FILL], [0.5, Q.TE_FILL, 0.5]]
    assert run(te.filter("content_id = 7")).orderBy("row_id").first()["seq_te"] == [Q.TE_FILL, Q.TE_FILL, 0.5]
    assert "Generate" not in run(te)._jdf.queryExecution().executedPlan().toString()
    tags = spark.createDataFrame([(7, [188, 188, 188, 188, 1, 2])], "content_id int, tag_list array<int>")
    x, fills = Q.with_tags(log, tags)
    t = Q.last_n_sequence(x, ["item_tags"], ["answered_correctly"], 4, "timestamp", "is_val", fills)
    first = t.orderBy("row_id").first()["seq_item_tags"]
    assert first == [[188] * 6, [188] * 6, [188, 188, 188, 188, 1, 2]]
