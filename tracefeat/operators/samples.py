"""Training and validation samples by dataset name: field lists over the sequence operators (Q1-Q14).

Every named dataset is a list of fields, a sampling rule and a tag padding.
Both kinds of sample go through the same form, arrays of ``max_seq`` values
padded on the left: a training sample is a drawn window of a user or chunk, a
validation sample the last ``max_seq`` rows up to a chosen row.  Fields known
when a question is asked are the last ``max_seq - 1`` values, answers the
``max_seq - 1`` before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.operators import prep as P
from tracefeat.operators import sequences as Q

# The datasets of the configurations.  number -> (fields, sampling, padding of short tag lists)
DATASETS = {
    1: ("x target_id part", "user", None),
    2: ("in_ex in_cat in_de", "user", None),
    3: ("in_ex in_dt in_cat in_de", "user", None),
    4: ("in_ex in_dt in_el in_cat in_de", "user", None),
    5: ("in_ex in_dt in_el in_tag in_cat in_de", "user", 0),
    6: ("in_ex in_dt in_el in_tag in_exp in_cat in_de", "user", 0),
    7: ("in_ex in_task in_dt in_el in_tag in_exp in_cat in_de", "user", 0),
    8: ("in_ex in_dt in_el in_tag in_exp in_cat in_de num_feat", "user", 0),
    9: ("in_ex in_dt in_el in_tag in_exp in_cat in_de num_feat", "step", 0),
    10: ("in_ex in_dt in_el in_tag in_exp in_cat in_de num_feat", "step", 0),
    11: ("in_ex in_dt in_el in_tag in_exp in_cat in_de num_feat", "step", 188),
    12: ("in_ex in_dt in_el in_tag in_cat in_de num_feat", "step", 188),
    13: ("in_ex in_dt in_el in_tag in_cat in_de in_ts num_feat", "step", 188),
    14: ("in_ex in_dt in_el in_tag in_cat in_de in_ts num_feat", "step", 188),
    15: ("in_ex in_dt in_el in_tag in_cat in_de in_ts num_feat ts_mask", "step", 188),
}
# the column a field is made of, besides the item, the answer and the mark of real rows
SOURCES = {"part": "part", "in_cat": "part", "in_dt": "timestamp", "in_el": "prior_question_elapsed_time",
           "in_exp": "prior_question_had_explanation", "in_tag": "_tags", "in_task": "task_container_id",
           "in_ts": "task_container_id", "ts_mask": "task_container_id", "num_feat": "_te"}


def _sources(fields) -> list[str]:
    return list(dict.fromkeys(["content_id", "answered_correctly", "_real", *[SOURCES[f] for f in fields if f in SOURCES]]))


def _row_values(rows: DataFrame, questions: DataFrame | None, te: DataFrame | None, fields, tag_pad) -> tuple[DataFrame, dict]:
    """Rows with the item values that the fields need, joined before any sequence is built, and their padding."""
    fills = {}
    if "in_tag" in fields:
        tags = questions.select(F.col("question_id").alias("content_id"),
                                P.tag_array("tags", tag_pad, 0).alias("tag_list"))
        rows, fills = Q.with_tags(rows, tags, name="_tags")
    if "num_feat" in fields:
        rows = Q.with_te(rows, te, name="_te")[0]
    if "in_exp" in fields:
        explained = F.coalesce(F.col("prior_question_had_explanation").cast("int"), F.lit(0))
        rows = rows.withColumn("prior_question_had_explanation", explained)
    return rows.withColumn("_real", F.lit(1)), fills


def user_windows(rows: DataFrame, cols, max_seq: int, method: str = "hash", seed: int = 0, min_rows: int = 2) -> DataFrame:
    """One drawn window of at most ``max_seq`` rows a user, as arrays in time order.

    Users of ``max_seq`` rows or more give a window at a drawn place, a tenth
    of them their last rows; shorter ones a drawn beginning of two rows or
    more, a tenth all their rows.  The window is drawn from the row count and
    cut by position, so a user's whole history is never one array."""
    rows = Q._position(Q._real_rows(rows), "_p")
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    n = n.withColumn("chunk_id", F.lit(0).cast("long"))
    r, size = Q.crop_draw(method, seed), F.col("_n")
    usual = F.pmod(r, F.lit(10)) != 0
    start = F.when(size < max_seq, 0).when(usual, F.pmod(r, size - max_seq + 1)).otherwise(size - max_seq)
    length = F.when(size >= max_seq, max_seq).when(usual, F.pmod(r, size - 1) + 2).otherwise(size)
    cut = rows.join(n.withColumns({"_from": start, "_len": length}), "user_id")
    cut = cut.filter((F.col("_p") >= F.col("_from")) & (F.col("_p") < F.col("_from") + F.col("_len")))
    g = cut.groupBy("user_id", "chunk_id").agg(F.sort_array(F.collect_list(Q._ordered_struct(cols))).alias("_s"))
    return g.select("user_id", "chunk_id", *[F.transform("_s", Q._field(c)).alias(c) for c in cols])


def _padded(arrays: DataFrame, cols, max_seq: int, fills) -> DataFrame:
    return arrays.withColumns({c: Q.pad_front(F.col(c), max_seq, fills.get(c, 0)) for c in cols})


def _fields(padded: DataFrame, keys, fields, max_seq: int, n_items: int) -> DataFrame:
    """The named fields and the label from padded arrays of ``max_seq`` values."""
    def known(c):
        return F.slice(c, 2, max_seq - 1)

    def earlier(c):
        return F.slice(c, 1, max_seq - 1)

    n_pad = F.size(F.filter(known("_real"), lambda v: v == 0))
    item, task, answers = known("content_id"), known("task_container_id"), earlier("answered_correctly")
    make: dict[str, Callable] = {
        "x": lambda: F.zip_with(earlier("content_id"), answers, lambda i, a: i + F.when(a == 1, n_items).otherwise(0)),
        "target_id": lambda: item,
        "part": lambda: known("part"),
        "in_ex": lambda: item,
        "in_cat": lambda: known("part"),
        "in_de": lambda: answers,
        "in_dt": lambda: Q.time_transform(F.col("timestamp")),
        "in_el": lambda: Q.elapsed_transform(known("prior_question_elapsed_time")),
        "in_exp": lambda: known("prior_question_had_explanation"),
        "in_tag": lambda: known("_tags"),
        "in_task": lambda: Q.task_recency(task, "raw"),
        "in_ts": lambda: Q.task_recency(task, "gap"),
        "num_feat": lambda: F.zip_with(known("_te"), Q.running_rate(answers, n_pad), lambda a, b: F.array(a, b)),
        "ts_mask": lambda: Q.attention_mask(task),
    }
    return padded.select(*keys, *[make[f]().alias(f) for f in fields], known("answered_correctly").alias("label"))


def _number(name: str, kind: str) -> int:
    stem = f"Custom{kind}Dataset"
    names = {stem + (str(n) if n > 1 else ""): n for n in DATASETS}
    if name not in names:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(names)}")
    return names[name]


def train_samples(rows: DataFrame, name: str, questions: DataFrame | None = None, te: DataFrame | None = None,
                  max_seq: int = Q.MAX_SEQ, step: int = Q.STEP, method: str = "hash", seed: int = 0,
                  n_items: int = P.N_ITEMS) -> DataFrame:
    """One sample per user (datasets 1-8) or per chunk of ``step`` rows (9-15): (user_id, chunk_id, fields, label).

    ``rows`` are question rows with their part; ``questions`` (question_id,
    tags) is needed for tags, ``te`` (content_id, te_mean) for ``num_feat``.
    Users with one row are dropped; an empty log gives an empty table."""
    names, sampling, tag_pad = DATASETS[_number(name, "Train")]
    fields = names.split()
    rows, fills = _row_values(rows, questions, te, fields, tag_pad)
    cols = _sources(fields)
    if sampling == "user":
        arrays = _padded(user_windows(rows, cols, max_seq, method, seed), cols, max_seq, fills)
    else:
        arrays = Q.random_crop(Q.step_chunks(rows, cols, step), cols, max_seq, method, seed, fills)
    return _fields(arrays, ["user_id", "chunk_id"], fields, max_seq, n_items)


def test_samples(rows: DataFrame, name: str, questions: DataFrame | None = None, te: DataFrame | None = None,
                 max_seq: int = Q.MAX_SEQ, chosen: str = "is_val", n_items: int = P.N_ITEMS) -> DataFrame:
    """One sample per chosen row from the last ``max_seq`` rows of its user: (row_id, fields, label)."""
    names, _, tag_pad = DATASETS[_number(name, "Test")]
    fields = names.split()
    rows, fills = _row_values(rows, questions, te, fields, tag_pad)
    cols = _sources(fields)
    frame = Q._w().rowsBetween(-(max_seq - 1), 0)
    rows = rows.withColumn("_win", F.collect_list(F.struct(*cols)).over(frame))
    rows = Q._real_rows(rows).filter(F.col(chosen) == 1)
    arrays = rows.select("row_id", *[F.transform("_win", Q._field(c)).alias(c) for c in cols])
    return _fields(_padded(arrays, cols, max_seq, fills), ["row_id"], fields, max_seq, n_items)


def flat_samples(rows: DataFrame, name: str, features, label: str = "answered_correctly") -> DataFrame:
    """(row_id, feats, label) of the flat datasets; the second keeps ``content_id`` apart from the features."""
    if name not in ("CustomMlpDataset", "CustomMlpDataset2"):
        raise KeyError(f"unknown dataset {name!r}; known: CustomMlpDataset, CustomMlpDataset2")
    apart = ["content_id"] if name.endswith("2") else []
    feats = F.array(*[F.col(c).cast("double") for c in features if c not in apart])
    return rows.select("row_id", *apart, feats.alias("feats"), F.col(label).alias("label"))
