"""Fixed-length sequence assembly (Q1-Q14) with array columns.

Per-row samples come from a bounded ``ROWS BETWEEN -(n-1) AND 0`` frame
(``collect_list`` of a struct, O(rows x n)), never from a whole-user array.
Per-user arrays (Q2/Q3) are cut into bounded chunks before collection.
Everything after the frame is array arithmetic (``transform``, ``zip_with``,
``slice``) inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.plans import segmented as SG
from tracefeat.plans.joins import dim_join

ORDER = ("timestamp", "row_id")
MAX_SEQ = 101
STEP = 200
# Fill for an unknown item encoding, elapsed fill (seconds) and
# the difftime used for negative gaps, as in the reference's sample builder.
TE_FILL = 0.625164097637492
ELAPSED_FILL_S = 21
NEG_DIFF_MIN = 300
TAG_PAD = 188
USER_CHUNK_ROWS = 100_000


def _field(c: str):
    """A one-argument lambda reading struct field ``c`` (``transform`` counts lambda parameters)."""
    return lambda s: s[c]


def _ordered_struct(cols) -> Column:
    """struct(timestamp, row_id, *cols) without repeated fields; sorts in time order."""
    return F.struct(*[F.col(c) for c in dict.fromkeys([*ORDER, *cols])])


def _w() -> Window:
    """Per-user order; per (user, segment) inside ``segmented_plan()`` (the halo
    must then cover the longest frame, n - 1 rows)."""
    part = ["user_id", "_seg"] if SG.active() else ["user_id"]
    return Window.partitionBy(*part).orderBy(*ORDER)


def _position(df: DataFrame, name: str) -> DataFrame:
    """0-based position of the row in its user's history."""
    if SG.active():
        return df.withColumn(name, F.col("_pos") - 1)
    return df.withColumn(name, F.row_number().over(_w()) - 1)


def _real_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")) if SG.active() else df


def pad_front(arr: Column, n: int, fill) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(arr), F.lit(0))), arr)


def diffs(arr: Column) -> Column:
    n = F.size(arr)
    return F.zip_with(F.slice(arr, 2, F.greatest(n - 1, F.lit(0))), F.slice(arr, 1, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: a - b)


# Q1 ------------------------------------------------------------------------
def last_n_sequence(df: DataFrame, known_cols, answer_cols, n: int = MAX_SEQ, time_col: str | None = "timestamp",
                    chosen: str | None = "is_val", fills: dict[str, Column] | None = None) -> DataFrame:
    """For each chosen row: the last n values per column (this row included),
    left-padded with 0.  Known-now columns keep the latest n-1 (drop the oldest),
    answer columns the n-1 before this row (drop the current), ``time_col`` the
    n-1 successive differences (the first real one against the padding 0).
    The filter on ``chosen`` is applied after the window.  ``fills`` gives the
    padding of a column where it is not 0."""
    fills = fills or {}
    cols = list(dict.fromkeys([*known_cols, *answer_cols, *([time_col] if time_col else [])]))
    st = F.collect_list(F.struct(*[F.col(c).alias(c) for c in cols])).over(_w().rowsBetween(-(n - 1), 0))
    df = df.withColumn("_win", st)
    out = {}
    for c in known_cols:
        out[f"seq_{c}"] = F.slice(pad_front(F.transform("_win", _field(c)), n, fills.get(c, 0)), 2, n - 1)
    for c in answer_cols:
        out[f"seq_{c}"] = F.slice(pad_front(F.transform("_win", _field(c)), n, 0), 1, n - 1)
    if time_col:
        out[f"seq_{time_col}_diff"] = diffs(pad_front(F.transform("_win", lambda s: s[time_col]), n, 0))
    # padding positions of the n-1 known-now slots
    out["seq_n_pad"] = F.lit(n - 1) - F.least(F.size("_win"), F.lit(n - 1))
    df = df.withColumns(out).drop("_win")
    return df.filter(F.col(chosen) == 1) if chosen else df


# Q2 / Q3 -------------------------------------------------------------------
def user_sequences(df: DataFrame, cols, chunk_rows: int = USER_CHUNK_ROWS) -> DataFrame:
    """Arrays per user in time order, cut into chunks of at most ``chunk_rows``
    rows so that no single row or task holds an unbounded history."""
    df = _position(_real_rows(df), "_p")
    df = df.withColumn("chunk_id", F.floor(F.col("_p") / chunk_rows).cast("long"))
    g = df.groupBy("user_id", "chunk_id").agg(
        F.sort_array(F.collect_list(_ordered_struct(cols))).alias("_s"))
    return g.select("user_id", "chunk_id", *[F.transform("_s", _field(c)).alias(c) for c in cols])


def step_chunks(df: DataFrame, cols, step: int = STEP, min_rows: int = 2) -> DataFrame:
    """Chunk k holds positions [k*step, (k+1)*step); a short last chunk (k > 0)
    starts one step earlier.  Users with fewer than ``min_rows`` rows are dropped."""
    df = _position(_real_rows(df), "_p")
    # rows per user by aggregation (partial counts), not a whole-user window
    n = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(n, "user_id").filter(F.col("_n") >= min_rows)
    last_k = F.floor((F.col("_n") - 1) / step)
    short_last = (last_k > 0) & ((F.col("_n") - last_k * step) < step)
    k = F.floor(F.col("_p") / step)
    targets = F.when(short_last & (k == last_k - 1), F.array(k, k + 1)).otherwise(F.array(k))
    e = df.withColumn("chunk_id", F.explode(targets)).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    g = e.groupBy("user_id", "chunk_id").agg(
        F.sort_array(F.collect_list(_ordered_struct(cols))).alias("_s"))
    return g.select("user_id", "chunk_id", *[F.transform("_s", _field(c)).alias(c) for c in cols])


# Q4 ------------------------------------------------------------------------
def crop_draw(method: str = "hash", seed: int = 0) -> Column:
    """A deterministic per-(user, chunk) draw: seeded xxhash64, or the modulus rule
    used by the SQL oracle."""
    if method == "hash":
        return F.pmod(F.xxhash64("user_id", "chunk_id", F.lit(seed)), F.lit(1_000_003))
    return F.pmod(F.col("user_id") * 7919 + F.col("chunk_id") * 104729 + F.lit(seed), F.lit(1_000_003))


def random_crop(chunks: DataFrame, cols, max_seq: int = MAX_SEQ, method: str = "hash", seed: int = 0,
                fills: dict[str, Column] | None = None) -> DataFrame:
    """Chunk >= max_seq rows: a window of max_seq at a drawn start; shorter: a
    drawn prefix of length >= 2, left-padded to max_seq with 0 or what ``fills`` gives."""
    fills = fills or {}
    n = F.size(F.col(cols[0]))
    r = crop_draw(method, seed)
    start = F.when(n >= max_seq, F.pmod(r, n - max_seq + 1) + 1).otherwise(F.lit(1))
    length = F.when(n >= max_seq, F.lit(max_seq)).otherwise(F.pmod(r, F.greatest(n - 1, F.lit(1))) + 2)
    length = F.least(length, n)
    chunks = chunks.withColumns({"_start": start, "_len": length})
    return chunks.withColumns({c: pad_front(F.slice(c, F.col("_start"), F.col("_len")), max_seq, fills.get(c, 0))
                               for c in cols}) \
        .drop("_start", "_len")


# Q5 - Q12, Q14 ---------------------------------------------------------------
def time_transform(ts_arr: Column, neg_fill: float = NEG_DIFF_MIN) -> Column:
    """ms -> minutes, successive differences, negative -> ``neg_fill``, log1p."""
    mins = F.transform(ts_arr, lambda x: x / 60000.0)
    return F.transform(diffs(mins), lambda d: F.log1p(F.when(d < 0, F.lit(float(neg_fill))).otherwise(d)))


def elapsed_transform(el_arr: Column) -> Column:
    """ms -> s, log1p; a missing value becomes log1p(21)."""
    return F.transform(el_arr, lambda x: F.coalesce(F.log1p(x / 1000.0), F.lit(math.log1p(ELAPSED_FILL_S))))


def pad_count(arr: Column, n: int) -> Column:
    return F.lit(n) - F.size(arr)


def running_rate(ans_arr: Column, n_pad: Column) -> Column:
    """Cumulative mean of the answers from the first real position; 0 in padding."""
    return F.transform(ans_arr, lambda x, i: F.when(
        i < n_pad, F.lit(0.0)).otherwise(
        F.aggregate(F.slice(ans_arr, n_pad + 1, i - n_pad + 1), F.lit(0.0), lambda a, y: a + y) / (i - n_pad + 1)))


def with_te(df: DataFrame, te_table: DataFrame, key: str = "content_id", value: str = "te_mean",
            name: str = "te", pad_key=0) -> tuple[DataFrame, dict[str, Column]]:
    """The item encoding as a column of the rows, joined before any sequence is built, and its padding.

    An unknown item gets the fixed fill, a padding position what item
    ``pad_key`` has (a scalar subquery).  ``last_n_sequence`` takes both, so
    nothing is exploded or collected again."""
    t = te_table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    pad = F.coalesce(t.filter(F.col("_k") == pad_key).agg(F.first("_v")).scalar(), F.lit(TE_FILL))
    out = dim_join(df, t, F.col(key) == F.col("_k"), "left")
    return out.withColumn(name, F.coalesce("_v", F.lit(TE_FILL))).drop("_k", "_v"), {name: pad}


def with_tags(df: DataFrame, item_tags: DataFrame, key: str = "content_id", value: str = "tag_list",
              name: str = "item_tags") -> tuple[DataFrame, dict[str, Column]]:
    """The item's 6 padded tags as a column of the rows, and the padding [188]*6 of a sequence of them."""
    t = item_tags.select(F.col(key).alias("_k"), F.col(value).alias(name))
    out = dim_join(df, t, F.col(key) == F.col("_k"), "left").drop("_k")
    return out, {name: F.array_repeat(F.lit(TAG_PAD), 6)}


def task_recency(tasks: Column, form: str = "gap") -> Column:
    """log1p(max task - task) (``gap``) or log1p(task) (``raw``)."""
    if form == "raw":
        return F.transform(tasks, lambda t: F.log1p(t.cast("double")))
    return F.transform(tasks, lambda t: F.log1p((F.array_max(tasks) - t).cast("double")))


def attention_mask(tasks: Column) -> Column:
    """Flattened (n x n) mask: True for future positions or the same task, diagonal False."""
    n = F.size(tasks)
    idx = F.sequence(F.lit(0), n - 1)
    return F.flatten(F.transform(idx, lambda i: F.transform(idx, lambda j: (
        (j > i) | (F.element_at(tasks, i + 1) == F.element_at(tasks, j + 1))) & (i != j))))


def shift_label(prev_answers: Column, current) -> Column:
    """Labels per position: the answers shifted by one plus the current answer."""
    return F.concat(F.slice(prev_answers, 2, F.greatest(F.size(prev_answers) - 1, F.lit(0))),
                    F.array(F.col(current) if isinstance(current, str) else current))


def repeat_in_sequence(items: Column) -> Column:
    """1 where the item already occurs earlier in the sequence."""
    return F.transform(items, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(
        F.array_contains(F.slice(items, 1, F.greatest(i, F.lit(1))), x).cast("int")))


# Q13 -----------------------------------------------------------------------
def last_rows_per_user(df: DataFrame, k: int) -> DataFrame:
    """Each user's last k rows.  In segmented form by position against the user's
    row count (an aggregate), so no user is ranked inside one task."""
    if SG.active():
        real = _real_rows(df)
        last = real.groupBy("user_id").agg(F.max("_pos").alias("_last"))
        return real.join(last, "user_id").filter(F.col("_pos") > F.col("_last") - k).drop("_last")
    wd = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in ORDER])
    return df.withColumn("_r", F.row_number().over(wd)).filter(F.col("_r") <= k).drop("_r")


def online_sequence(history: DataFrame, new_rows: DataFrame, known_cols, answer_cols, n: int = MAX_SEQ,
                    time_col: str = "timestamp") -> DataFrame:
    """One sample per new row from the user's stored state (the last n-1 history
    rows) plus the row itself; rows of the same batch do not see each other."""
    cols = list(dict.fromkeys([*known_cols, *answer_cols, time_col]))
    tail = last_rows_per_user(history, n - 1)
    state = tail.groupBy("user_id").agg(
        F.sort_array(F.collect_list(_ordered_struct(cols))).alias("_h"))
    j = new_rows.join(state, "user_id", "left")
    cur = _ordered_struct(cols)
    empty = F.slice(F.array(cur), 1, 0)          # an empty array of the state's element type
    win = F.concat(F.coalesce(F.col("_h"), empty), F.array(cur))
    j = j.withColumn("_win", win)
    out = {}
    for c in known_cols:
        out[f"seq_{c}"] = F.slice(pad_front(F.transform("_win", _field(c)), n, 0), 2, n - 1)
    for c in answer_cols:
        out[f"seq_{c}"] = F.slice(pad_front(F.transform("_win", _field(c)), n, 0), 1, n - 1)
    out[f"seq_{time_col}_diff"] = diffs(pad_front(F.transform("_win", lambda s: s[time_col]), n, 0))
    return j.withColumns(out).drop("_win", "_h")
