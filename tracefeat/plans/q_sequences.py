"""Registered queries for sequence assembly Q1-Q14 (fixture: MAX_SEQ 21, step 20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefeat.operators import encoders as A
from tracefeat.operators import lookup as L
from tracefeat.operators import prep as P
from tracefeat.operators import sequences as Q
from tracefeat.operators import splits as V
from tracefeat.plans.registry import register
from tracefeat.sources import io
from tracefeat.sources.binding import interaction_log, questions, with_questions

N = 21          # MAX_SEQ on the fixture
STEP = 20
TAIL = ("(SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, "
        "row_id DESC) AS rn FROM log) WHERE rn <= 5)")
W21 = f"PARTITION BY user_id ORDER BY timestamp, row_id ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW"

SQ = f"""
xq AS (SELECT *, CAST(row_id IN {TAIL} AS INTEGER) AS is_val FROM qlog WHERE content_type_id = 0),
sq0 AS (SELECT row_id, user_id, is_val, answered_correctly,
   list(content_id) OVER w AS lc, list(part) OVER w AS lp, list(answered_correctly) OVER w AS la,
   list(timestamp) OVER w AS lt, list(prior_question_elapsed_time) OVER w AS le, list(task_container_id) OVER w AS lk
   FROM xq WINDOW w AS ({W21})),
sq AS (SELECT row_id, user_id, is_val, answered_correctly, len(lc) AS wn, {N - 1} - least(len(lc), {N - 1}) AS npad,
   """ + ",\n   ".join(
    f"list_concat(list_transform(range({N} - len({c})), lambda x: 0), {c}) AS p{c[1]}" for c in
    ("lc", "lp", "la", "lt", "le", "lk")) + f"""
   FROM sq0 WHERE is_val = 1)"""


def _known(p):
    return f"list_slice({p}, 2, {N})"


def _ans(p):
    return f"list_slice({p}, 1, {N - 1})"


def _seq_rows(spark, d, extra_known=(), values=None):
    """Question rows with the tail flag and the Q1 arrays (MAX_SEQ 21); ``values(rows)`` adds columns and their padding."""
    log = V.tail_split(interaction_log(spark, d))
    x = with_questions(log, questions(spark, d)).filter("content_type_id = 0")
    x, fills = values(x) if values else (x, {})
    known = ["content_id", "part", *extra_known, *fills]
    return Q.last_n_sequence(x, known, ["answered_correctly"], N, "timestamp", "is_val", fills)


@register("Q1_last_n_sequence", "row_id:i, seq_content_id:ai, seq_part:ai, seq_answered_correctly:ai, "
          "seq_timestamp_diff:ai", f"""
WITH {SQ}
SELECT row_id, {_known('pc')} AS seq_content_id, {_known('pp')} AS seq_part, {_ans('pa')} AS seq_answered_correctly,
  list_transform(range(1, {N}), lambda i: pt[i + 1] - pt[i]) AS seq_timestamp_diff FROM sq""")
def q_q1(spark, d):
    """For each held-out question row: last 21 items/parts (incl. this row), the 20
    answers before it and 20 time gaps, 0-padded on the left."""
    return _seq_rows(spark, d)


@register("S10_write_sequences", "row_id:i, seq_content_id:ai, seq_answered_correctly:ai", f"""
WITH {SQ} SELECT row_id, {_known('pc')} AS seq_content_id, {_ans('pa')} AS seq_answered_correctly FROM sq""")
def q_s10(spark, d):
    """Q1 samples persisted as one parquet table keyed by row_id, read back."""
    path = io.fresh_path(spark, "sequences")
    _seq_rows(spark, d).select("row_id", "seq_content_id", "seq_answered_correctly").write.parquet(path)
    return spark.read.parquet(path)


_QX = f"""
xq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, row_id) - 1 AS p,
         count(*) OVER (PARTITION BY user_id) AS n FROM qlog WHERE content_type_id = 0)"""


@register("Q2_user_sequences", "user_id:i, chunk_id:i, content_id:ai, answered_correctly:ai", f"""
WITH {_QX}
SELECT user_id, p // 100000 AS chunk_id, list(content_id ORDER BY timestamp, row_id) AS content_id,
  list(answered_correctly ORDER BY timestamp, row_id) AS answered_correctly FROM xq GROUP BY user_id, p // 100000""")
def q_q2(spark, d):
    """Per-user arrays in time order (cut into bounded chunks of 100,000 rows)."""
    x = with_questions(interaction_log(spark, d), questions(spark, d)).filter("content_type_id = 0")
    return Q.user_sequences(x, ["content_id", "answered_correctly"])


_Q3 = f"""
{_QX},
ch AS (SELECT xq.*, unnest(CASE WHEN (n - 1) // {STEP} > 0 AND n - ((n - 1) // {STEP}) * {STEP} < {STEP}
                           AND p // {STEP} = (n - 1) // {STEP} - 1 THEN [p // {STEP}, p // {STEP} + 1]
                           ELSE [p // {STEP}] END) AS chunk_id FROM xq WHERE n >= 2),
q3 AS (SELECT user_id, chunk_id, list(content_id ORDER BY timestamp, row_id) AS content_id,
  list(answered_correctly ORDER BY timestamp, row_id) AS answered_correctly,
  list(task_container_id ORDER BY timestamp, row_id) AS task_container_id FROM ch GROUP BY user_id, chunk_id)"""


def _chunks(spark, d):
    x = with_questions(interaction_log(spark, d), questions(spark, d)).filter("content_type_id = 0")
    return Q.step_chunks(x, ["content_id", "answered_correctly", "task_container_id"], STEP)


@register("Q3_step_chunks", "user_id:i, chunk_id:i, content_id:ai, answered_correctly:ai",
          f"WITH {_Q3} SELECT user_id, chunk_id, content_id, answered_correctly FROM q3")
def q_q3(spark, d):
    """Chunks of 20 positions; a short last chunk starts one step earlier; users with < 2 rows dropped."""
    return _chunks(spark, d)


@register("Q4_random_crop", "user_id:i, chunk_id:i, content_id:ai, answered_correctly:ai", f"""
WITH {_Q3},
r AS (SELECT *, (user_id * 7919 + chunk_id * 104729) % 1000003 AS rr, len(content_id) AS nn FROM q3),
s AS (SELECT *, CASE WHEN nn >= {N} THEN rr % (nn - {N} + 1) + 1 ELSE 1 END AS st,
        least(CASE WHEN nn >= {N} THEN {N} ELSE rr % greatest(nn - 1, 1) + 2 END, nn) AS ln FROM r)
SELECT user_id, chunk_id,
  list_concat(list_transform(range({N} - ln), lambda x: 0), list_slice(content_id, st, st + ln - 1)) AS content_id,
  list_concat(list_transform(range({N} - ln), lambda x: 0), list_slice(answered_correctly, st, st + ln - 1))
    AS answered_correctly FROM s""")
def q_q4(spark, d):
    """Deterministic crop of each chunk to 21 (window) or a drawn prefix >= 2 (modulus draw form)."""
    return Q.random_crop(_chunks(spark, d), ["content_id", "answered_correctly"], N, method="modulus")


@register("Q5_time_transform", "row_id:i, seq_dt:af", f"""
WITH {SQ}
SELECT row_id, list_transform(range(1, {N}), lambda i: ln(1 + CASE WHEN pt[i + 1] / 60000.0 - pt[i] / 60000.0 < 0
  THEN 300 ELSE pt[i + 1] / 60000.0 - pt[i] / 60000.0 END)) AS seq_dt FROM sq""")
def q_q5(spark, d):
    """Minutes, differences, negative -> 300, log1p, over the 21 padded timestamps."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("timestamp", "row_id").rowsBetween(-(N - 1), 0)
    x = _tail_q(spark, d).withColumn("_pts", Q.pad_front(F.collect_list("timestamp").over(w), N, 0))
    return x.filter("is_val = 1").withColumn("seq_dt", Q.time_transform(F.col("_pts")))


def _tail_q(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    return with_questions(log, questions(spark, d)).filter("content_type_id = 0")


@register("Q6_elapsed_transform", "row_id:i, seq_el:af", f"""
WITH {SQ}
SELECT row_id, list_transform({_known('pe')}, lambda x: coalesce(ln(1 + x / 1000.0), ln(22))) AS seq_el FROM sq""")
def q_q6(spark, d):
    """Known-now elapsed times: ms -> s, log1p, missing -> log1p(21)."""
    s = Q.last_n_sequence(_tail_q(spark, d), ["prior_question_elapsed_time"], [], N, None, "is_val")
    return s.withColumn("seq_el", Q.elapsed_transform(F.col("seq_prior_question_elapsed_time")))


@register("Q7_running_rate_in_sequence", "row_id:i, seq_rate:af", f"""
WITH {SQ}
SELECT row_id, list_transform(range(0, {N - 1}), lambda i: CASE WHEN i < npad THEN 0.0
  ELSE list_sum(list_slice({_ans('pa')}, npad + 1, i + 1)) / (i - npad + 1) END) AS seq_rate FROM sq""")
def q_q7(spark, d):
    """Cumulative mean of the previous answers from the first real position, 0 in padding."""
    s = _seq_rows(spark, d)
    return s.withColumn("seq_rate", Q.running_rate(F.col("seq_answered_correctly"), F.col("seq_n_pad")))


@register("Q8_te_in_sequence", "row_id:i, seq_te:af", f"""
WITH {SQ},
tr AS (SELECT row_id, row_id % 5 AS fold, content_id, answered_correctly AS t FROM log
  WHERE row_id NOT IN {TAIL}),
fs AS (SELECT content_id, fold, sum(t) AS s, count(t) AS n FROM tr GROUP BY content_id, fold),
tot AS (SELECT content_id, sum(t) AS S, count(t) AS N FROM tr GROUP BY content_id),
g AS (SELECT tot.content_id, f.fold, tot.S, tot.N FROM tot, (SELECT range AS fold FROM range(5)) f),
enc AS (SELECT g.content_id, avg((g.S - coalesce(fs.s, 0)) / (g.N - coalesce(fs.n, 0))) AS te_mean FROM g
        LEFT JOIN fs ON g.content_id = fs.content_id AND g.fold = fs.fold WHERE g.N - coalesce(fs.n, 0) > 0
        GROUP BY g.content_id),
u AS (SELECT row_id, unnest({_known('pc')}) AS content_id, generate_subscripts({_known('pc')}, 1) AS pos FROM sq)
SELECT u.row_id, list(coalesce(enc.te_mean, {Q.TE_FILL!r}) ORDER BY pos) AS seq_te
FROM u LEFT JOIN enc USING (content_id) GROUP BY u.row_id""")
def q_q8(spark, d):
    """Per position the item's mean fold encoding (A6), unknown -> the fixed fill."""
    log = V.tail_split(interaction_log(spark, d))
    tr = V.kfold(log.filter("is_val = 0"), 5, method="modulus")
    te = A.encoder_mean_table(A.fold_encoders(tr, "content_id", "answered_correctly", 5), "content_id")
    return _seq_rows(spark, d, values=lambda x: Q.with_te(x, te))


_TAGS_SQL = ("list_concat(list_transform(range(greatest(6 - len(coalesce(list_transform(string_split(tags, ' '), "
             "lambda x: CAST(x AS INTEGER)), [0])), 0)), lambda x: 188), coalesce(list_transform(string_split(tags, "
             "' '), lambda x: CAST(x AS INTEGER)), [0]))")


@register("Q9_tag_matrix", "row_id:i, seq_tags:ai", f"""
WITH {SQ},
u AS (SELECT row_id, npad, unnest({_known('pc')}) AS content_id, generate_subscripts({_known('pc')}, 1) - 1 AS pos
      FROM sq),
t AS (SELECT question_id AS content_id, {_TAGS_SQL} AS tag_list FROM questions)
SELECT u.row_id, flatten(list(CASE WHEN pos < npad THEN [188, 188, 188, 188, 188, 188] ELSE t.tag_list END
  ORDER BY pos)) AS seq_tags
FROM u LEFT JOIN t USING (content_id) GROUP BY u.row_id""")
def q_q9(spark, d):
    """6 tags per position (left-padded with 188, tag-less -> 0), padding positions all 188."""
    tags = questions(spark, d).select(F.col("question_id").alias("content_id"),
                                      P.tag_array("tags", 188, 0).alias("tag_list"))
    s = _seq_rows(spark, d, values=lambda x: Q.with_tags(x, tags))
    return s.withColumn("seq_tags", F.flatten("seq_item_tags"))


@register("Q10_task_recency", "row_id:i, seq_task_gap:af, seq_task_raw:af", f"""
WITH {SQ}
SELECT row_id, list_transform({_known('pk')}, lambda t: ln(1 + CAST(list_max({_known('pk')}) - t AS DOUBLE)))
    AS seq_task_gap,
  list_transform({_known('pk')}, lambda t: ln(1 + CAST(t AS DOUBLE))) AS seq_task_raw FROM sq""")
def q_q10(spark, d):
    s = _seq_rows(spark, d, ["task_container_id"])
    return s.withColumns({"seq_task_gap": Q.task_recency(F.col("seq_task_container_id"), "gap"),
                          "seq_task_raw": Q.task_recency(F.col("seq_task_container_id"), "raw")})


@register("Q11_attention_mask", "row_id:i, seq_mask:ai", f"""
WITH {SQ}, m AS (SELECT row_id, {_known('pk')} AS k FROM sq)
SELECT row_id, flatten(list_transform(range(0, {N - 1}), lambda i: list_transform(range(0, {N - 1}),
  lambda j: CAST((j > i OR k[i + 1] = k[j + 1]) AND i <> j AS INTEGER)))) AS seq_mask FROM m""")
def q_q11(spark, d):
    """(n-1) x (n-1) mask, flattened: future positions or same task, diagonal off."""
    s = _seq_rows(spark, d, ["task_container_id"])
    return s.withColumn("seq_mask", F.transform(Q.attention_mask(F.col("seq_task_container_id")),
                                                lambda b: b.cast("int")))


@register("Q12_shift_label", "row_id:i, seq_label:ai",
          f"WITH {SQ} SELECT row_id, list_concat(list_slice({_ans('pa')}, 2, {N - 1}), [answered_correctly]) "
          "AS seq_label FROM sq")
def q_q12(spark, d):
    """Labels: the previous answers shifted by one plus the current answer."""
    s = _seq_rows(spark, d)
    return s.withColumn("seq_label", Q.shift_label(F.col("seq_answered_correctly"), "answered_correctly"))


@register("Q13_online_sequence", "row_id:i, seq_content_id:ai, seq_answered_correctly:ai, seq_timestamp_diff:ai", f"""
WITH xq AS (SELECT *, CAST(row_id IN {TAIL} AS INTEGER) AS is_val FROM qlog WHERE content_type_id = 0),
hs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, row_id DESC) AS rr
        FROM xq WHERE is_val = 0) WHERE rr <= {N - 1}),
st AS (SELECT user_id, list(content_id ORDER BY timestamp, row_id) AS hc,
         list(answered_correctly ORDER BY timestamp, row_id) AS ha, list(timestamp ORDER BY timestamp, row_id) AS ht
       FROM hs GROUP BY user_id),
nw AS (SELECT n.row_id, list_append(coalesce(st.hc, []), n.content_id) AS lc,
         list_append(coalesce(st.ha, []), n.answered_correctly) AS la, list_append(coalesce(st.ht, []), n.timestamp) AS lt
       FROM xq n LEFT JOIN st USING (user_id) WHERE n.is_val = 1),
pd AS (SELECT row_id, """ + ", ".join(
    f"list_concat(list_transform(range({N} - len({c})), lambda x: 0), {c}) AS p{c[1]}" for c in ("lc", "la", "lt"))
          + f""" FROM nw)
SELECT row_id, {_known('pc')} AS seq_content_id, {_ans('pa')} AS seq_answered_correctly,
  list_transform(range(1, {N}), lambda i: pt[i + 1] - pt[i]) AS seq_timestamp_diff FROM pd""")
def q_q13(spark, d):
    """Samples for a new batch from each user's stored last 20 history rows plus the row itself."""
    x = _tail_q(spark, d)
    return Q.online_sequence(x.filter("is_val = 0"), x.filter("is_val = 1"), ["content_id"], ["answered_correctly"], N)


@register("Q14_repeat_in_sequence", "row_id:i, seq_repeat:ai", f"""
WITH {SQ}, m AS (SELECT row_id, {_known('pc')} AS c FROM sq)
SELECT row_id, list_transform(range(0, {N - 1}), lambda i: CASE WHEN i = 0 THEN 0
  ELSE CAST(list_contains(list_slice(c, 1, i), c[i + 1]) AS INTEGER) END) AS seq_repeat FROM m""")
def q_q14(spark, d):
    s = _seq_rows(spark, d)
    return s.withColumn("seq_repeat", Q.repeat_in_sequence(F.col("seq_content_id")))


# Datasets by name ------------------------------------------------------------
def _sample_sql(key: str, tag_pad: int, te: bool) -> str:
    """CTEs over ``sa`` (key, npad, and the padded arrays pc, pp, pa, pt, pe, pk) with tags and item encodings per position."""
    tags = _TAGS_SQL.replace("lambda x: 188)", f"lambda x: {tag_pad})")
    enc = f"""
tr AS (SELECT row_id, row_id % 5 AS fold, content_id, answered_correctly AS t FROM log WHERE row_id NOT IN {TAIL}),
fs AS (SELECT content_id, fold, sum(t) AS s, count(t) AS n FROM tr GROUP BY content_id, fold),
tot AS (SELECT content_id, sum(t) AS S, count(t) AS N FROM tr GROUP BY content_id),
g AS (SELECT tot.content_id, f.fold, tot.S, tot.N FROM tot, (SELECT range AS fold FROM range(5)) f),
enc AS (SELECT g.content_id, avg((g.S - coalesce(fs.s, 0)) / (g.N - coalesce(fs.n, 0))) AS te_mean FROM g
        LEFT JOIN fs ON g.content_id = fs.content_id AND g.fold = fs.fold WHERE g.N - coalesce(fs.n, 0) > 0
        GROUP BY g.content_id),""" if te else "enc AS (SELECT 0 AS content_id, 0.0 AS te_mean),"
    return f"""{enc}
tg AS (SELECT question_id AS content_id, {tags} AS tag_list FROM questions),
u AS (SELECT {key}, npad, unnest({_known('pc')}) AS content_id, generate_subscripts({_known('pc')}, 1) - 1 AS pos FROM sa),
per AS (SELECT {key}, flatten(list(CASE WHEN pos < npad THEN [188, 188, 188, 188, 188, 188] ELSE tg.tag_list END
    ORDER BY pos)) AS in_tag,
    list(CASE WHEN pos < npad THEN 0.0 ELSE coalesce(enc.te_mean, {Q.TE_FILL!r}) END ORDER BY pos) AS num_te
  FROM u LEFT JOIN tg USING (content_id) LEFT JOIN enc USING (content_id) GROUP BY {key})"""


_SAMPLE_FIELDS = {
    "in_ex": _known("pc"), "in_cat": _known("pp"), "in_de": _ans("pa"), "label": _known("pa"), "in_exp": _known("px"),
    "in_dt": f"list_transform(range(1, {N}), lambda i: ln(1 + CASE WHEN pt[i + 1] / 60000.0 - pt[i] / 60000.0 < 0 "
             "THEN 300 ELSE pt[i + 1] / 60000.0 - pt[i] / 60000.0 END))",
    "in_el": f"list_transform({_known('pe')}, lambda x: coalesce(ln(1 + x / 1000.0), ln(22)))",
    "in_ts": f"list_transform({_known('pk')}, lambda t: ln(1 + CAST(list_max({_known('pk')}) - t AS DOUBLE)))",
    "in_task": f"list_transform({_known('pk')}, lambda t: ln(1 + CAST(t AS DOUBLE)))",
    "num_rate": f"list_transform(range(0, {N - 1}), lambda i: CASE WHEN i < npad THEN 0.0 "
                f"ELSE list_sum(list_slice({_ans('pa')}, npad + 1, i + 1)) / (i - npad + 1) END)",
    "ts_mask": f"flatten(list_transform(range(0, {N - 1}), lambda i: list_transform(range(0, {N - 1}), lambda j: "
               f"CAST((j > i OR {_known('pk')}[i + 1] = {_known('pk')}[j + 1]) AND i <> j AS INTEGER))))",
    "in_tag": "in_tag", "num_te": "num_te"}
_KINDS = {"in_dt": "af", "in_el": "af", "in_ts": "af", "in_task": "af", "num_te": "af", "num_rate": "af"}
_ARRAYS = {"pc": "content_id", "pp": "part", "pa": "answered_correctly", "pt": "timestamp",
           "pe": "prior_question_elapsed_time", "pk": "task_container_id", "px": "explained"}
_D15 = ("in_ex", "in_dt", "in_el", "in_tag", "in_cat", "in_de", "in_ts", "num_te", "num_rate", "ts_mask", "label")
_D7 = ("in_ex", "in_task", "in_dt", "in_el", "in_tag", "in_exp", "in_cat", "in_de", "label")
_XS = (f"xs AS (SELECT *, CAST(row_id IN {TAIL} AS INTEGER) AS is_val, "
       "CAST(coalesce(prior_question_had_explanation, false) AS INTEGER) AS explained, "
       "row_number() OVER (PARTITION BY user_id ORDER BY timestamp, row_id) - 1 AS p, "
       "count(*) OVER (PARTITION BY user_id) AS n FROM qlog WHERE content_type_id = 0)")


def _lists(tail: str) -> str:
    return ", ".join(f"list({c} {tail} AS l{p}" for p, c in _ARRAYS.items())


def _pads(size: str, cut: str = "l{p}") -> str:
    return ", ".join(f"list_concat(list_transform(range({N} - {size}), lambda x: 0), {cut.format(p=p)}) AS {p}"
                     for p in _ARRAYS)


def _sample_spec(keys, fields):
    return ", ".join([*[f"{k}:i" for k in keys], *[f"{f}:{_KINDS.get(f, 'ai')}" for f in fields]])


def _sample_select(keys, fields):
    return (f"SELECT {', '.join(keys)}, " + ", ".join(f"{_SAMPLE_FIELDS[f]} AS {f}" for f in fields)
            + f" FROM sa JOIN per USING ({', '.join(keys)})")


_TEST15 = f"""
WITH {_XS},
w0 AS (SELECT row_id, is_val, {_lists(') OVER w')} FROM xs WINDOW w AS ({W21})),
sa AS (SELECT row_id, {N - 1} - least(len(lpc), {N - 1}) AS npad, {_pads('len(lpc)')} FROM w0 WHERE is_val = 1),
{_sample_sql('row_id', 188, True)}
{_sample_select(['row_id'], _D15)}"""

_TRAIN15 = f"""
WITH {_XS},
ch AS (SELECT xs.*, unnest(CASE WHEN (n - 1) // {STEP} > 0 AND n - ((n - 1) // {STEP}) * {STEP} < {STEP}
         AND p // {STEP} = (n - 1) // {STEP} - 1 THEN [p // {STEP}, p // {STEP} + 1] ELSE [p // {STEP}] END) AS chunk_id
       FROM xs WHERE n >= 2),
w0 AS (SELECT user_id, chunk_id, {_lists('ORDER BY timestamp, row_id)')} FROM ch GROUP BY user_id, chunk_id),
r AS (SELECT *, (user_id * 7919 + chunk_id * 104729) % 1000003 AS rr, len(lpc) AS nn FROM w0),
s AS (SELECT *, CASE WHEN nn >= {N} THEN rr % (nn - {N} + 1) + 1 ELSE 1 END AS st,
        least(CASE WHEN nn >= {N} THEN {N} ELSE rr % greatest(nn - 1, 1) + 2 END, nn) AS ln FROM r),
sa AS (SELECT user_id, chunk_id, {N - 1} - least(ln, {N - 1}) AS npad,
         {_pads('ln', 'list_slice(l{p}, st, st + ln - 1)')} FROM s),
{_sample_sql('user_id, chunk_id', 188, True)}
{_sample_select(['user_id', 'chunk_id'], _D15)}"""

_TRAIN7 = f"""
WITH {_XS},
d AS (SELECT *, (user_id * 7919) % 1000003 AS rr FROM xs WHERE n >= 2),
e AS (SELECT *, CASE WHEN n < {N} THEN 0 WHEN rr % 10 <> 0 THEN rr % (n - {N} + 1) ELSE n - {N} END AS st,
        CASE WHEN n >= {N} THEN {N} WHEN rr % 10 <> 0 THEN rr % (n - 1) + 2 ELSE n END AS ln FROM d),
w0 AS (SELECT user_id, 0 AS chunk_id, {_lists('ORDER BY timestamp, row_id)')} FROM e WHERE p >= st AND p < st + ln
       GROUP BY user_id),
sa AS (SELECT user_id, chunk_id, {N - 1} - least(len(lpc), {N - 1}) AS npad, {_pads('len(lpc)')} FROM w0),
{_sample_sql('user_id, chunk_id', 0, False)}
{_sample_select(['user_id', 'chunk_id'], _D7)}"""


def _flat_fields(out):
    """Nested fields as the flat arrays that are compared: tags and mask in one row, the two numbers apart."""
    cols = set(out.columns)
    if "num_feat" in cols:
        out = out.withColumns({"num_te": F.transform("num_feat", lambda v: v[0]),
                               "num_rate": F.transform("num_feat", lambda v: v[1])})
    if "ts_mask" in cols:
        out = out.withColumn("ts_mask", F.transform("ts_mask", lambda b: b.cast("int")))
    return out.withColumn("in_tag", F.flatten("in_tag"))


def _dataset_inputs(spark, d):
    log = V.tail_split(interaction_log(spark, d))
    tr = V.kfold(log.filter("is_val = 0"), 5, method="modulus")
    te = A.encoder_mean_table(A.fold_encoders(tr, "content_id", "answered_correctly", 5), "content_id")
    return _tail_q(spark, d), questions(spark, d), te


@register("H6_dataset_train15", _sample_spec(["user_id", "chunk_id"], _D15), _TRAIN15)
def q_h6(spark, d):
    """The training samples found by the name CustomTrainDataset15: drawn windows of 21 in chunks of 20."""
    x, q, te = _dataset_inputs(spark, d)
    return _flat_fields(L.dataset(x, "CustomTrainDataset15", questions=q, te=te, max_seq=N, step=STEP, method="modulus"))


@register("H6b_dataset_test15", _sample_spec(["row_id"], _D15), _TEST15)
def q_h6b(spark, d):
    """The validation samples found by the name CustomTestDataset15, one a held-out row."""
    x, q, te = _dataset_inputs(spark, d)
    return _flat_fields(L.dataset(x, "CustomTestDataset15", questions=q, te=te, max_seq=N))


@register("H6c_dataset_train7", _sample_spec(["user_id", "chunk_id"], _D7), _TRAIN7)
def q_h6c(spark, d):
    """The training samples found by the name CustomTrainDataset7: one drawn window a user."""
    x = _tail_q(spark, d)
    return _flat_fields(L.dataset(x, "CustomTrainDataset7", questions=questions(spark, d), max_seq=N, method="modulus"))
