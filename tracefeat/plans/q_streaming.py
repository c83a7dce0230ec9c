"""Registered queries for the streaming operators K1-K6.

Each query replays the fixture log as a stream of micro-batches (groups of
500 row ids, answers one group late), runs the streaming job to completion
with ``availableNow`` into a parquet sink under the shared scratch folder, and
returns the sink's content.  The oracles state the batch semantics the stream
must reproduce: a row of group g sees exactly the rows of groups < g.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tracefeat.sources import io
from tracefeat.sources.binding import interaction_log
from tracefeat.streaming import aggregates as K
from tracefeat.streaming import events as EV
from tracefeat.streaming import replay as R
from tracefeat.streaming.labels import match_label_lists, with_matched_labels
from tracefeat.streaming.user_state import online_user_features
from tracefeat.plans.registry import register
from tracefeat.session import cut_lineage

N_SEQ = 21


def _replay(spark, d):
    root = io.fresh_path(spark, "stream")
    src = os.path.join(root, "events")
    EV.write_microbatches(EV.event_frame(cut_lineage(interaction_log(spark, d))), src)   # every chunk reads the log
    return root, EV.read_events(spark, src)


def _event_time_replay(spark, d):
    """The log's rows in chunks by event time, one a trigger, behind the router of late rows; a far control
    event at the end closes the last windows."""
    root = io.fresh_path(spark, "stream")
    rows = EV.event_frame(interaction_log(spark, d)).filter("kind = 'row'")
    src, on_time = os.path.join(root, "events"), os.path.join(root, "on_time")
    R.write_chunks(R.time_chunks(rows), "chunk", src)
    R.route_late(R.read_chunks(spark, src, EV.EVENT_SCHEMA), root)
    newest = spark.read.schema("batch_id long, newest long").parquet(os.path.join(root, "clock")).agg(F.max("newest")).first()[0]
    K.end_marker(spark, on_time, 0, int(newest or 0) + 30 * 86_400_000)
    return root, R.read_chunks(spark, on_time, EV.EVENT_SCHEMA)


def _list_replay(spark, d):
    """Rows and answer lists in order of arrival, whole groups together, with the watermark on the arrival time."""
    root = io.fresh_path(spark, "stream")
    src = os.path.join(root, "events")
    R.write_chunks(R.arrival_chunks(EV.list_frame(cut_lineage(interaction_log(spark, d)))), "chunk", src)
    return root, R.read_chunks(spark, src, EV.EVENT_SCHEMA).withWatermark("arrival_ts", "1 minute")


def _run(spark, df, root, name, mode="append"):
    out = os.path.join(root, name)
    K.run_to_parquet(df, out, os.path.join(root, f"_ckpt_{name}"), mode)
    return spark.read.parquet(out)


_GRP = "row_id // 500"
_BEFORE = "PARTITION BY user_id ORDER BY grp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


_K1_SPEC = "row_id:i, group_num:i, u_cnt:i, u_corr_cnt:i, u_corr_rate:f, u_hist_lec_cnt:i"
_K1_SQL = f"""
WITH g AS (SELECT *, {_GRP} AS grp FROM log),
f AS (SELECT row_id, grp AS group_num, content_type_id,
  coalesce(sum(CASE WHEN content_type_id = 0 THEN 1 ELSE 0 END) OVER ({_BEFORE}), 0) AS u_cnt,
  coalesce(sum(CASE WHEN content_type_id = 0 THEN answered_correctly ELSE 0 END) OVER ({_BEFORE}), 0) AS u_corr_cnt,
  coalesce(sum(CASE WHEN content_type_id = 1 THEN 1 ELSE 0 END) OVER ({_BEFORE}), 0) AS u_hist_lec_cnt FROM g)
SELECT row_id, group_num, u_cnt, u_corr_cnt, u_corr_cnt / nullif(u_cnt, 0) AS u_corr_rate, u_hist_lec_cnt
FROM f WHERE content_type_id = 0"""


@register("K1_stream_user_features", _K1_SPEC, _K1_SQL)
def q_k1(spark, d):
    """Streamed: counters of each question row read before the row's group is folded in."""
    root, ev = _replay(spark, d)
    return _run(spark, online_user_features(ev, N_SEQ), root, "k1").filter("kind = 'feature'")


@register("K2_stream_label_update", "group_num:i, row_id:i, user_id:i, answered_correctly:i, user_answer:i", f"""
SELECT {_GRP} + 1 AS group_num, row_id, user_id, answered_correctly, user_answer FROM log""")
def q_k2(spark, d):
    """Streamed: answers sent as one JSON list per group, met with the buffered rows of the group before."""
    root, ev = _list_replay(spark, d)
    return _run(spark, match_label_lists(ev), root, "k2").filter("kind = 'label'")


@register("K2_list_fed_features", _K1_SPEC, _K1_SQL)
def q_k2_features(spark, d):
    """Streamed: K1 fed by answer lists; the label operator and the user operator run in one query."""
    root, ev = _list_replay(spark, d)
    return _run(spark, online_user_features(with_matched_labels(ev), N_SEQ, delay=None), root, "k2f") \
        .filter("kind = 'feature'")


@register("K3_stream_sequences", "row_id:i, seq_content_id:ai, seq_answered_correctly:ai, seq_timestamp_diff:ai", f"""
WITH q AS (SELECT *, {_GRP} AS grp FROM log WHERE content_type_id = 0),
h AS (SELECT c.row_id, p.content_id, p.answered_correctly, p.timestamp, p.row_id AS prow,
        row_number() OVER (PARTITION BY c.row_id ORDER BY p.timestamp DESC, p.row_id DESC) AS rr
      FROM q c JOIN q p ON p.user_id = c.user_id AND p.grp < c.grp),
st AS (SELECT row_id, list(content_id ORDER BY timestamp, prow) AS hc, list(answered_correctly ORDER BY timestamp, prow)
         AS ha, list(timestamp ORDER BY timestamp, prow) AS ht FROM h WHERE rr <= {N_SEQ - 1} GROUP BY row_id),
nw AS (SELECT q.row_id, list_append(coalesce(st.hc, []), q.content_id) AS lc, coalesce(st.ha, []) AS la,
         list_append(coalesce(st.ht, []), q.timestamp) AS lt FROM q LEFT JOIN st USING (row_id)),
pd AS (SELECT row_id, list_concat(list_transform(range({N_SEQ} - len(lc)), lambda x: 0), lc) AS pc,
         list_concat(list_transform(range({N_SEQ - 1} - len(la)), lambda x: 0), la) AS pa,
         list_concat(list_transform(range({N_SEQ} - len(lt)), lambda x: 0), lt) AS pt FROM nw)
SELECT row_id, list_slice(pc, 2, {N_SEQ}) AS seq_content_id, pa AS seq_answered_correctly,
  list_transform(range(1, {N_SEQ}), lambda i: pt[i + 1] - pt[i]) AS seq_timestamp_diff FROM pd""")
def q_k3(spark, d):
    """Streamed: last-20 sequences per question row from the user's state of earlier groups."""
    root, ev = _replay(spark, d)
    return _run(spark, online_user_features(ev, N_SEQ), root, "k3").filter("kind = 'feature'")


@register("K4_stream_sessions", "user_id:i, session_start:i, session_end:i, n_rows:i", """
WITH b AS (SELECT user_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id
             ORDER BY timestamp, row_id) <= 43200000 THEN 0 ELSE 1 END AS brk FROM log WHERE content_type_id = 0),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS sid FROM b)
SELECT user_id, min(timestamp) AS session_start, max(timestamp) + 43200000 AS session_end, count(*) AS n_rows
FROM s GROUP BY user_id, sid""")
def q_k4(spark, d):
    """Streamed session windows (gaps above 12 h) with a watermark; question rows per session."""
    root, ev = _event_time_replay(spark, d)
    return _run(spark, K.stream_sessions(ev), root, "k4").filter("user_id >= 0")


@register("K4_late_events", "row_id:i, batch:i, behind_ms:i", f"""
WITH e AS (SELECT row_id, timestamp, {_GRP} AS grp, 'row' AS kind FROM log
           UNION ALL SELECT row_id, timestamp, {_GRP} + 1, 'label' FROM log),
c AS (SELECT row_id, timestamp, kind, grp // greatest(CAST(ceil((max(grp) OVER () + 1) / 4.0) AS BIGINT), 1) AS batch FROM e),
m AS (SELECT batch, max(timestamp) AS newest FROM c GROUP BY batch),
w AS (SELECT c.row_id, c.batch, (SELECT max(newest) FROM m WHERE m.batch < c.batch) - 1000 - c.timestamp AS behind_ms FROM c)
SELECT row_id, batch, behind_ms FROM w WHERE behind_ms > 0""")
def q_k4_late(spark, d):
    """Streamed side output: events that reach the loop more than a second of event time behind the newest of the
    earlier micro-batches (here the answers that arrive in a later chunk than their rows)."""
    root = io.fresh_path(spark, "stream")
    src = os.path.join(root, "events")
    R.write_chunks(R.arrival_chunks(EV.event_frame(interaction_log(spark, d))), "chunk", src)
    R.route_late(R.read_chunks(spark, src, EV.EVENT_SCHEMA), root, delay_ms=1000)
    return R.late_rows(spark, root, EV.EVENT_SCHEMA)


@register("K5_stream_encoder_refresh", "content_id:i, content_id_count:i",
          "SELECT content_id, count(*) AS content_id_count FROM log GROUP BY content_id")
def q_k5(spark, d):
    """Item counts merged per micro-batch via foreachBatch (exactly-once per batch id)."""
    root, ev = _replay(spark, d)
    table = os.path.join(root, "encoder")
    K.refresh_encoder(ev, table, os.path.join(root, "_ckpt_k5"))
    return K.read_encoder(spark, table)


@register("K6_stream_windowed_counts", "window_start:i, window_end:i, content_type_id:i, n_rows:i", """
WITH e AS (SELECT content_type_id, timestamp - (timestamp % 21600000) - k * 21600000 AS ws
           FROM log, (SELECT range AS k FROM range(4)) r)
SELECT ws AS window_start, ws + 86400000 AS window_end, content_type_id, count(*) AS n_rows
FROM e GROUP BY ws, content_type_id""")
def q_k6(spark, d):
    """Sliding 1-day windows every 6 h of row counts by content type, with a watermark."""
    root, ev = _event_time_replay(spark, d)
    return _run(spark, K.windowed_counts(ev), root, "k6").filter("content_type_id IS NOT NULL")
