"""DuckDB text of the table binding, shared by every oracle query.

It states the same rules as ``tracefeat.sources.binding`` in a second,
independent dialect: ``log`` (interaction log), ``questions``, ``lectures``,
``qlog`` (log with part/tags/correct_answer on question rows).
"""

BINDING_SQL = """
_ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS _rn,
         CAST(json_extract(props, '$.k') AS INTEGER) AS _k
  FROM events
),
log AS (
  SELECT event_id AS row_id, user_id, epoch_us(ts) // 1000 AS timestamp,
         _k AS content_id,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS content_type_id,
         CAST((_rn - 1) // 3 AS INTEGER) AS task_container_id,
         CAST(CASE WHEN event_type = 'signup' THEN -1 ELSE (event_id % 7) % 4 END AS INTEGER) AS user_answer,
         CASE WHEN event_type = 'signup' THEN -1
              WHEN (event_id % 7) % 4 = _k % 4 THEN 1 ELSE 0 END AS answered_correctly,
         CASE WHEN _rn = 1 OR event_type = 'signup' THEN NULL ELSE round(value * 1000, 0) END
           AS prior_question_elapsed_time,
         CASE WHEN _rn = 1 THEN NULL ELSE event_type = 'view' END AS prior_question_had_explanation
  FROM _ev
),
questions AS (
  SELECT p_partkey AS question_id, CAST(1 + p_size % 7 AS INTEGER) AS part,
         CAST(p_partkey % 4 AS INTEGER) AS correct_answer,
         CASE WHEN p_size % 10 = 0 THEN NULL
              ELSE CAST(p_size AS VARCHAR) || ' '
                   || CAST(60 + CAST(split_part(p_brand, '#', 2) AS INTEGER) AS VARCHAR)
                   || CASE WHEN p_size % 3 = 0 THEN ' ' || CAST(100 + p_partkey % 80 AS VARCHAR) ELSE '' END
         END AS tags
  FROM part
),
lectures AS (
  SELECT p_partkey AS lecture_id, CAST(p_size AS INTEGER) AS tag, CAST(1 + p_size % 7 AS INTEGER) AS part,
         ['concept', 'solving question', 'intention', 'starter'][CAST((p_partkey // 10) % 4 AS INTEGER) + 1]
           AS type_of
  FROM part WHERE p_partkey % 10 = 3
),
qlog AS (
  SELECT l.*, q.part, q.tags, q.correct_answer
  FROM log l LEFT JOIN questions q ON l.content_type_id = 0 AND l.content_id = q.question_id
)"""
