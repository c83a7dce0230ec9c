"""DuckDB SQL of the vector codes: every part compared with every entry, round by round."""

from __future__ import annotations

from tracefeat.llm.codes import ENTRIES, PARTS, ROUNDS


def _assigned(books: str) -> str:
    """Nearest entry of every (vector, part): ties to the lower index."""
    return f"""SELECT rid, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
  SELECT x.rid, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k])))
    AS d FROM part x JOIN {books} b ON x.p = b.p) GROUP BY rid, p"""


def _sql() -> str:
    ctes = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))
  AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
            f"""part AS (SELECT rid, p, list_slice(x, CAST(p * len(x) // {PARTS} + 1 AS BIGINT),
  CAST((p + 1) * len(x) // {PARTS} AS BIGINT)) AS v FROM kept, (SELECT range AS p FROM range({PARTS})) r)""",
            f"b0 AS (SELECT p, rid - 1 AS e, v FROM part WHERE rid <= {ENTRIES})"]
    for k in range(ROUNDS):
        ctes.append(f"a{k} AS ({_assigned(f'b{k}')})")
        ctes.append(f"""m{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY q) AS v FROM (
  SELECT a.p, a.e, u.q, count(*) AS n, CAST(sum(x.v[u.q]) AS DOUBLE) AS s FROM a{k} a JOIN part x ON a.rid = x.rid AND a.p = x.p,
    (SELECT range AS q FROM range(1, (SELECT CAST(max(len(v)) AS BIGINT) + 1 FROM part))) u GROUP BY a.p, a.e, u.q)
  GROUP BY p, e)""")
        ctes.append(f"""b{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m
  ON b.p = m.p AND b.e = m.e)""")
    ctes.append(f"f AS ({_assigned(f'b{ROUNDS}')})")
    ctes.append("""coded AS (SELECT rid, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM (SELECT rid, p, CAST(e AS BIGINT) AS e, d FROM f) GROUP BY rid)""")
    ctes.append(f"""sha AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: CAST(c AS VARCHAR)), ','), ','
  ORDER BY p, e)) AS h FROM b{ROUNDS})""")
    return "WITH " + ",\n".join(ctes) + """
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT h FROM sha) AS codebooks_sha256
FROM kept k JOIN coded c USING (rid)"""


SQL = _sql()
