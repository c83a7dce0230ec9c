"""Registry of named queries: Spark builder + output spec + optional DuckDB oracle.

Both sides are normalised from one spec so that names, types and rounding
agree: ``i`` bigint, ``f`` double rounded to 6 places, ``f4``/``f2`` rounded to 4/2 (large magnitudes such as ms gaps),
``s`` text, ``ai``/``af`` int/float arrays written as comma text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.functions.columns import array_text


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: list[tuple[str, str]]
    sql: str | None = None
    doc: str = ""
    tags: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize(self.build(spark, sf_dir), self.spec)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return wrap_oracle(self.sql, self.spec)


REGISTRY: dict[str, Query] = {}

# Rounding is spelled out as round(x * 10^d) / 10^d on both sides: the product
# and the quotient are the same IEEE operations in both engines, and rounding
# a double to an integer (half away from zero) agrees, so near-ties cannot
# round apart as they can with each engine's own round(x, d).
_DIGITS = {"f": 6, "f4": 4, "f2": 2}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        name, kind = part.split(":")
        out.append((name.strip(), kind.strip()))
    return out


def register(name: str, spec: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        REGISTRY[name] = Query(name, fn, parse_spec(spec), sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def normalize(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind in ("f", "f4", "f2"):
            scale = float(10 ** _DIGITS[kind])
            c = F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale)
        elif kind == "s":
            c = c.cast("string")
        elif kind == "ai":
            c = array_text(c, "int")
        elif kind == "af":
            c = array_text(c, "float")
        else:
            raise ValueError(kind)
        cols.append(c.alias(name))
    return df.select(*cols)


def _sql_expr(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind in ("f", "f4", "f2"):
        scale = 10 ** _DIGITS[kind]
        return f"round(CAST({q} AS DOUBLE) * CAST({scale} AS DOUBLE)) / CAST({scale} AS DOUBLE) AS {q}"
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    if kind == "ai":
        return f"array_to_string(list_transform({q}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS {q}"
    if kind == "af":
        return (f"array_to_string(list_transform({q}, lambda x: printf('%.6f', round(CAST(x AS DOUBLE), 6))), ',')"
                f" AS {q}")
    raise ValueError(kind)


def wrap_oracle(body: str, spec: list[tuple[str, str]]) -> str:
    from tracefeat.plans.oracle import BINDING_SQL
    exprs = ",\n  ".join(_sql_expr(n, k) for n, k in spec)
    return f"WITH {BINDING_SQL}\nSELECT\n  {exprs}\nFROM (\n{body}\n) AS _q"
