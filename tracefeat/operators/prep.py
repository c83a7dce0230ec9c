"""Row-level projections, filters and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefeat.functions.columns import col, nan_key, pad_left, parse_tags
from tracefeat.plans.joins import MAX_BROADCAST_ROWS, dim_join
from tracefeat.sources.binding import LECTURE_TYPES

# Padding tags of the sequence variants and the reference item count.
TAG_PAD_ZERO = 0
TAG_PAD_188 = 188
TAG_PAD_189 = 189
N_TAG_SLOTS = 6
N_ITEMS = 13523


# P1 ------------------------------------------------------------------------
def base_features(df: DataFrame) -> DataFrame:
    """Pass-through log columns; the nullable boolean becomes a double (NULL kept)."""
    return df.select("row_id", "user_id", "timestamp", "content_id", "content_type_id", "task_container_id",
                     "prior_question_elapsed_time",
                     F.col("prior_question_had_explanation").cast("double").alias("prior_question_had_explanation"))


# P2 ------------------------------------------------------------------------
def drop_lectures(df: DataFrame) -> DataFrame:
    return df.filter(F.col("content_type_id") == 0)


# P3 ------------------------------------------------------------------------
def composite_key(*cols, sep: str = "_") -> Column:
    """'a_b' text key; a missing part is the text 'nan' and forms its own group."""
    return F.concat_ws(sep, *[nan_key(c) for c in cols])


# P4 ------------------------------------------------------------------------
def bin_id(c, width: int) -> Column:
    return F.floor(col(c) / width).cast("long")


def equal_width_bins(df: DataFrame, c: str, n_bins: int = 200, name: str | None = None) -> DataFrame:
    """Equal-width, right-closed bins over [min, max] (first bin holds the minimum).

    The bounds are scalar subqueries of the same plan (no driver round trip)."""
    lo = df.agg(F.min(c)).scalar()
    hi = df.agg(F.max(c)).scalar()
    name = name or f"{c}_bin"
    x = F.try_divide((F.col(c) - lo).cast("double"), (hi - lo).cast("double")) * n_bins
    return df.withColumn(name, F.when((F.col(c) == lo) | (hi == lo), F.lit(0))
                         .otherwise(F.least(F.ceil(x) - 1, F.lit(n_bins - 1))).cast("int"))


# P5 ------------------------------------------------------------------------
def clip_attempt(c, cap: int = 3) -> Column:
    """Values above ``cap`` become ``cap + 1``."""
    return F.when(col(c) <= cap, col(c)).otherwise(F.lit(cap + 1))


# P6 ------------------------------------------------------------------------
def fill_defaults(df: DataFrame) -> DataFrame:
    """elapsed -> -1 (int), had_explanation -> 0, part -> 0, tags -> '0'."""
    out = df.withColumns({
        "prior_question_elapsed_time": F.coalesce(F.col("prior_question_elapsed_time"), F.lit(-1.0)).cast("long"),
        "prior_question_had_explanation": F.coalesce(F.col("prior_question_had_explanation"), F.lit(False)).cast("int"),
    })
    if "part" in df.columns:
        out = out.withColumn("part", F.coalesce(F.col("part"), F.lit(0)))
    if "tags" in df.columns:
        out = out.withColumn("tags", F.coalesce(F.col("tags"), F.lit("0")))
    return out


# P7 ------------------------------------------------------------------------
def part_to_section(c="part") -> Column:
    """Parts 1-4 (listening) -> 0, 5-7 (reading) -> 1, else NULL."""
    return F.when(col(c).between(1, 4), F.lit(0)).when(col(c).between(5, 7), F.lit(1))


# P8 ------------------------------------------------------------------------
def tag_array(c="tags", pad: int = TAG_PAD_188, null_tag: int | None = None, width: int = N_TAG_SLOTS) -> Column:
    """Tag text -> int array left-padded to ``width`` with ``pad``; NULL tags -> [null_tag]."""
    null_tag = pad if null_tag is None else null_tag
    arr = F.coalesce(parse_tags(c), F.array(F.lit(null_tag)))
    return pad_left(arr, width, pad)


# P9 ------------------------------------------------------------------------
def one_hot(c, levels) -> dict[str, Column]:
    """One 0/1 column per level; a value outside the levels (or NULL, -1) gives all zeros."""
    name = c if isinstance(c, str) else "x"
    return {f"{name}_{v}": F.coalesce((col(c) == v).cast("int"), F.lit(0)) for v in levels}


# P10 -----------------------------------------------------------------------
def lecture_type_code(df: DataFrame, lectures: DataFrame) -> DataFrame:
    """type_of_id 0..3 for lecture ids (by name), 4 otherwise; lecture target set to 2."""
    names = F.create_map(*[x for i, n in enumerate(LECTURE_TYPES) for x in (F.lit(n), F.lit(i))])
    lt = lectures.select(F.col("lecture_id").alias("_lid"), names[F.col("type_of")].alias("_tcode"))
    j = dim_join(df, lt, F.col("content_id") == F.col("_lid"), "left", max_rows=MAX_BROADCAST_ROWS)
    return (j.withColumn("type_of_id", F.coalesce(F.col("_tcode"), F.lit(4)))
            .withColumn("answered_correctly", F.when(F.col("content_type_id") == 1, F.lit(2))
                        .otherwise(F.col("answered_correctly")))
            .drop("_lid", "_tcode"))


# P11 -----------------------------------------------------------------------
TARGET_CONVERTERS = {
    "log1p": (F.log1p, F.expm1),
    "identity": (lambda x: x, lambda x: x),
}


def target_convert(c, how: str = "log1p") -> Column:
    return TARGET_CONVERTERS[how][0](col(c))


def target_reconvert(c, how: str = "log1p") -> Column:
    """Inverse transform, clamped at 0."""
    return F.greatest(TARGET_CONVERTERS[how][1](col(c)), F.lit(0.0))


# P12 -----------------------------------------------------------------------
INT_BOUNDS = [("tinyint", 127), ("smallint", 32767), ("int", 2147483647)]


def narrowest_type_expr(lo: Column, hi: Column, is_int: bool) -> Column:
    """Smallest type holding [lo, hi] (strict bounds as in the reference); floats -> float."""
    if not is_int:
        return F.lit("float")
    e = F.lit("bigint")
    for name, b in reversed(INT_BOUNDS):
        e = F.when((lo > -b - 1) & (hi < b), F.lit(name)).otherwise(e)
    return e


def narrow_types_table(df: DataFrame) -> DataFrame:
    """(column, min, max, type) for every numeric column, from one aggregate pass."""
    num = [(f.name, f.dataType.typeName() in ("byte", "short", "integer", "long"))
           for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float",
                                                                  "double")]
    aggs = []
    for n, _ in num:
        aggs += [F.min(n).cast("double").alias(f"{n}__min"), F.max(n).cast("double").alias(f"{n}__max")]
    row = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"{n}__min").alias("min_value"),
                                           F.col(f"{n}__max").alias("max_value"), F.lit(i).alias("is_int"))
                                  for n, i in num]))
    t = row.select(stacked.alias("s")).select("s.*")
    int_type = narrowest_type_expr(F.col("min_value"), F.col("max_value"), True)
    return t.withColumn("narrow_type", F.when(F.col("is_int"), int_type).otherwise(F.lit("float"))).drop("is_int")


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast each numeric column to its narrowest type (one bounded row of stats to the driver)."""
    types = {r["column_name"]: r["narrow_type"] for r in narrow_types_table(df).collect()}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


# P13 -----------------------------------------------------------------------
def standardize(df: DataFrame, cols, inf_factor: float = 1.2) -> DataFrame:
    """+inf -> 1.2 x finite max, NULL -> mean, then (x - mean) / sample std.

    One aggregate, a scalar subquery planned with the query, holds maximum, mean,
    variance and counts of the finite values of all columns.  What replaces the
    infinite ones moves mean and squared deviations by a closed form; a filled
    NULL lies on the mean and adds to the number of rows only."""
    inf = F.lit(float("inf"))

    def stats(c: str) -> Column:
        finite = F.when(F.col(c) != inf, F.col(c))
        return F.struct(F.max(finite).alias("mx"), F.avg(finite).alias("avg"), F.var_pop(finite).alias("var"),
                        F.count(finite).cast("double").alias("n"), F.count_if(F.col(c) == inf).cast("double").alias("n_inf"),
                        F.count(F.lit(1)).cast("double").alias("rows"))

    one = df.agg(F.struct(*[stats(c).alias(f"c{i}") for i, c in enumerate(cols)]).alias("s")).scalar()

    def scaled(i: int, c: str) -> Column:
        s = one[f"c{i}"]
        top = s["mx"] * inf_factor
        known = s["n"] + s["n_inf"]
        mean = F.when(s["n_inf"] > 0, F.try_divide(s["avg"] * s["n"] + top * s["n_inf"], known)).otherwise(s["avg"])
        squares = s["var"] * s["n"] + F.when(s["n_inf"] > 0, s["n"] * (s["avg"] - mean) ** 2
                                             + s["n_inf"] * (top - mean) ** 2).otherwise(F.lit(0.0))
        sd = F.sqrt(F.try_divide(squares, s["rows"] - 1))
        x = F.coalesce(F.when(F.col(c) == inf, top).otherwise(F.col(c)), mean)
        return F.try_divide(x - mean, sd)

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(cols)})


# P14 -----------------------------------------------------------------------
def sample_down(df: DataFrame, keep_fraction: float, is_val: str = "is_val", seed: int = 0) -> DataFrame:
    """Keep every validation row and a seeded hash sample of the training rows."""
    h = F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed)), F.lit(1_000_000))
    return df.filter((F.col(is_val) == 1) | (h < F.lit(int(keep_fraction * 1_000_000))))


# P15 -----------------------------------------------------------------------
def select_features(df: DataFrame, wanted: list[str], store: DataFrame | None = None) -> DataFrame:
    """Keep configured columns; those missing from ``df`` are joined from the store by row_id."""
    have = [c for c in wanted if c in df.columns]
    missing = [c for c in wanted if c not in df.columns]
    out = df.select("row_id", *[c for c in have if c != "row_id"])
    if missing:
        if store is None:
            raise KeyError(missing)
        out = out.join(store.select("row_id", *missing), "row_id", "left")
    return out


# P16 -----------------------------------------------------------------------
def map_default(df: DataFrame, mapping: DataFrame, key: str, map_key: str, value: str, default=-999,
                name: str | None = None):
    """Dictionary lookup of ``df[key]`` in ``mapping[map_key] -> value`` as a left
    join (broadcast when the map is proven small), ``default`` when absent."""
    m = mapping.select(F.col(map_key).alias("_mk"), F.col(value).alias("_mv"))
    j = dim_join(df, m, F.col(key) == F.col("_mk"), "left")
    return j.withColumn(name or f"{value}_mapped", F.coalesce(F.col("_mv"), F.lit(default))).drop("_mk", "_mv")


# P17 -----------------------------------------------------------------------
def log_features(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({f"log1p_{c}": F.log1p(F.col(c)) for c in cols})


# P18 -----------------------------------------------------------------------
def question_answer_code(n_items: int = N_ITEMS) -> Column:
    return F.col("content_id") + F.when(F.col("answered_correctly") == 1, F.lit(n_items)).otherwise(F.lit(0))


# J1 / J4 -------------------------------------------------------------------
def join_questions(df: DataFrame, qs: DataFrame, questions_only: bool = False) -> DataFrame:
    """Left join on content_id = question_id.  Literal form joins every row by id."""
    q = qs.withColumnRenamed("question_id", "_qid")
    cond = F.col("content_id") == F.col("_qid")
    if questions_only:
        cond = cond & (F.col("content_type_id") == 0)
    return dim_join(df, q, cond, "left", max_rows=MAX_BROADCAST_ROWS).drop("_qid")


# J2 ------------------------------------------------------------------------
def join_lectures(df: DataFrame, lectures: DataFrame, literal: bool = False) -> DataFrame:
    """Left join to lectures.  ``literal=True`` ignores the content type, so a
    question sharing a lecture's id takes its tag and part."""
    lt = lectures.select(F.col("lecture_id").alias("_lid"), F.col("tag").alias("lecture_tag"),
                         F.col("part").alias("lecture_part"), F.col("type_of"))
    cond = F.col("content_id") == F.col("_lid")
    if not literal:
        cond = cond & (F.col("content_type_id") == 1)
    return dim_join(df, lt, cond, "left", max_rows=MAX_BROADCAST_ROWS).drop("_lid")


# J3 ------------------------------------------------------------------------
def lookup_part(df: DataFrame, qs: DataFrame, lectures: DataFrame) -> DataFrame:
    """Combined id -> part map where a lecture id wins over a question id."""
    q = qs.select(F.col("question_id").alias("_qid"), F.col("part").alias("_qpart"))
    lt = lectures.select(F.col("lecture_id").alias("_lid"), F.col("part").alias("_lpart"))
    j = dim_join(dim_join(df, q, F.col("content_id") == F.col("_qid"), "left", max_rows=MAX_BROADCAST_ROWS),
                 lt, F.col("content_id") == F.col("_lid"), "left", max_rows=MAX_BROADCAST_ROWS)
    return j.withColumn("mapped_part", F.coalesce("_lpart", "_qpart")).drop("_qid", "_qpart", "_lid", "_lpart")


# J5 / J6 / J7 / J9 -----------------------------------------------------------
def rowid_join(df: DataFrame, features: DataFrame, cols=None) -> DataFrame:
    f = features if cols is None else features.select("row_id", *cols)
    return df.join(f, "row_id", "left")


def semi_join(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def anti_join(df: DataFrame, *id_lists: DataFrame, key: str = "row_id") -> DataFrame:
    """Drop rows whose key is in the union of the given lists."""
    drop = id_lists[0].select(key)
    for other in id_lists[1:]:
        drop = drop.unionByName(other.select(key))
    return df.join(drop.distinct(), key, "left_anti")


def refill_dropped(all_ids: DataFrame, kept: DataFrame, value: str, fill=0.0) -> DataFrame:
    """Re-expand a vector over kept rows to all rows, ``fill`` on dropped rows."""
    return (all_ids.select("row_id").join(kept.select("row_id", value), "row_id", "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(fill))))


# J8 ------------------------------------------------------------------------
def composite_join(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return dim_join(df, table, keys, "left")
