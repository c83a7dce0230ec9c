"""Language identification: blended-spectrum n-gram presence kernel, Nystrom landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefeat.llm.common import content_key, in_fold, without
from tracefeat.llm.ridge import normal_equations, share_below

MAX_GRAM = 3                 # n-grams of 1 to MAX_GRAM characters
BUCKETS = 1 << 18            # n-grams are hashed into this many presence bits
LANDMARKS = 128              # in all, dealt evenly to the languages, and
LANG_LANDMARKS = 4           # at least so many of each language
LANDMARK_CHARS = 20_000      # longer texts are landmarks only of languages that lack shorter ones, the shortest first
MAX_TRAIN = 12_000           # fitted rows, dealt evenly to the languages, and
LANG_TRAIN = 200             # at least so many of each language
DENSE = 1 << 24              # cells of the landmark matrix up to which it is held dense
BATCH = 256                  # texts scored by one matrix product


def _no_letters() -> str:
    """Characters that Python's \\w takes beside letters, decimal digits and _ (fractions, superscripts, numerals), as a
    character class of ranges."""
    out, first = [], None
    for c in range(0x110000):
        ch = chr(c)
        odd = ch.isalnum() and not ch.isalpha() and not ch.isdecimal()
        if odd and first is None:
            first = c
        elif not odd and first is not None:
            out.append(f"{chr(first)}-{chr(c - 1)}")
            first = None
    return "".join(out)


LETTERS = rf"[^\W\d_{_no_letters()}]+"         # runs of characters of the letter categories


class Spectrum:
    """Presence of hashed n-grams of the distinct lower-case letter words of a text, padded by spaces."""

    def __init__(self):
        import re

        import numpy as np
        self.word = re.compile(LETTERS)
        self.flags = np.zeros(BUCKETS, dtype=bool)

    def words(self, text):
        return set(self.word.findall(text.lower())) if text else set()

    def present(self, words):
        """Sorted bucket numbers of the n-grams inside the padded words."""
        import numpy as np
        c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        space = c == 32
        code = c
        for n in range(1, MAX_GRAM + 1):
            if n > 1:
                code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]
            whole = ~space if n == 1 else ~(space[:-1] & space[1:])
            if n > 2:                                          # no space inside
                inner = np.zeros(len(code), dtype=bool)
                for k in range(1, n - 1):
                    inner |= space[k:k + len(code)]
                whole = ~inner
            mixed = (code[whole] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            self.flags[(mixed >> np.uint64(64 - 18)).astype(np.int64)] = True
        hit = np.flatnonzero(self.flags)
        self.flags[hit] = False
        return hit


def make_grams():
    """Arrow UDF: text -> bucket numbers of its n-grams (2^18 at most, however long the text is)."""
    @F.arrow_udf("array<int>")
    def grams(texts: pa.Array) -> pa.Array:
        s = Spectrum()
        return pa.array([s.present(s.words(t)).tolist() for t in texts.to_pylist()], pa.list_(pa.int32()))
    return grams


def landmark_model(grams):
    """(bucket -> row, presence of the buckets in the landmarks scaled by 1/sqrt of each landmark's n-grams).

    The presence is a dense matrix, or beyond DENSE cells (starts, landmark
    numbers, scales): the landmarks of row r are numbers[starts[r]:starts[r + 1]].
    """
    import numpy as np
    grams = [np.asarray(g, dtype=np.int64) for g in grams]
    used = np.unique(np.concatenate(grams))
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    scale = np.array([1.0 / np.sqrt(len(g)) for g in grams], dtype=np.float32)
    if len(used) * len(grams) > DENSE:
        rows = column[np.concatenate(grams)]
        numbers = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(used)))])
        return column, (starts, numbers[np.argsort(rows, kind="stable")], scale)
    m = np.zeros((len(used), len(grams)), dtype=np.float32)
    for j, g in enumerate(grams):
        m[column[g], j] = scale[j]
    return column, m


def kernel(grams, column, landmarks):
    """Normalised presence kernel of each set of n-grams with every landmark, by one matrix product if dense."""
    import numpy as np
    dense = not isinstance(landmarks, tuple)
    x = np.zeros((len(grams), len(landmarks) if dense else len(landmarks[2])), dtype=np.float32)
    for i, g in enumerate(grams):
        if len(g):
            cols = column[g]
            cols = cols[cols >= 0]
            if dense:
                x[i, cols] = 1.0 / np.sqrt(len(g))
            else:
                starts, numbers, scale = landmarks
                n = starts[cols + 1] - starts[cols]
                at = np.repeat(starts[cols] - np.cumsum(n) + n, n) + np.arange(n.sum())
                x[i] = np.bincount(numbers[at], minlength=len(scale)) * scale / np.sqrt(len(g))
    return (x @ landmarks if dense else x).astype(np.float64)


def kernel_rows(texts, column, landmarks):
    """(K, has_letters): kernel of each text with every landmark, BATCH texts at a time."""
    import numpy as np
    s = Spectrum()
    letters, parts = np.zeros(len(texts), dtype=bool), []
    for lo in range(0, len(texts), BATCH):
        words = [s.words(t) for t in texts[lo:lo + BATCH]]
        letters[lo:lo + BATCH] = [bool(w) for w in words]
        parts.append(kernel([s.present(w) if w else () for w in words], column, landmarks))
    return np.concatenate(parts), letters


def make_scorer(model):
    """Arrow UDF over a broadcast model: text -> (language, score); null without letters."""
    @F.arrow_udf("struct<lang:string,score:double>")
    def score(texts: pa.Array) -> pa.Array:
        import numpy as np
        column, landmarks, alpha, langs = model.value
        out, scores = [], []
        for lo in range(0, len(texts), BATCH):
            part = texts.slice(lo, BATCH).to_pylist()
            k, letters = kernel_rows(part, column, landmarks)
            f = k @ alpha
            best = f.argmax(axis=1)
            top = np.clip((f[np.arange(len(part)), best] + 1.0) / 2.0, 0.0, 1.0)
            out += [langs[b] if ok else None for b, ok in zip(best, letters)]
            scores += [float(v) if ok else 0.0 for v, ok in zip(top, letters)]
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang", "score"])
    return score.asNondeterministic()              # run once, not again for a filter on its result


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS, penalty: float = 1e-4) -> DataFrame:
    """All input columns plus __held_out, __lang and __score of every row (see ``languages``).

    Learns every language (non-null value of ``lang_col``) that has a text
    with letters outside fold 2 of crc32(id) mod 4.  Fitted rows are picked by
    a hash of id and text and rows alike in both count once, ``max_train`` in expectation dealt evenly to the
    languages, but LANG_TRAIN of each at least (or all it has); so are
    ``landmarks`` with LANG_LANDMARKS, which grow with the number of languages
    as the normal equations do (landmarks squared doubles on the driver).  The
    kernel of two texts is the number of character n-grams (1 to 3 letters of
    lower-cased, space-padded words) that both hold, over the root of the
    product of their own numbers.  The landmarks, training texts, span the
    Nystrom approximation; one ridge regression per language is solved from
    partition-summed normal equations; texts are scored in batches by one
    matrix product.  __lang is ``und`` with score 0 for a null text, a text
    without letters, and every text if nothing could be learned.  Rows
    repeating an id or a text are separate rows; an empty table stays empty.
    """
    import numpy as np
    spark = docs.sparkSession
    docs = without(docs, ["__held_out", "__lang", "__score", "__out"])
    t = docs.select(content_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(lang_col).alias("lang"),
                    F.col(text_col).alias("text"), in_fold(F.col(id_col)).alias("fold")) \
        .where("lang is not null and fold <> 2").where(F.col("text").rlike(r"\p{L}"))
    counts = t.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("count")).collect()
    held = (in_fold(F.col(id_col)) == 2).alias("__held_out")
    nothing = docs.select("*", held, F.lit("und").alias("__lang"), F.lit(0.0).alias("__score"))
    if not counts:
        return nothing
    langs = sorted(r["lang"] for r in counts)
    per_lang = max(LANG_TRAIN, max_train // len(langs))
    shares = spark.createDataFrame([(r["lang"], per_lang / r["count"]) for r in counts], "lang string, share double")
    sample = t.join(F.broadcast(shares), "lang").where(share_below(F.col("key"), F.col("share"))) \
        .dropDuplicates(["lang", "key"])                                                          # per_lang of each
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(
        F.greatest(F.length("text"), F.lit(LANDMARK_CHARS)), "key", F.xxhash64("text")))
    chosen = (sample.withColumn("r", rank).where(F.col("r") <= max(LANG_LANDMARKS, landmarks // len(langs)))
              .select(make_grams()("text").alias("grams")).collect())
    chosen = sorted(r["grams"] for r in chosen if r["grams"])
    if not chosen:
        return nothing
    column, marks = landmark_model(chosen)
    number = {v: i for i, v in enumerate(langs)}
    known = spark.sparkContext.broadcast((column, marks))
    n_marks, n_langs = len(chosen), len(langs)

    def rows(batch):
        import numpy as np
        k, _ = kernel_rows(batch.column(0).to_pylist(), *known.value)
        target = -np.ones((batch.num_rows, n_langs))
        target[np.arange(batch.num_rows), [number[v] for v in batch.column(1).to_pylist()]] = 1.0
        return k, target

    kk, kt = normal_equations(sample.select("text", "lang"), rows, n_marks, n_langs)
    own = kernel([np.asarray(g) for g in chosen], column, marks)
    alpha = np.linalg.solve(kk + penalty * max(np.trace(kk) / n_marks, 1e-9) * own + 1e-9 * np.eye(n_marks), kt)
    model = spark.sparkContext.broadcast((column, marks, alpha, langs))
    scored = docs.select("*", held, make_scorer(model)(F.col(text_col).cast("string")).alias("__out"))
    return scored.withColumn("__lang", F.coalesce("__out.lang", F.lit("und"))) \
        .withColumn("__score", F.col("__out.score")).drop("__out")
