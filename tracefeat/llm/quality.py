"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import content_key, in_fold, materialise
from tracefeat.llm.ridge import normal_equations, share_below

STATS = ("log_words", "log_chars", "word_len", "word_len_sd", "letters", "digits", "upper", "punctuation", "symbols",
         "spaces", "upper_words", "symbol_words", "letterless_words", "marked_words", "short_words", "distinct_words",
         "top_word", "repeated_next", "repeated_pairs", "log_lines", "line_words", "repeated_lines", "bang", "bar",
         "sentence_words", "capital_words")
MAX_TRAIN = 40_000           # bound on the labelled rows that are fitted and calibrated
N_FOURIER = 256
BINS = 2048


def document_statistics(text: str) -> list[float]:
    """``STATS`` of one whole text; null and blank texts give zeros."""
    import math
    from collections import Counter
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, chars = len(words), len(text)
    lens = [len(w) for w in words]
    mean = sum(lens) / n
    letters = upper = digits = spaces = punct = 0
    for ch, k in Counter(text).items():
        if ch.isalpha():
            letters += k
            if ch.isupper():
                upper += k
        elif ch.isdigit():
            digits += k
        elif ch.isspace():
            spaces += k
        elif ch in ".,;:'\"()-?":
            punct += k
    counts = Counter(words)
    upper_w = symbol_w = none_w = marked = short = capital = enders = 0
    for w, k in counts.items():
        alpha = w.isalpha()
        if not alpha and not any(map(str.isalpha, w)):
            none_w += k
        elif w.isupper() and len(w) > 1:
            upper_w += k
        elif w[0].isupper():
            capital += k
        if not alpha:
            marked += k
            if not w.rstrip(".,;:?\"')").lstrip("\"'(").replace("-", "").replace("'", "").isalnum():
                symbol_w += k
            if w[-1] in ".!?":
                enders += k
        if len(w) <= 3:
            short += k
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    pairs = Counter(zip(words, words[1:]))
    return [math.log1p(n), math.log1p(chars), mean, math.sqrt(max(0.0, sum(v * v for v in lens) / n - mean * mean)),
            letters / chars, digits / chars, upper / max(letters, 1), punct / chars,
            (chars - letters - digits - spaces - punct) / chars, spaces / chars, upper_w / n, symbol_w / n, none_w / n,
            marked / n, short / n, len(counts) / n, max(counts.values()) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(pairs) / max(n - 1, 1) if n > 1 else 0.0,
            math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(line_counts) / len(lines),
            text.count("!") / n, text.count("|") / n, math.log1p(n / (enders + 1)), capital / n]


def make_statistics():
    @F.arrow_udf("array<double>")
    def statistics(texts: pa.Array) -> pa.Array:
        return pa.array([document_statistics(t.as_py() or "") for t in texts], pa.list_(pa.float64()))
    return statistics


def isotonic(count, positive, prior: float):
    """Non-decreasing least-squares fit of positive/count over ordered bins (pool adjacent violators); numpy.

    Empty bins take the line between their neighbours; a table without counts gives ``prior``.
    """
    import numpy as np
    pools = []                                       # [mean, weight, first bin, last bin]
    for k in np.nonzero(count)[0]:
        pools.append([positive[k] / count[k], float(count[k]), k, k])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _, hi = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, hi
    if not pools:
        return np.full(len(count), prior)
    at, value = [], []
    for m, _, lo, hi in pools:
        at += [lo, hi]
        value += [m, m]
    return np.interp(np.arange(len(count)), at, value)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = 0.7, max_train: int = MAX_TRAIN,
                   n_fourier: int = N_FOURIER, penalty: float = 1e-3, seed: int = 11) -> DataFrame:
    """(id, held_out, score, predicted) of every input row.

    Learns from labelled rows outside fold 2 of crc32(id) mod 4: folds 0 and 1
    fit the ridge, fold 3 the isotonic calibration, on a sample of
    ``max_train`` rows at most in expectation (all of them when fewer).  The
    inputs are ``STATS`` of the whole text, standardised, through
    ``n_fourier`` random Fourier features of a Gaussian kernel.  score is the
    calibrated chance of label 1.  Null and empty texts have the statistics
    of an empty text and a score; rows repeating id and text score alike; a
    null label or id teaches nothing; without any usable label every score
    is 0.5; an empty table gives an empty table.
    """
    import numpy as np
    d = materialise(docs.select(F.col(id_col).alias("id"), content_key(F.col(id_col)).alias("key"),
                                in_fold(F.col(id_col)).alias("fold"),
                                make_statistics()(F.col(text_col)).alias("x")), "quality-stats")
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")) \
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (in_fold(F.col("id")) != 2))
    n_lab = lab.count()
    train = d.where("fold <> 2").join(lab.where(share_below(content_key(F.col("id")), max_train / max(n_lab, 1))), "id")
    train = materialise(train.select("fold", "x", "y"), "quality-train")

    n_stats = len(STATS)
    moments = train.where("fold <> 3").select(F.posexplode("x").alias("k", "v")).groupBy("k") \
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return d.select("id", (F.col("fold") == 2).alias("held_out"), F.lit(0.5).alias("score"),
                        F.lit(int(0.5 >= threshold)).alias("predicted"))
    mean, sd = np.zeros(n_stats), np.ones(n_stats)
    for r in moments:
        mean[r["k"]], sd[r["k"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    freq = rng.normal(size=(n_stats, n_fourier)) / (0.7 * np.sqrt(n_stats))
    phase = rng.uniform(0, 2 * np.pi, n_fourier)

    def fourier(column):
        import numpy as np
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n_stats)
        x = np.clip((x - mean) / sd, -6, 6)
        z = np.sqrt(2.0 / n_fourier) * np.cos(x @ freq + phase)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def rows(batch):
        z = fourier(batch.column(0))
        return z, batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)

    zz, zt = normal_equations(train.where("fold <> 3").select("x", "y"), rows, n_fourier + 1, 1)
    n_fit = zz[-1, -1]
    ridge = penalty * max(n_fit, 1.0) / n_fourier * np.eye(n_fourier + 1)
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(zz + ridge, zt)[:, 0]

    def make_bin():
        @F.arrow_udf("int")
        def raw_bin(x: pa.Array) -> pa.Array:
            import numpy as np
            raw = fourier(x) @ beta if len(x) else np.empty(0)
            return pa.array(np.clip(np.floor((raw + 0.5) / 2.0 * BINS), 0, BINS - 1).astype(np.int32))
        return raw_bin

    cal = train.where("fold = 3").groupBy(make_bin()(F.col("x")).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()
    count, positive = np.zeros(BINS), np.zeros(BINS)
    for r in cal:
        count[r["bin"]], positive[r["bin"]] = r["n"], r["pos"]
    raw_at = (np.arange(BINS) + 0.5) / BINS * 2.0 - 0.5
    curve = np.clip(isotonic(count, positive, 0.5) if cal else raw_at, 0.0, 1.0).tolist()
    scored = d.withColumn("bin", make_bin()(F.col("x"))) \
        .withColumn("score", F.get(F.array(*[F.lit(v) for v in curve]), F.col("bin")))
    return scored.select("id", (F.col("fold") == 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
