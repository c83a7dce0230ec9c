"""Language ID: the explicit kernel, null and repeated ids, characters that are no letters."""

import random

import numpy as np
from pyspark.sql import functions as F

EN = "the quick brown fox jumps over lazy dogs while people watch rain falling down slowly every night".split()
DE = "der schnelle braune fuchs springt über faule hunde während leute den regen jede nacht langsam fallen sehen".split()


def text(words, seed, n=12):
    return " ".join(random.Random(seed).choices(words, k=n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_characters_that_are_no_letters(spark):
    from tracefeat.llm.langid import identify_languages
    rows = [(i, text(EN, i), "en") for i in range(40)] + [(100 + i, text(DE, i), "de") for i in range(40)]
    odd = ["²½", "Ⅷ ①", "٣٤٥", "1/2 3_4", "¼ + ¾", "", None]
    out = identify_languages(docs(spark, rows + [(200 + i, t, None) for i, t in enumerate(odd)])).where("doc_id >= 200")
    assert {(r["__lang"], r["__score"]) for r in out.collect()} == {("und", 0.0)}


def test_null_ids_do_not_hide_a_language(spark):
    """All German texts have a null id: they share a crc but not a sample key."""
    from tracefeat.llm.langid import identify_languages
    de = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"),
                                    F.concat(F.element_at(F.array(*[F.lit(text(DE, s)) for s in range(50)]),
                                                          (F.col("id") % 50 + 1).cast("int")), F.lit(" "),
                                             F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"),
                                    F.lit("de").alias("lang"))
    en = docs(spark, [(i, text(EN, i), "en") for i in range(2_000)])
    same = docs(spark, [(7, text(DE, 3) + " immer", "de")]).crossJoin(spark.range(5_000)).drop("id")
    out = identify_languages(de.unionByName(en).unionByName(same))
    right = out.groupBy("lang").agg(F.avg((F.col("lang") == F.col("__lang")).cast("int")).alias("r")).collect()
    assert all(r["r"] > 0.99 for r in right) and len(right) == 2


def test_scores_are_those_of_the_explicit_kernel(spark):
    """Every training text is a landmark: the same ridge over sets of n-grams, without hashing."""
    from tracefeat.llm.langid import identify_languages
    import zlib
    rows = [(i, text(EN, i) if i % 2 else text(DE, i), "en" if i % 2 else "de") for i in range(100)]
    got = {r["doc_id"]: r for r in identify_languages(docs(spark, rows)).collect()}

    def grams(t):
        out = set()
        for w in set(t.lower().split()):
            w = f" {w} "
            out |= {w[k:k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1)} - {" "}
        return out

    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sets, marks = {r[0]: grams(r[1]) for r in rows}, [r[0] for r in train]
    k = np.array([[len(sets[a] & sets[b]) / np.sqrt(len(sets[a]) * len(sets[b])) for b in marks] for a in sets])
    own = np.array([k[list(sets).index(a)] for a in marks])
    t = np.array([[1.0 if r[2] == v else -1.0 for v in ("de", "en")] for r in train])
    kk = own.T @ own
    alpha = np.linalg.solve(kk + 1e-4 * np.trace(kk) / len(marks) * own + 1e-9 * np.eye(len(marks)), own.T @ t)
    f = k @ alpha
    for i, a in enumerate(sets):
        assert got[a]["__lang"] == ("de", "en")[int(f[i].argmax())]
        assert abs(got[a]["__score"] - min(1.0, max(0.0, (f[i].max() + 1) / 2))) < 0.02
