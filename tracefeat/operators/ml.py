"""Matrix and model-backed operators (M1-M8) on MLlib.

Every model here trains on executors (MLlib estimators, distributed SVD);
the driver holds only model parameters whose size is bounded by the item
vocabulary times the embedding width.
"""

from __future__ import annotations

import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefeat.plans.ranking import global_rank
from tracefeat.session import cut_lineage


# M1 ------------------------------------------------------------------------
def cooccurrence_matrix(df: DataFrame, index: str, columns: str, values: str | None = None) -> DataFrame:
    """(index_code, column_code, value): sums of ``values`` (or row counts) per
    (index, column), with 0-based codes in sorted key order; rows with a NULL
    key or value are dropped."""
    v = F.lit(1) if values is None else F.col(values)
    d = df.select(index, columns, v.alias("_v")).dropna()
    cells = d.groupBy(index, columns).agg(F.sum("_v").alias("value"))
    codes_i = global_rank(cells.select(index).distinct(), [index], name="index_code")
    codes_c = global_rank(cells.select(columns).distinct(), [columns], name="column_code")
    out = cells.join(codes_i, index).join(codes_c, columns)
    return out.select(index, columns, (F.col("index_code") - 1).alias("index_code"),
                      (F.col("column_code") - 1).alias("column_code"), "value")


# M2 ------------------------------------------------------------------------
def _gram(df: DataFrame, column: str, width: int):
    """Sum of v v' over all rows of an array column: a width x width numpy matrix.  Each task adds up its own
    products and sends one row per matrix row; the driver gets one matrix."""
    import numpy as np

    def products(batches):
        import pyarrow as pa
        total = None
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy().reshape(b.num_rows, width)
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()),
                                              "v": pa.array(list(total), pa.list_(pa.float64()))})

    out = np.zeros((width, width))
    cells = df.select(column).mapInArrow(products, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return (out + out.T) / 2


def _times(df: DataFrame, keep: list, column: str, matrix, name: str) -> DataFrame:
    """The columns ``keep`` and ``name`` = the array column times a small matrix, batch by batch."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def product(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                v = b.column(len(keep)).flatten().to_numpy().reshape(b.num_rows, len(matrix)) @ matrix
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(list(v), pa.list_(pa.float64()))],
                                                 names=[*keep, name])

    return df.select(*keep, column).mapInArrow(product, schema)


def _product(cells: DataFrame, by: str, to: str, block: DataFrame, column: str, width: int) -> DataFrame:
    """(to, v): for every ``to``, the sum over its cells of value times the block row of the cell's ``by``."""
    rows = block.select(F.col(by), *[F.col(column)[j].alias(f"_b{j}") for j in range(width)])
    sums = cells.join(rows, by).groupBy(to).agg(*[F.sum(F.col("value") * F.col(f"_b{j}")).alias(f"_s{j}") for j in range(width)])
    return sums.select(to, F.array(*[f"_s{j}" for j in range(width)]).alias("v"))


def truncated_svd(cells: DataFrame, key: str, other: str, k: int = 5, steps: int = 20, extra: int = 15, seed: int = 0,
                  tol: float = 1e-10):
    """(table key, u array<double>, singular values): the k leading left singular vectors of a sparse matrix
    given as cells (key, other, value), one row a cell.

    Block Krylov iteration: a block of k + ``extra`` seeded start vectors is
    multiplied by A A', each new block is made orthogonal to the blocks before
    it, and the vectors are read off the whole basis (Rayleigh-Ritz).  Vectors are
    tables with one row per key or other; a product is a join and a sum per row,
    a scalar product a matrix of at most ``steps`` (k + extra) rows, and only such
    matrices reach the driver.  Stops when the k squared singular values move by
    less than ``tol`` of the largest, when the basis spans all that A reaches, or
    after ``steps`` blocks.  The sign of a vector is that of its sum of cubes."""
    import numpy as np
    cells = cut_lineage(cells.select(key, other, F.col("value").cast("double").alias("value")))
    width = k + extra
    draw = [F.xxhash64(F.col(key), F.lit(seed), F.lit(j)) / float(1 << 63) for j in range(width)]
    basis = cells.select(key).distinct().withColumn("q", F.array()).withColumn("q", F.col("q").cast("array<double>"))
    new, size, last, inner, found = basis.select(key, F.array(*draw).alias("w")), 0, 0, np.zeros((0, 0)), None
    for _ in range(steps + 1):
        both = cut_lineage(basis.join(new, key).select(key, "q", "w"))
        for turn_no in range(2):                            # twice, so that rounding does not undo it
            n = size + width
            g = _gram(both.select(F.concat("q", "w").alias("z")), "z", n)
            inside, rest = g[:size, size:], g[size:, size:] - g[:size, size:].T @ g[:size, size:]
            if size and not turn_no:                        # w = A A' (last block): its part of Q' A A' Q
                inner = np.pad(inner, (0, size - len(inner)))
                inner[:, size - last:] = inside
                inner[size - last:, :] = inside.T
                before, found = found, np.sort(np.linalg.eigvalsh(inner))[::-1][:k]
                if before is not None and len(before) == len(found) and np.abs(found - before).max() <= tol * found[0]:
                    width = 0
                    break
            e, v = np.linalg.eigh((rest + rest.T) / 2)
            keep = e > max(g[size:, size:].trace(), 1e-300) * 1e-13
            if not keep.any():
                width = 0
                break
            turn = v[:, keep] / np.sqrt(e[keep])
            both = _times(both.withColumn("z", F.concat("q", "w")), [key, "q"], "z", np.vstack([-inside @ turn, turn]), "w")
            width = int(keep.sum())
        if not width or size and len(inner) // max(last, 1) >= steps:
            break
        basis = cut_lineage(both.select(key, F.concat("q", "w").alias("q"), "w"))
        size, last = size + width, width
        across = _product(cells, key, other, basis, "w", width)
        new = _product(cells, other, key, across, "v", width).select(key, F.col("v").alias("w"))
        basis = basis.drop("w")
    if not size:
        return basis.select(key, F.col("q").alias("u")), []
    e, v = np.linalg.eigh(inner)
    order = np.argsort(e)[::-1][:k]
    order = order[e[order] > max(e.max(), 0.0) * 1e-14]
    s = np.sqrt(e[order])
    u = cut_lineage(_times(basis, [key], "q", v[:, order], "u"))
    cubes = u.agg(*[F.sum(F.col("u")[j] * F.col("u")[j] * F.col("u")[j]) for j in range(len(s))]).first()
    signs = [-1.0 if c is not None and c < 0 else 1.0 for c in cubes]
    return u.select(key, F.array(*[F.col("u")[j] * F.lit(x) for j, x in enumerate(signs)]).alias("u")), [float(x) for x in s]


def svd_embedding(df: DataFrame, key: str, other: str = "user_id", k: int = 5) -> tuple[DataFrame, list]:
    """Truncated SVD of the binary key x other incidence matrix: (key, U * Sigma as columns) and the singular
    values.  Both factors stay tables (see ``truncated_svd``)."""
    pairs = df.select(key, other).dropna().distinct().withColumn("value", F.lit(1.0))
    u, s = truncated_svd(pairs, key, other, k)
    return u.select(key, *[(F.col("u")[j] * F.lit(x)).alias(f"{key}__svd_{j}") for j, x in enumerate(s)]), s


# M3 ------------------------------------------------------------------------
def _tag_lists(questions: DataFrame, seed: int) -> DataFrame:
    """The questions' tag lists and a shuffled copy of each (a seeded hash order, so a run is reproducible)."""
    q = questions.select("question_id", F.split(F.coalesce("tags", F.lit("nan")), " ").alias("tags_list"))
    shuffled = q.select("question_id", F.transform(
        F.array_sort(F.transform("tags_list", lambda t: F.struct(F.xxhash64(t, F.col("question_id"), F.lit(seed))
                                                                  .alias("h"), t.alias("t")))),
        lambda s: s["t"]).alias("tags_list"))
    return q.unionByName(shuffled)


def tag_word2vec(questions: DataFrame, size: int = 32, window: int = 128, seed: int = 2020, max_iter: int = 5,
                 min_count: int = 1, partitions: int = 1) -> DataFrame:
    """Tag vectors learned by Word2Vec from the questions' tag lists plus a shuffled copy of each list.

    The lists are trained in ``partitions`` pieces whose vectors are averaged
    after every pass.  One piece repeats to the last bit but is one task; more
    pieces differ between runs by the order of their sums, and need more passes.
    The driver holds the vocabulary's vectors.  ``tag_ppmi_vectors`` has neither limit."""
    n = partitions
    docs = _tag_lists(questions, seed).repartition(n, "question_id", "tags_list").sortWithinPartitions("question_id", "tags_list")
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=max_iter,
                     numPartitions=n, inputCol="tags_list", outputCol="_v").fit(docs)
    vec = model.getVectors()
    return vec.select(F.col("word").alias("tag"), vector_to_array("vector").alias("w2v"))


def tag_ppmi_vectors(questions: DataFrame, size: int = 32, window: int = 128, seed: int = 2020, steps: int = 6) -> DataFrame:
    """Tag vectors from co-occurrence: (tag, vec).  Tags at most ``window`` places apart in a list count as a
    pair; the matrix of positive pointwise mutual informations is factored, and a tag's vector is its row of
    U * sqrt(Sigma), so tags met in the same company lie close.  Everything is a join or a sum; a tag never
    met with another has a zero vector.  Runs agree but for the last digits and turns among equal singular values."""
    d = _tag_lists(questions, seed).select(F.posexplode("tags_list").alias("i", "a"), "tags_list")
    lo, n = F.greatest(F.col("i") - window, F.lit(0)), F.lit(2 * window + 1)
    near = F.posexplode(F.slice("tags_list", lo + 1, n - (window - F.col("i") + lo)))
    pairs = d.select("a", "i", lo.alias("_lo"), near.alias("j", "b")).where(F.col("j") + F.col("_lo") != F.col("i"))
    c = cut_lineage(pairs.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))
    one = c.groupBy("a").agg(F.sum("n").alias("na"))
    total = c.agg(F.sum("n")).scalar()
    pmi = F.log(F.col("n") * total / (F.col("na") * F.col("nb")))
    cells = c.join(one, "a").join(one.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b") \
        .select("a", "b", pmi.alias("value")).where("value > 0")
    tags = d.select(F.col("a").alias("tag")).distinct()
    u, s = truncated_svd(cells, "a", "b", size, steps=steps, seed=seed)
    scaled = F.array(*[F.coalesce(F.col("u")[j] * F.lit(x ** 0.5), F.lit(0.0)) for j, x in enumerate(s)]
                     + [F.lit(0.0)] * (size - len(s)))
    return tags.join(u.withColumnRenamed("a", "tag"), "tag", "left").select("tag", scaled.alias("vec"))


# M4 ------------------------------------------------------------------------
def item_projection_2d(emb: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """First two principal components of item vectors (the 2-D map; t-SNE is not built)."""
    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(emb.dropna(subset=cols))
    p = PCA(k=2, inputCol="_x", outputCol="_p").fit(v).transform(v)
    a = vector_to_array("_p")
    return p.select(key, a[0].alias(f"{key}_proj_0"), a[1].alias(f"{key}_proj_1"))


# M5 ------------------------------------------------------------------------
def item_clusters(items: DataFrame, key: str, cols: list[str], k: int = 1000, seed: int = 0,
                  null_fill: float = -100.0) -> DataFrame:
    """NULL -> -100, z-score, KMeans; returns (key, cluster)."""
    filled = items.na.fill(null_fill, subset=cols)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_x"),
                            StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
                            KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster")])
    return pipe.fit(filled).transform(filled).select(key, "cluster")


# M6 ------------------------------------------------------------------------
def token_documents(df: DataFrame, index: str, token: str, unique: bool = True) -> DataFrame:
    """One document per ``index``: its distinct tokens (``unique``) or its
    (token, count) pairs, i.e. the repeated tokens as counts, bounded by the
    token vocabulary rather than by the group's row count."""
    t = df.select(index, F.col(token).cast("string").alias("_t")).dropna()
    if unique:
        return t.groupBy(index).agg(F.sort_array(F.collect_set("_t")).alias("tokens"))
    c = t.groupBy(index, "_t").agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(index).agg(F.sort_array(F.collect_list(F.struct("_t", "_n"))).alias("token_counts"))


def topic_vectors(df: DataFrame, index: str, token: str, n_topics: int = 10, unique: bool = True,
                  max_iter: int = 20, seed: int = 0) -> DataFrame:
    """LDA topic mixture per ``index`` document (alpha = eta = 0.5).

    The vocabulary comes from the distinct-token documents; repeated-token
    documents are built as sparse count vectors from (token, count) pairs,
    so no document row grows with the group's row count."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    udocs = token_documents(df, index, token, True)
    n_tokens = df.select(F.col(token).cast("string")).dropna().distinct().count()
    cv = CountVectorizer(inputCol="tokens", outputCol="_tf", vocabSize=max(n_tokens, 1)).fit(udocs)   # every token
    if unique:
        tf = cv.transform(udocs)
    else:
        spark = df.sparkSession
        n_vocab = len(cv.vocabulary)
        vocab = spark.createDataFrame(list(enumerate(cv.vocabulary)), "_i int, _t string")
        c = token_documents(df, index, token, False).select(index, F.explode("token_counts").alias("_s"))
        c = c.select(index, F.col("_s._t").alias("_t"), F.col("_s._n").alias("_n")).join(
            vocab, "_t")
        pairs = c.groupBy(index).agg(F.sort_array(F.collect_list(F.struct("_i", "_n"))).alias("_p"))
        to_vec = F.udf(lambda ps: SparseVector(n_vocab, [p[0] for p in ps], [float(p[1]) for p in ps]), VectorUDT())
        tf = pairs.select(index, to_vec("_p").alias("_tf"))
    lda = LDA(k=n_topics, maxIter=max_iter, seed=seed, docConcentration=[0.5] * n_topics,
              topicConcentration=0.5, featuresCol="_tf", topicDistributionCol="_topics", optimizer="online")
    out = lda.fit(tf).transform(tf)
    a = vector_to_array("_topics")
    return out.select(index, *[a[i].alias(f"topic_{i}") for i in range(n_topics)])


# M7 / M8 -------------------------------------------------------------------
def gbt_cv(df: DataFrame, features: list[str], label: str = "y", fold: str = "fold", k: int = 5,
           max_iter: int = 20, max_depth: int = 5, seed: int = 0):
    """Per fold: fit a GBT on the other folds, score the fold.  Returns the OOF
    table (row_id, fold, pred) and the stacked importances (fold, feature, importance)."""
    assembler = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    data = assembler.transform(df.na.fill(-999.0, subset=features)).select("row_id", fold, label, "_x")
    preds, imps = [], []
    spark = df.sparkSession
    for f in range(k):
        model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed) \
            .fit(data.filter(F.col(fold) != f))
        p = model.transform(data.filter(F.col(fold) == f))
        preds.append(p.select("row_id", F.lit(f).alias(fold), vector_to_array("probability")[1].alias("pred")))
        imp = model.featureImportances.toArray()
        imps.append(spark.createDataFrame([(f, n, float(v)) for n, v in zip(features, imp)],
                                          "fold int, feature string, importance double"))
    oof = preds[0]
    for p in preds[1:]:
        oof = oof.unionByName(p)
    imp_all = imps[0]
    for i in imps[1:]:
        imp_all = imp_all.unionByName(i)
    return oof, imp_all


def fit_fold_models(df: DataFrame, features: list[str], label: str = "y", fold: str = "fold", k: int = 5):
    """One logistic model per fold (trained without that fold)."""
    models = []
    for f in range(k):
        pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"),
                                LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50)])
        models.append(pipe.fit(df.filter(F.col(fold) != f).na.fill(0.0, subset=features)))
    return models


def save_models(models, path: str) -> str:
    """Fold models, one folder each below ``path``, and their number."""
    spark = SparkSession.getActiveSession()
    for i, m in enumerate(models):
        m.write().overwrite().save(os.path.join(path, f"fold{i}"))
    spark.createDataFrame([(len(models),)], "n int").write.mode("overwrite").parquet(os.path.join(path, "number"))
    return path


def load_models(spark: SparkSession, path: str) -> list[PipelineModel]:
    """The fold models that ``save_models`` wrote."""
    n = spark.read.parquet(os.path.join(path, "number")).first()["n"]
    return [PipelineModel.load(os.path.join(path, f"fold{i}")) for i in range(n)]


def score_with_models(df: DataFrame, models, features: list[str], weights=None) -> DataFrame:
    """Score rows with every fold model (JVM-side ``transform``) and average the
    probabilities with the fold weights (1/k by default), in one pass over the rows."""
    k = len(models)
    weights = weights or [1.0 / k] * k
    data = df.na.fill(0.0, subset=features).select("row_id", *features)
    for i, (m, w) in enumerate(zip(models, weights)):
        p = vector_to_array("probability")[1] * F.lit(w)
        data = m.transform(data).select("row_id", *features, *[f"_p{j}" for j in range(i)], p.alias(f"_p{i}"))
    total = sum((F.col(f"_p{i}") for i in range(k)), F.lit(0.0))
    return data.select("row_id", total.alias("pred"))
