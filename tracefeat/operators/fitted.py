"""Encoders as objects: fitted, added to, stored, reloaded and applied (section 2.13 hooks).

An encoder keeps one table of mergeable sums per key, never finished means, so
``add`` is a union and one more partial aggregation, in any order and any number
of parts.  ``save`` writes that table and the encoder's settings as Parquet;
``load`` gives an encoder that applies and adds as the saved one does.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefeat.operators import encoders as A


class Encoder:
    """Base: ``keys`` are the key columns, ``table`` holds their sums; a row with a null key teaches nothing."""

    settings: tuple[str, ...] = ()

    def __init__(self, keys):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.table: DataFrame | None = None

    def _sums(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _group(self) -> list[str]:
        return self.keys

    def _known(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=self.keys)

    def fit(self, df: DataFrame) -> Encoder:
        self.table = self._sums(self._known(df))
        return self

    def add(self, df: DataFrame) -> Encoder:
        """Fold further rows into the fitted sums."""
        both = self._fitted().unionByName(self._sums(self._known(df)))
        values = [c for c in both.columns if c not in self._group()]
        self.table = both.groupBy(*self._group()).agg(*[F.sum(c).alias(c) for c in values])
        return self

    def levels(self) -> DataFrame:
        """The known keys, one row each."""
        return self._fitted().select(*self.keys).distinct()

    def save(self, path: str) -> str:
        table = self._fitted()
        meta = json.dumps({"kind": type(self).__name__, "keys": self.keys, **{s: getattr(self, s) for s in self.settings}})
        table.write.mode("overwrite").parquet(os.path.join(path, "sums"))
        table.sparkSession.createDataFrame([(meta,)], "meta string").write.mode("overwrite") \
            .parquet(os.path.join(path, "settings"))
        return path

    def _fitted(self) -> DataFrame:
        if self.table is None:
            raise ValueError("fit or load the encoder first")
        return self.table


class CountEncoder(Encoder):
    """key -> number of rows; an unknown key gives NULL."""

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = name or f"{A.key_name(self.keys)}_count"
        return A.attach(df, self._fitted().withColumnRenamed("n", name), self.keys)


class TargetEncoder(Encoder):
    """Out-of-fold target means over ``k`` folds of a fold column.

    ``transform_folds`` gives rows of the training frame the mean of their key
    over the other folds; ``transform`` gives new rows the mean of the k fold
    encoders, NULL where one of them lacks the key."""

    settings = ("target", "k", "fold")

    def __init__(self, keys, target: str, k: int = 5, fold: str = "fold"):
        super().__init__(keys)
        self.target, self.k, self.fold = target, k, fold

    def _group(self) -> list[str]:
        return [*self.keys, self.fold]

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self._group()).agg(F.sum(self.target).alias("s"), F.count(self.target).alias("n"))

    def _default_name(self) -> str:
        return f"te_{A.key_name(self.keys)}_by_{self.target}"

    def _totals(self) -> DataFrame:
        return self._fitted().groupBy(*self.keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))

    def fold_means(self) -> DataFrame:
        """(keys, fold, te): mean of the rows outside the fold, for keys with such rows."""
        folds = self._totals().withColumn(self.fold, F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))))
        g = folds.join(self._fitted(), self._group(), "left")
        s = F.col("ts") - F.coalesce("s", F.lit(0))
        n = F.col("tn") - F.coalesce("n", F.lit(0))
        return g.filter(n > 0).select(*self._group(), (s / n).alias("te"))

    def transform_folds(self, df: DataFrame, name: str | None = None) -> DataFrame:
        return A.attach(df, self.fold_means().withColumnRenamed("te", name or self._default_name()), self._group())

    def fit_transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        return self.fit(df).transform_folds(df, name)

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        m = self.fold_means().groupBy(*self.keys).agg(F.count("te").alias("_k"), F.sum("te").alias("_s"))
        value: Column = F.when(F.col("_k") == self.k, F.col("_s") / self.k)
        return A.attach(df, m.select(*self.keys, value.alias(name or self._default_name())), self.keys)


class SmoothedEncoder(Encoder):
    """(n * mean + smooth * overall mean) / (n + smooth) per key; an unknown key gives the overall mean."""

    settings = ("target", "smooth")

    def __init__(self, keys, target: str, smooth: float = A.SMOOTH):
        super().__init__(keys)
        self.target, self.smooth = target, smooth

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(F.sum(self.target).alias("s"), F.count(self.target).alias("n"))

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = name or f"{A.key_name(self.keys)}__{self.target}_sm{self.smooth:g}"
        t = self._fitted()
        mean = t.agg(F.sum("s") / F.sum("n")).scalar()
        te = ((F.col("s") + F.lit(self.smooth) * mean) / (F.col("n") + F.lit(self.smooth))).alias(name)
        return A.attach(df, t.select(*self.keys, te), self.keys).withColumn(name, F.coalesce(F.col(name), mean))


KINDS = {c.__name__: c for c in (CountEncoder, TargetEncoder, SmoothedEncoder)}


def load_encoder(spark: SparkSession, path: str) -> Encoder:
    """The encoder that ``save`` wrote to ``path``."""
    meta = json.loads(spark.read.parquet(os.path.join(path, "settings")).first()["meta"])
    kind = KINDS[meta.pop("kind")]
    enc = kind(**meta)
    enc.table = spark.read.parquet(os.path.join(path, "sums"))
    return enc
