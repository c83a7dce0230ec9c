"""Folds, metrics, losses and datasets looked up by name, as a configuration names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.operators import evaluate as E
from tracefeat.operators import samples as S
from tracefeat.operators import splits as V

FOLDS: dict[str, Callable[..., DataFrame]] = {
    "KFold": V.kfold,
    "StratifiedKFold": V.stratified_kfold,
    "GroupKFold": V.group_kfold,
    "MultilabelStratifiedKFold": V.multilabel_stratified_kfold,
    "StratifiedGroupKFold": V.stratified_group_kfold,
}

METRICS: dict[str, Callable[..., DataFrame]] = {
    "auc": lambda df, y, pred: E.auc(df, y, pred).select(F.col("auc").alias("value")),
}

LOSSES: dict[str, Callable[..., DataFrame]] = {
    "BCEWithLogitsLoss": lambda df, y, logit: E.mean_loss(df, logit, y),
    "SmoothBCEwLogits": lambda df, y, logit, smoothing=0.0: E.mean_loss(df, logit, y, smoothing),
}


def _find(table: dict, name: str, what: str):
    if name not in table:
        raise KeyError(f"unknown {what} {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def assign_folds(df: DataFrame, name: str, **params) -> DataFrame:
    """``df`` with a ``fold`` column by the named split; ``params`` are the split's own."""
    return _find(FOLDS, name, "fold")(df, **params)


def metric(df: DataFrame, name: str, label: str = "y", pred: str = "pred") -> DataFrame:
    """One row: ``value`` of the named metric."""
    return _find(METRICS, name, "metric")(df, label, pred)


def loss(df: DataFrame, name: str, label: str = "y", logit: str = "logit", **params) -> DataFrame:
    """One row: ``loss``, the mean of the named loss."""
    return _find(LOSSES, name, "loss")(df, label, logit, **params)


def dataset(rows: DataFrame, name: str, **params) -> DataFrame:
    """Samples of the named dataset: windows of users or chunks (``CustomTrainDataset``, ``...2`` to ``...15``), one per
    chosen row (``CustomTestDataset...``) or flat features (``CustomMlpDataset``, ``CustomMlpDataset2``)."""
    kinds = {"CustomTrain": S.train_samples, "CustomTest": S.test_samples, "CustomMlp": S.flat_samples}
    kind = name.partition("Dataset")[0]
    return _find(kinds, kind, "dataset")(rows, name, **params)
