"""From the feature matrix to cross-validated models, as the study's notebook does it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.operators import features, metrics, models

# fixed values: share of missing values a feature may have, test share and seeds
MAX_MISSING = 0.8
TEST_SHARE, SPLIT_SEED = 0.2, 42
FOLDS, FOLD_SEED = 5, 520


@dataclass(frozen=True)
class Prepared:
    """Train and test rows without nulls, and the columns to learn from."""

    train: DataFrame
    test: DataFrame
    columns: tuple[str, ...]


def prepare(
    feature: DataFrame, cohort: DataFrame, key: str, label: str, max_missing: float = MAX_MISSING, strategy: str = "mean"
) -> Prepared:
    """Drop sparse features, attach labels, split, and impute with training means (or medians).

    Trees here need complete rows, so every feature with gaps also gets a 0/1 column that marks them.
    """
    kept = features.filter_missing_columns(feature, max_missing, always=[key])
    data = kept.join(cohort.select(key, label), key, "inner")
    columns = [c for c in kept.columns if c != key]
    flagged = features.with_null_flags(data, columns)
    train, test = features.split(flagged, key, TEST_SHARE, SPLIT_SEED)
    # a feature may be empty among the training rows although it is not overall
    filled = features.columns_with_values(train, columns)
    names = (*filled, *[f"{c}_isnull" for c in filled])
    wanted = [key, label, *names]
    if not filled:
        return Prepared(train.select(wanted), test.select(wanted), names)
    imputer = features.fit_imputer(train, filled, strategy)
    return Prepared(imputer.transform(train).select(wanted), imputer.transform(test).select(wanted), names)


def evaluate(fitted: models.CrossValidated, label: str) -> DataFrame:
    """AUC, log-loss and error rate of the held-out and the averaged test predictions."""
    parts = fitted.out_of_fold.select(label, "score", F.lit("valid").alias("part"))
    if fitted.test is not None:
        parts = parts.unionByName(fitted.test.select(label, "score", F.lit("test").alias("part")))
    return scores(parts, label)


def scores(parts: DataFrame, label: str) -> DataFrame:
    """The same of given predictions (``part, score`` and the label)."""
    by = ["part"]
    scored = metrics.auc(parts, "score", label, by)
    scored = scored.join(metrics.log_loss(parts, "score", label, by), by, "left")
    return scored.join(metrics.error_rate(parts, "score", label, by), by, "left")


def cross_validate(
    data: Prepared, key: str, label: str, params: models.GbtParams = models.DEFAULT, k: int = FOLDS,
    columns: tuple[str, ...] | None = None,
) -> models.CrossValidated:
    return models.cross_predict(data.train, data.test, columns or data.columns, label, key, k, FOLD_SEED, params)


def select_and_retrain(
    data: Prepared,
    key: str,
    label: str,
    step: int = 1,
    k: int = FOLDS,
    elimination: models.GbtParams = models.ELIMINATION,
    params: models.GbtParams = models.SELECTED,
) -> tuple[models.Elimination, models.CrossValidated]:
    """Recursive elimination on the training rows, then cross-validation on the features it kept."""
    found = models.rfe_cv(data.train, data.columns, label, key, step, k, 1, FOLD_SEED, elimination)
    return found, cross_validate(data, key, label, params, k, found.selected)
