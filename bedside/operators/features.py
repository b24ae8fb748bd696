"""Per-entity feature matrices, missing-rate filter, imputation, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"max": F.max, "min": F.min, "mean": F.avg}


def aggregate_features(
    wide: DataFrame,
    entity: str,
    columns: Sequence[str] | None = None,
    aggs: Sequence[str] = ("max", "min", "mean"),
    drop: Sequence[str] = (),
) -> DataFrame:
    """One row per entity with ``<column>_<agg>`` of all measurement columns, nulls skipped, in one pass."""
    columns = columns or [c for c in wide.columns if c != entity and c not in drop]
    features = [AGGREGATES[a](c).alias(f"{c}_{a}") for a in aggs for c in columns]
    return wide.filter(F.col(entity).isNotNull()).groupBy(entity).agg(*features)


def build_features(
    vitals: DataFrame,
    labs: DataFrame,
    entity: str,
    aggs: Sequence[str] = ("max", "min", "mean"),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Feature matrix of the entities that have both vitals and labs."""
    left = aggregate_features(vitals, entity, aggs=aggs, drop=drop)
    return left.join(aggregate_features(labs, entity, aggs=aggs, drop=drop), entity, "inner")


def build_features_paired(
    negatives: tuple[DataFrame, DataFrame],
    positives: tuple[DataFrame, DataFrame],
    entity: str,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Max/min features of (vitals, labs) pairs: label 0 from the first, label 1 from the second pair."""
    parts = [
        build_features(*pair, entity, aggs=("max", "min"), drop=drop).withColumn("label", F.lit(label))
        for label, pair in enumerate((negatives, positives))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def with_group_stats(wide: DataFrame, entity: str, drop: Sequence[str] = ()) -> DataFrame:
    """Raw rows with their entity's max and min features beside them."""
    return wide.join(aggregate_features(wide, entity, aggs=("max", "min"), drop=drop), entity, "inner")


def drop_all_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Without the rows in which all (given) columns are null."""
    return df.dropna(how="all", subset=list(columns) if columns else None)


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(variable, missing_rate) of each column, from one aggregation."""
    columns = list(columns or df.columns)
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], columns, "variable", "missing_rate")


def filter_missing_columns(df: DataFrame, rate: float, always: Sequence[str] = ()) -> DataFrame:
    """Keep columns missing in at most ``rate`` of the rows.

    The schema depends on the data, so one row of counts per call comes to the driver; counts compare exactly
    where a rate would round.
    """
    columns = [c for c in df.columns if c not in always]
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    total = counted["n"]
    kept = [c for c in columns if total == 0 or (total - counted[c]) / total <= rate]
    return df.select(*always, *kept)


def columns_with_values(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that hold a value in some row; one row of counts comes to the driver."""
    if not columns:
        return []
    counted = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counted[c]]


def label_summary(df: DataFrame, label: str) -> DataFrame:
    """Positive share in percent, positive count and total count."""
    return df.agg(
        (100 * F.avg((F.col(label) == 1).cast("int"))).alias("positive_percent"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positive_count"),
        F.count(label).alias("total_count"),
    )


def fit_imputer(train: DataFrame, columns: Sequence[str], strategy: str = "mean") -> ImputerModel:
    """Mean or median imputation learnt on training rows (deviation: not on all rows before the split)."""
    typed = [F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in train.columns]
    imputer = Imputer(strategy=strategy, inputCols=list(columns), outputCols=list(columns), relativeError=1e-4)
    return imputer.fit(train.select(*typed))


def with_null_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns that keep the information imputation removes."""
    return df.withColumns({f"{c}_isnull": F.col(c).isNull().cast("int") for c in columns})


def hash_bucket(key: str, buckets: int, seed: int) -> Column:
    """Pseudo-random bucket of a row that depends only on its id and the seed.

    Unlike a random column it is the same however the rows are partitioned or recomputed.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by id hash, in thousandths."""
    marked = with_holdout(df, key, test_share, seed)
    return marked.filter("is_test = 0").drop("is_test"), marked.filter("is_test = 1").drop("is_test")


def with_holdout(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", (hash_bucket(key, 1000, seed) < round(test_share * 1000)).cast("int"))


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 520) -> DataFrame:
    return df.withColumn("fold", hash_bucket(key, k, seed))


