"""Ranking and probability metrics as distributed aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.operators import pieces


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before anything is ordered."""
    positive = F.when(F.col("label") == 1, 1).otherwise(0)
    return _known(df, score, label, by).groupBy(*by, "score").agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def _known(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Rows with both score and label, under fixed names; their number bounds that of the distinct scores."""
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
    return rows.filter(pieces.present("score", "label"))


def auc(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), max_rows: int | None = pieces.MAX_ROWS
) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs ranked right, ties counting half.

    Per distinct score the negatives below it are a running sum, built piece by piece, so the global order
    never passes through one task. Null when a class is missing.
    """
    counted = pieces.add_running_sums(
        _by_score(df, score, label, by), by, "score", {"neg_upto": "neg"}, max_rows, _known(df, score, label, by)
    )
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") * F.lit(0.5))
    totals = counted.groupBy(*by).agg(
        F.sum(won).alias("won"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n")
    )
    pairs = F.col("p") * F.col("n")
    return totals.select(*by, F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def roc_points(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    drop_intermediate: bool = False,
    max_rows: int | None = pieces.MAX_ROWS,
) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending; the curve's origin has the top score plus one.

    ``drop_intermediate`` leaves out points in the middle of a straight stretch.
    """
    by = list(by)
    counted = _by_score(df, score, label, by).withColumn("__desc", -F.col("score"))
    sized = _known(df, score, label, by).withColumn("__desc", -F.col("score"))
    totals = counted.groupBy(*by).agg(
        F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.max("score").alias("__top")
    )
    points = pieces.add_running_sums(counted, by, "__desc", {"tps": "pos", "fps": "neg"}, max_rows, sized)
    if drop_intermediate:
        points = pieces.add_next(points, by, "__desc", {"__np": "pos", "__nn": "neg"}, (), max_rows, sized)
        turns = (F.col("pos") != F.col("__np")) | (F.col("neg") != F.col("__nn")) | F.col("__np").isNull()
        points = _join_totals(points, totals, by).filter(turns | (F.col("score") == F.col("__top")))
    else:
        points = _join_totals(points, totals, by)
    rates = points.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fps").cast("double"), "__n").alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), "__p").alias("tpr"),
    )
    origin = totals.filter(F.col("__top").isNotNull()).select(
        *by, (F.col("__top") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return rates.unionByName(origin)


def _join_totals(points: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return points.join(totals, by, "inner")
    return points.join(F.broadcast(totals), F.lit(True), "left")  # one row of totals


def log_loss(df: DataFrame, score: str, label: str, by: Sequence[str] = (), floor: float = 1e-15) -> DataFrame:
    """Mean negative log-likelihood of probabilities kept ``floor`` away from 0 and 1."""
    p = F.greatest(F.least(F.col(score), F.lit(1.0 - floor)), F.lit(floor))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log1p(-p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def error_rate(df: DataFrame, score: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Share of rows whose side of the threshold disagrees with the label."""
    wrong = (F.col(score) > threshold).cast("int") != F.col(label)
    return df.groupBy(*by).agg(F.avg(wrong.cast("double")).alias("error_rate"))
