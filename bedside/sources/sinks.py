"""Persisted relations and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.operators import pieces
from bedside.sources.shared import keep_in, materialize, passing_folder, shared_folder  # noqa: F401


def materialize_table(df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Same as a catalog table, optionally bucketed so later joins on these columns need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_features(df: DataFrame, path: str, id_name: str | None = None, order: Sequence[str] = ()) -> None:
    """CSV with header; ``id_name`` adds a row id from 0 by ``order``, whose first column is the group."""
    if id_name is not None:
        group, key, *ties = order
        df = with_row_id(df, group, key, ties, id_name)
    df.write.mode("overwrite").csv(path, header=True)


def with_row_id(
    df: DataFrame,
    group: str,
    key: str,
    ties: Sequence[str] = (),
    name: str = "id",
    max_rows: int | None = pieces.MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Ids 0, 1, ... by (group, key, ties): numbered inside each group, then shifted by the smaller groups.

    ``group`` is a column of few values, such as the label, so its counts are few rows; a column of many values
    belongs in ``key``. ``df`` is read twice, so an expensive one is best materialized before.
    """
    numbered = pieces.add_row_number(df, [group], key, ties, "__n", max_rows, sized_by)
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift"))
    return (
        numbered.join(F.broadcast(shift), group, "inner")
        .withColumn(name, F.col("__n") - 1 + F.col("__shift"))
        .select(name, *df.columns)
    )


def write_importance(df: DataFrame, path: str, run: str, fold: int) -> None:
    """Write one fold's importance as a (run, fold) partition; a repeated fold replaces itself."""
    tagged = df.withColumns({"run": F.lit(run), "fold": F.lit(fold)})
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "fold").csv(path, header=True)
